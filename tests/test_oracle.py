"""Every query against its SQL in DuckDB: columns, types, row count and values."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
import oracle
from shelfmargin import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
QUERIES = registry.QUERIES
ORACLE = oracle.ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _sorted_rows(columns, rows):
    order = [columns.index(name) for name in sorted(columns)]
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(type(v)), v) for v in row))


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck.sql(ORACLE[name])
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {column: TYPES[kind] for column, kind in df.dtypes} == expected_types
    got = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    expected = _sorted_rows(relation.columns, relation.fetchall())
    assert len(got) == len(expected) > 0
    assert got == expected


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_headlines_are_queries():
    import bench

    assert set(bench.HEADLINES) <= set(QUERIES)
