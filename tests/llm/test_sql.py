"""Operators that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from shelfmargin.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    relation = connection.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == relation.columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, relation.fetchall()), key=key)
