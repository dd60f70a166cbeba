"""Exact scores of vectors with large components and many dimensions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmargin.llm import exact_topk
from shelfmargin.llm.exact_topk import top_k
from shelfmargin.llm.queries import OP8_SQL


@pytest.mark.parametrize("width, most", [(64, 524_288.0), (64, 2.0**20), (130, 2.0**21), (2, 2.0**24), (3, 0.7)])
def test_scores_are_whole_and_exact(spark, width, most):
    rng = np.random.default_rng(width)
    rows = [(k, (rng.uniform(-most, most, width) if k % 3 else rng.uniform(most / 2, most, width)).tolist()) for k in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = top_k(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    expected = []
    for q in range(0, 90, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:20])]
    assert [tuple(r) for r in got] == expected


def test_vectors_whose_scores_may_not_fit_take_no_part(spark):
    table = spark.createDataFrame([(0, [2.0**25, 0.0]), (1, [1.0, 1.0]), (20, [1.0, 0.0]), (2, [1e300, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(table, F.col("id") % 20 == 0).collect()] == [(20, 1, 1, 4096)]


@pytest.mark.parametrize("page", [1, 512])
def test_repeated_ids_other_lengths_and_several_blocks(spark, monkeypatch, page):
    """Rows count by place: equal ids and equal rows are candidates; vectors meet those of their length."""
    monkeypatch.setattr(exact_topk, "BLOCK", 40)
    monkeypatch.setattr(exact_topk, "ROUTES", page)
    rng = np.random.default_rng(3)
    rows = [(k % 90, (rng.normal(0, 1, 6) + 9 * (k % 4)).tolist()) for k in range(400)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (60, [5.0, 1.0]), (0, [3.0]), (7, [])]
    rows += [(100 + 20 * k, [0.0] * 6) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in top_k(table, F.col("id") % 20 == 0).collect())
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    expected = []
    for at, (q, v) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for k, (c, w) in enumerate(whole) if k != at and len(w) == len(v))
            expected += [(q, k + 1, c, -score) for k, (score, c) in enumerate(scores[:20])]
    assert got == sorted(expected)
    with duckdb.connect() as connection:
        connection.register("embeddings", table.toArrow())
        assert sorted(connection.sql(OP8_SQL).fetchall()) == sorted(expected)
