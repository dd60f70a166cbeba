"""Whitening against whole numbers of Python and a direct eigendecomposition."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmargin.llm import whitening
from shelfmargin.llm.whitening import op11_whitening, whiten


def whole(vector):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


def expected(rows, components=16):
    """{id: (deviation, whitened)}, explained, n of (id, whole vector) rows, computed directly."""
    fit = sorted({v for _, v in rows})
    n, x = len(fit), np.array(fit, object)
    sums = x.sum(axis=0)
    centred = n * x - sums
    exact = centred.T @ centred  # n**3 times the covariance
    covariance = np.array([[v / n**3 for v in row] for row in exact.tolist()])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    out = []
    for i, v in rows:
        d = n * np.array(v, object) - sums
        out.append((i, int((d * d).sum()), (d / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])))
    return out, values[order] / np.trace(covariance), n


@pytest.mark.parametrize("most, width, rows", [(1, 3, 5), (3, 5, 130), (900, 8, 300), (2**40, 3, 64), (2**62, 4, 70)])
def test_bit_products_are_exact(monkeypatch, most, width, rows):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    x = np.random.default_rng(width).integers(-most, most, (rows, width))
    x[:, 0] = 7
    held = whitening.Scatter(width)
    held.add(x[: rows // 2])
    held.add(x[rows // 2 :])
    whole_x = x.astype(object)
    assert held.n == rows and (held.sums == whole_x.sum(axis=0)).all()
    assert (held.products == np.triu(whole_x.T @ whole_x)).all()


def test_query_equals_direct_computation(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    sound = [
        (r["vec_id"], whole(r["embedding"]))
        for r in table
        if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])
    ]
    rows, explained, n = expected(sound)
    got = op11_whitening(spark, sf_dir).orderBy("vec_id", "component").collect()
    k = len(explained)
    assert len(got) == k * len(sound)
    points = np.array([r.whitened for r in got]).reshape(-1, k)
    direct = np.array([w for _, _, w in sorted(rows, key=lambda r: r[0])])
    assert np.allclose(points * np.sign((points * direct).sum(axis=0)), direct, rtol=1e-7, atol=1e-7)
    deviations = {i: d for i, d, _ in rows}
    assert all(r.n == n and r.deviation == r.deviation_exact == deviations[r.vec_id] for r in got)
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    fit = points[np.unique([v for _, v in sorted(sound)], axis=0, return_index=True)[1]]
    assert np.abs(np.cov(fit.T, bias=True) - np.eye(k)).max() < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [2.0, 2.0]), (4, None), (5, [nan, 1.0]),
        (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (9, [1e300, 0.0]), (10, [3.0]), (11, [5.0]), (12, [1.0, 2.0, 3.0]),
    ]
    table = vectors(spark, rows).withColumns({"whole": F.lit("x"), "n": F.lit("y"), "width": F.lit(1)})
    got = whiten(table).collect()
    assert sorted(((r.vec_id or -1), r.component) for r in got) == sorted(
        [(i, c) for i in (1, 2, 2, 3, -1) for c in (1, 2)] + [(10, 1), (11, 1)] + [(12, c) for c in (1, 2, 3)]
    )
    pairs, _, n = expected([(i, tuple(64 * int(c) + 1_000_000 for c in v)) for i, v in rows[:5]])
    assert n == 3
    for i, deviation, _ in pairs:
        assert {(r.n, r.deviation) for r in got if r.vec_id == i} == {(3, deviation)}
    assert {abs(r.whitened) for r in got if r.vec_id in (10, 11)} == {1.0}
    one = [r for r in got if r.vec_id == 12]  # a single vector has no spread
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in one)
    assert whiten(table.limit(0)).count() == 0


def test_constant_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(a), 5.0, float(b) * 2.0**40]) for k, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    got = whiten(vectors(spark, rows)).collect()
    direct, _, n = expected([(k, tuple(int(64 * c) + 1_000_000 for c in v)) for k, v in rows], 1)
    deviations = {i: d for i, d, _ in direct}
    for r in got:
        assert r.deviation_exact == Decimal(deviations[r.vec_id]) and r.n == n
        assert r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 2**63 else None)
        assert (r.whitened is None) == (r.component > 1)  # the small dimension is within rounding of the large one
    assert any(r.deviation is None for r in got)


def test_fit_folder_is_removed(spark):
    before = spark.sparkContext._jvm.java.io.File(spark.conf.get("spark.sql.warehouse.dir").replace("file:", "") + "/checkpoints")
    whiten(vectors(spark, [(1, [1.0]), (2, [2.0])])).count()
    assert not [f for f in (before.list() or []) if f.startswith("whitening")]
