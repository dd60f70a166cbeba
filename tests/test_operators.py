"""Operators on skewed and degenerate data, against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmargin.operators import quantiles
from shelfmargin.operators.bins import histogram
from shelfmargin.operators.facets import apply_facets, facet_options, single_choice
from shelfmargin.operators.numbering import number_rows
from shelfmargin.operators.parts import collect_in_parts
from shelfmargin.operators.quantiles import exact_quantiles
from shelfmargin.operators.sampling import hash_sample
from shelfmargin.operators.skew import hot_keys, join_by_key


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds half of all rows, a third of them copies of one row."""
    rows = [(0, 7)] * 300 + [(0, i) for i in range(200)] + [(k, k * 3) for k in range(1, 500)]
    return spark.createDataFrame(rows, "key bigint, item bigint").repartition(4).cache()


def test_hot_keys_are_few_and_sliced(skewed):
    hot = hot_keys(skewed, "key", floor=50).collect()
    assert [tuple(row) for row in hot] == [(0, 10)]
    assert hot_keys(skewed, "key").count() == 0
    assert hot_keys(skewed, "key", floor=1, max_keys=3).count() < 3


@pytest.mark.parametrize("floor", [10, 100_000])
def test_join_by_key_equals_plain_join(skewed, floor):
    few = skewed.groupBy("key").agg(F.sum("item").alias("total"))
    got = Counter()
    for row in join_by_key(skewed, few, "key", hot_keys(skewed, "key", floor=floor)).collect():
        got[row["key"], row["item"], row["total"]] += row["copies"]
    plain = skewed.join(few, "key").select("key", "item", "total")
    assert got == Counter(map(tuple, plain.collect()))


@pytest.mark.parametrize("size", [20, 100_000])
def test_parts_hold_every_row_in_order(skewed, size):
    parts = collect_in_parts(skewed, "key", ["item"], "items", size).orderBy("key", "part").collect()
    found = defaultdict(list)
    for row in parts:
        assert row["first_no"] == row["part"] * size + 1 == len(found[row["key"]]) + 1
        assert len(row["items"]) <= size
        found[row["key"]] += [item["item"] for item in row["items"]]
    expected = defaultdict(list)
    for key, item in skewed.collect():
        expected[key].append(item)
    assert found == {key: sorted(items) for key, items in expected.items()}


def test_row_numbers_over_slices(spark):
    values = [(i * 7919) % 1000 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(4)
    numbered = number_rows(df, [F.col("v")], "no")
    assert sorted(map(tuple, numbered.collect())) == [(v, v + 1) for v in range(1000)]


def test_row_numbers_restart_within_groups(spark):
    rows = [("a", i) for i in range(400)] + [("b", i) for i in range(3)] + [("c", 9)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(4)
    numbered = number_rows(df, [F.desc("v")], "no", within=["g"])
    size = {"a": 400, "b": 3, "c": 10}
    assert {tuple(row) for row in numbered.collect()} == {
        (g, v, size[g] - v if g != "c" else 1) for g, v in rows
    }


@pytest.mark.parametrize("rows", [1, 2, 997])
def test_quantiles_match_numpy(spark, rows):
    rng = np.random.default_rng(3)
    steady = rng.integers(1, 4, rows)
    money = np.round(rng.normal(0, 1e5, rows), 2)
    df = spark.createDataFrame(
        [(i, int(s), float(m)) for i, (s, m) in enumerate(zip(steady, money))]
        + [(-1, None, None)],
        "id int, steady int, money double",
    ).repartition(4)
    wanted = {"s50": ("steady", 0.5), "m90": ("money", 0.9), "m95": ("money", 0.95)}
    got = exact_quantiles(df, wanted).first()
    assert got["s50"] == np.quantile(steady, 0.5)
    assert got["m90"] == pytest.approx(np.quantile(money, 0.9), abs=1e-6)
    assert got["m95"] == pytest.approx(np.quantile(money, 0.95), abs=1e-6)


def test_quantiles_of_large_and_constant_values(spark):
    df = spark.createDataFrame([(1.5e9 + i, 4.0) for i in range(100)], "v double, c double")
    got = exact_quantiles(df, {"v": ("v", 0.95), "c": ("c", 0.3)}).first()
    assert got["v"] == pytest.approx(np.quantile(1.5e9 + np.arange(100), 0.95)) and got["c"] == 4.0


def test_quantiles_beyond_one_sketch(spark):
    """Many values, heavy ties, infinities and a constant, each over several brackets."""
    rng = np.random.default_rng(8)
    n = 60_000
    table = {
        "plain": rng.normal(0, 1e6, n),
        "ties": rng.choice([1.0, 2.0, 3.0], n, p=[0.499, 0.002, 0.499]),
        "hot": np.where(rng.random(n) < 0.34, 7.0, rng.normal(7, 1, n)),
        "same": np.full(n, 2.5),
        "ends": np.where(np.arange(n) % 3 == 0, -np.inf, rng.random(n)),
    }
    df = spark.createDataFrame(pd.DataFrame(table)).repartition(5)
    wanted = {f"{name}_{q}": (name, q / 1000) for name in table for q in (0, 333, 500, 501, 950, 1000)}
    got = exact_quantiles(df, wanted).first()
    for output, (name, q) in wanted.items():
        values, at = np.sort(table[name]), (n - 1) * q
        low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
        expected = low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
        assert got[output] == pytest.approx(expected, abs=1e-6), output


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """Even a sketch that is always wrong leads to the exact value."""
    values = np.random.default_rng(9).permutation(30_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(3)
    read, calls = quantiles._read_sketches, []

    def wrong(session, asked):
        calls.append(len(asked))
        if len(calls) > 3:
            return read(session, asked)
        low, high = (0.9, 0.95) if len(calls) % 2 else (0.01, 0.02)
        return read(session, [(s, low if k % 2 == 0 else high) for k, (s, _) in enumerate(asked)])

    monkeypatch.setattr(quantiles, "_read_sketches", wrong)
    assert exact_quantiles(df, {"a": ("v", 0.5), "b": ("v", 0.25)}).first() == (14999.5, 7499.75)
    assert len(calls) > 3


def test_quantiles_take_few_passes(sf_tables, monkeypatch):
    passes, count = [], quantiles._count
    monkeypatch.setattr(quantiles, "_count", lambda values, ranks: passes.append(len(ranks)) or count(values, ranks))
    limits = exact_quantiles(sf_tables["orders"], {"p": ("profit", 0.95), "s": ("sales", 0.5)})
    assert len(passes) <= 3
    assert "Exchange" not in limits._jdf.queryExecution().executedPlan().toString()


def test_not_a_number_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    got = exact_quantiles(df, {"a": ("v", 0.5), "b": ("v", 1.0)}).first()
    assert got["a"] == 2.0 and np.isnan(got["b"])


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "id int, v double")
    assert tuple(exact_quantiles(df, {"q": ("v", 0.5)}).first()) == (None,)


def test_facets(spark):
    rows = [("A", "a1", 1), ("A", "a2", 2), ("B", "b1", 1), (None, "n", 3)]
    df = spark.createDataFrame(rows, "cat string, sub string, year int")
    assert apply_facets(df, {"cat": ["A"], "year": [1]}).count() == 1
    assert apply_facets(df, {"cat": [], "year": None}).count() == 4
    assert apply_facets(df, {"cat": ["missing"]}).count() == 0
    assert single_choice("All") == [] and single_choice("A") == ["A"]
    options = facet_options(df, ["cat", "sub", "year"], {"sub": ("cat", ["A"])})
    assert [tuple(row) for row in options.collect()] == [
        ("cat", "A"),
        ("cat", "B"),
        ("sub", "a1"),
        ("sub", "a2"),
        ("year", "1"),
        ("year", "2"),
        ("year", "3"),
    ]


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 5, 10)] + [(None,)], "v double")
    assert [tuple(row) for row in histogram(df, "v", 5).collect()] == [
        (0, 0.0, 2.0, 3),
        (2, 4.0, 6.0, 1),
        (4, 8.0, 10.0, 1),
    ]
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [row["row_count"] for row in histogram(constant, "v", 5).collect()] == [2]


def test_sample_is_repeatable(spark):
    df = spark.range(500)
    first = hash_sample(df, 50, ["id"], 42)
    again = hash_sample(df.repartition(5), 50, ["id"], 42)
    other = hash_sample(df, 50, ["id"], 43)
    assert {r[0] for r in first.collect()} == {r[0] for r in again.collect()}
    assert {r[0] for r in first.collect()} != {r[0] for r in other.collect()}
    assert hash_sample(df, 1000, ["id"], 42).count() == 500


def test_short_keys_are_collected_without_numbering(spark, monkeypatch):
    from shelfmargin.operators import parts

    def numbered(*_, **__):
        raise AssertionError("keys of one part need no row numbers")

    monkeypatch.setattr(parts, "number_rows", numbered)
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, None), (None, 4)], "key bigint, item bigint")
    found = collect_in_parts(rows, "key", ["item"], "items", 2).orderBy("key").collect()
    assert [(r["key"], r["part"], r["first_no"], [tuple(i) for i in r["items"]]) for r in found] == [
        (1, 0, 1, [(1, 3), (2, 5)]),
        (2, 0, 1, [(1, None)]),
    ]
