"""Answers from the cube equal the direct ones for any choice, and the facts are read once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmargin.operators.bins import nice_histogram
from shelfmargin.plans import discount, facet_cube
from shelfmargin.session import checkpointed

CHOICES = [
    {},
    {"year": [1995]},
    {"category": ["SMALL", "LARGE"], "region": ["ASIA", "EUROPE"]},
    {"sub_category": ["Brand#11", "Brand#23"], "country": ["CHINA", "FRANCE", "PERU"], "year": [1994, 1996, 1997]},
    {"region": ["NOWHERE"]},
]
ANSWERS = (
    "kpis", "product_summary", "range_summary", "category_discount", "region_profit", "monthly_trend", "correlation",
)


@pytest.fixture(scope="module")
def lines(sf_tables):
    """The table's lines and some without discount, product name or order."""
    whole = discount.discount_lines(sf_tables["orders"], sf_tables["product"], sf_tables["location"])
    odd = whole.limit(300).withColumns(
        {name: F.when(F.col("quantity") % k == 0, F.col(name)) for k, name in ((2, "discount"), (3, "product_name"), (5, "order_id"))}
    ).withColumn("range_no", F.when(F.col("discount").isNotNull(), F.col("range_no")))
    return whole.unionByName(odd).cache()


@pytest.fixture(scope="module")
def cube(lines):
    return checkpointed(facet_cube.facet_cube(lines))


@pytest.mark.parametrize("name", ANSWERS)
@pytest.mark.parametrize("choice", CHOICES, ids=str)
def test_cube_equals_direct(lines, cube, name, choice):
    direct = getattr(discount, name)(discount.filter_lines(lines, choice))
    answer = getattr(facet_cube, name)(cube, choice)
    assert answer.dtypes == direct.dtypes
    assert sorted(map(str, answer.collect())) == sorted(map(str, direct.collect()))


def test_cells_are_few_and_add_up(lines, cube):
    cells = {row["panel"]: row for row in cube.groupBy("panel").agg(F.sum("line_count").alias("lines"), F.count("*").alias("cells")).collect()}
    assert set(cells) == set(facet_cube.PANELS)
    assert {row["lines"] for row in cells.values()} == {lines.count()}
    combinations = lines.select(*discount.FACETS).distinct().count()
    assert cells["total"]["cells"] == combinations
    assert cells["range"]["cells"] <= 6 * combinations


def test_one_read_of_the_facts(lines):
    plan = facet_cube.facet_cube(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "Union" not in plan.split("InMemoryRelation")[0]


@pytest.mark.parametrize(
    "values, most, expected",
    [
        ([0, 1, 1, 5, 10], 5, [(0, 0.0, 5.0, 3), (1, 5.0, 10.0, 1), (2, 10.0, 15.0, 1)]),
        ([0.05, 0.29, 0.31], 30, [(0, 0.05, 0.06, 1), (24, 0.29, 0.3, 1), (26, 0.31, 0.32, 1)]),
        ([-7, 3], 3, [(0, -10.0, -5.0, 1), (2, 0.0, 5.0, 1)]),
        ([3, 3], 4, [(0, 3.0, 4.0, 2)]),
        ([None, float("nan"), float("inf")], 4, []),
    ],
)
def test_round_bins(spark, values, most, expected):
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double")
    assert [tuple(row) for row in nice_histogram(df, "v", most).collect()] == expected
    assert len(expected) <= most


@pytest.mark.parametrize("most", [1, 2, 7, 40])
def test_round_bins_hold_their_values(spark, most):
    values = [(k * 37 % 1000) / 100 - 3 for k in range(500)]
    rows = nice_histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", most).collect()
    assert sum(r["row_count"] for r in rows) == len(values) and rows[-1]["bin"] < max(most, 2)
    for r in rows:
        assert r["row_count"] == sum(r["bin_start"] - 1e-9 <= v < r["bin_end"] - 1e-9 for v in values)


def test_lines_are_dealt_by_the_filters(lines):
    """A cell's lines are in one task, so a cell is sent on once and not by every task that meets it."""
    plan = facet_cube.facet_cube(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RepartitionByExpression")
