from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmargin.plans import hidden_value as hidden

COLUMNS = (
    "product_id string, region string, product_name string, full_name string, category string, "
    "sub_category string, type string, variant string, total_qty bigint, frequency bigint, "
    "total_profit double, total_sales double"
)


@pytest.fixture(scope="module")
def metrics(sf_tables):
    base = hidden.hidden_base(*[sf_tables[n] for n in ("orders", "location", "product", "catalog")])
    return hidden.unit_economics(base).cache()


@pytest.fixture(scope="module")
def limits(metrics):
    return hidden.thresholds(metrics)


@pytest.fixture(scope="module")
def segmented(metrics, limits):
    return hidden.segments(metrics, limits).cache()


def _row(product, frequency, profit, region="r", sub="s", type_="t", sales=100.0, qty=10):
    return (product, region, product, product, "c", sub, type_, "v", qty, frequency, profit, sales)


def _segmented(spark, rows):
    metrics = hidden.unit_economics(spark.createDataFrame(rows, COLUMNS)).cache()
    limits = hidden.thresholds(metrics)
    return hidden.segments(metrics, limits), limits


def test_default_selector_is_the_hidden_segment(metrics, limits, segmented):
    chosen = hidden.select_hidden(metrics, limits, "avg_profit_per_order")
    left = {tuple(r) for r in chosen.select(*hidden.GRAIN).collect()}
    right = {tuple(r) for r in hidden.hidden_rows(segmented).select(*hidden.GRAIN).collect()}
    assert left == right and left


def test_profits_add_up(segmented, limits):
    row = hidden.kpis(segmented, limits).first()
    assert row["hidden_profit"] + row["non_hidden_profit"] == pytest.approx(row["total_profit"])


def test_shares_add_up_per_region(segmented):
    sums = hidden.region_mix(segmented).groupBy("region").agg(F.sum("pct")).collect()
    assert all(share == pytest.approx(1.0) for _, share in sums)


def test_zero_divisors_become_null_and_fall_to_the_last_segment(spark):
    rows = [_row("a", 1, 50.0), _row("b", 2, 10.0), _row("z", 0, 5.0, sales=0.0, qty=0)]
    segmented, _ = _segmented(spark, rows)
    found = {r["product_id"]: r for r in segmented.collect()}
    assert found["z"]["segment"] == hidden.VOLUME
    assert found["z"]["profit_margin"] is None and found["z"]["price_per_unit"] is None


def test_filter_comes_before_thresholds(metrics, limits):
    part = hidden.filter_base(metrics, "SMALL", ["ASIA"])
    assert 0 < part.count() < metrics.count()
    assert hidden.filter_base(metrics, "All", []).count() == metrics.count()
    assert tuple(hidden.thresholds(part).first()) != tuple(limits.first())


def test_kpi_cases(spark):
    gain, limits = _segmented(spark, [_row("a", 1, 50.0), _row("b", 5, -40.0), _row("c", 5, -5.0)])
    row = hidden.kpis(gain, limits).first()
    assert row["hidden_products"] == 1 and row["contribution"] == 10.0
    assert row["caption"] == "hidden products offset losses of other products"
    assert row["loss_coverage"] is None
    loss, limits = _segmented(spark, [_row("a", 1, 50.0), _row("b", 5, -80.0), _row("c", 5, -20.0)])
    row = hidden.kpis(loss, limits).first()
    assert row["loss_coverage"] == 0.5 and row["caption"] == "hidden products offset overall losses"
    zero, limits = _segmented(spark, [_row("a", 1, 0.0), _row("b", 1, 0.0)])
    row = hidden.kpis(zero, limits).first()
    assert (row["contribution"], row["loss_coverage"], row["caption"]) == (None, None, None)


def test_pivot_keeps_both_columns(spark):
    segmented, _ = _segmented(spark, [_row("a", 1, 50.0), _row("b", 5, 1.0, type_="u")])
    assert [tuple(r) for r in hidden.type_pivot(segmented, "s").collect()] == [
        ("s", "u", 0, 1, 1, 0.0),
        ("s", "t", 1, 0, 1, 1.0),
    ]
    only_others = segmented.where(F.col("product_id") == "b")
    assert [tuple(r)[2:4] for r in hidden.type_pivot(only_others).collect()] == [(0, 1)]


def test_drilldown_of_one_subcategory(segmented):
    whole = hidden.drilldown(segmented)
    name = whole.first()["Sub-Cat"]
    one = hidden.drilldown(segmented, name).orderBy("No").collect()
    assert [row["No"] for row in one] == list(range(1, len(one) + 1))
    assert [tuple(r) for r in one] == [
        tuple(r) for r in whole.where(F.col("`Sub-Cat`") == name).orderBy("No").collect()
    ]
    freq = [row["Freq"] for row in one]
    assert freq == sorted(freq)


def test_results_of_no_hidden_rows(spark):
    segmented, _ = _segmented(spark, [_row("a", 1, 50.0)])
    none = segmented.where("false")
    assert hidden.top_regions(none).count() == 0
    assert [tuple(r) for r in hidden.top_attributes(none).collect()] == [
        ("type", "-", 0),
        ("variant", "-", 0),
    ]
    assert [r["unknown_pct"] for r in hidden.missing_attributes(none).collect()] == [0.0, 0.0]


def test_legend_follows_the_category_filter(segmented):
    assert hidden.legend_column("All") == "category"
    assert hidden.legend_column("SMALL") == "sub_category"
    mix = hidden.region_mix(segmented, "sub_category")
    assert "sub_category" in mix.columns and mix.count() > 0


def test_top_region_ties_go_to_the_smallest_name(spark):
    rows = [
        _row("a", 1, 50.0, region="y"),
        _row("b", 1, 50.0, region="x"),
        _row("c", 9, 1.0, region="x"),
    ]
    segmented, _ = _segmented(spark, rows)
    assert [tuple(r) for r in hidden.top_regions(segmented).collect()] == [
        ("hidden_count", "x", "c"),
        ("total_profit", "x", "c"),
    ]


def test_repeated_catalogue_rows_repeat_facts(spark, sf_tables):
    catalog = sf_tables["catalog"]
    doubled = catalog.unionAll(catalog.withColumn("category", F.lit("other")))
    args = [sf_tables[n] for n in ("orders", "location", "product")]
    assert hidden.hidden_base(*args, doubled).count() == 2 * hidden.hidden_base(*args, catalog).count()
    parts = catalog.withColumn("part", F.lit(0)).unionAll(catalog.withColumn("part", F.lit(1)))
    assert hidden.hidden_base(*args, parts).count() == hidden.hidden_base(*args, catalog).count()


def test_lines_are_dealt_before_they_are_grouped(spark):
    orders = spark.createDataFrame(
        [(1, 1, 1, 2, 1.5, 3.0), (1, 1, 1, 1, 0.5, 1.0), (2, 1, 1, 1, 1.0, 2.0), (None, 1, 1, 1, 1.0, 2.0), (3, 2, 9, 1, 1.0, 2.0)],
        "order_id bigint, product_id bigint, location_id int, quantity bigint, profit double, sales double",
    )
    location = spark.createDataFrame([(1, "ASIA")], "location_id int, region string")
    dealt = hidden.product_region_facts(orders, location, 3)
    assert [tuple(r) for r in dealt.collect()] == [(1, "ASIA", 5, 2, 4.0, 8.0)]
    assert "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.collect() == hidden.product_region_facts(orders, location).collect()
