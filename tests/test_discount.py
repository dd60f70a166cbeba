from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmargin.plans import discount

COLUMNS = (
    "order_id string, product_id string, location_id string, sales double, quantity bigint, "
    "discount double, profit double, order_date string, product_name string, category string, "
    "sub_category string, country string, region string"
)


def _line(discount_value, profit, sales=100.0, name="p", category="c", date="2014-01-05", **more):
    row = dict(
        order_id="o",
        product_id="1",
        location_id="1",
        sales=sales,
        quantity=1,
        discount=discount_value,
        profit=profit,
        order_date=date,
        product_name=name,
        category=category,
        sub_category="s",
        country="x",
        region="r",
    )
    row.update(more)
    return tuple(row.values())


def _prepared(spark, rows):
    return discount.prepare_lines(spark.createDataFrame(rows, COLUMNS))


def test_missing_columns_are_named_in_order(spark):
    df = spark.createDataFrame([_line(0.1, 1.0)], COLUMNS).drop("sales", "region")
    with pytest.raises(ValueError, match="region, sales"):
        discount.prepare_lines(df)


def test_unusable_lines_are_dropped(spark):
    rows = [
        _line(0.1, 1.0),
        _line(0.1, 1.0, date="2014-99-99"),
        _line(0.1, 1.0, category=None),
        _line(0.1, 1.0, country=None),
    ]
    assert _prepared(spark, rows).count() == 1


def test_star_join_leaves_out_lines_without_a_place(spark):
    orders = spark.createDataFrame(
        [("o", "1", place, 1.0, 1, 0.1, 1.0, "2014-01-01") for place in ("a", "b", "c", "d")],
        "order_id string, product_id string, location_id string, sales double, quantity bigint, "
        "discount double, profit double, order_date string",
    )
    product = spark.createDataFrame(
        [("1", "p", "c", "s")],
        "product_id string, product_name string, category string, sub_category string",
    )
    location = spark.createDataFrame(
        [("a", "x", "r"), ("b", "", "r"), ("c", "x", None)],
        "location_id string, country string, region string",
    )
    joined = discount.star_join(orders, product, location)
    assert [row["location_id"] for row in joined.collect()] == ["a"]


def test_line_margin_of_zero_sales_is_zero(spark):
    lines = _prepared(spark, [_line(0.1, 5.0, sales=0.0), _line(0.1, 5.0)])
    assert sorted(row["profit_margin"] for row in lines.collect()) == [0.0, 5.0]


def test_range_summary_keeps_empty_ranges(spark):
    lines = _prepared(spark, [_line(0.05, 10.0), _line(0.05, 20.0), _line(0.5, -5.0), _line(1.5, 9.0)])
    rows = [tuple(row) for row in discount.range_summary(lines).collect()]
    assert rows == [
        (1, "0-10%", 15.0, 30.0, 2, 200.0, 5.0, 15.0),
        (2, "10-20%", None, 0.0, 0, 0.0, None, 0.0),
        (3, "20-30%", None, 0.0, 0, 0.0, None, 0.0),
        (4, "30-40%", None, 0.0, 0, 0.0, None, 0.0),
        (5, "40%+", -5.0, -5.0, 1, 100.0, 50.0, -5.0),
    ]


def test_range_counts_add_up(spark, sf_tables):
    lines = discount.discount_lines(*[sf_tables[n] for n in ("orders", "product", "location")])
    counted = discount.range_summary(lines).agg(F.sum("order_count")).first()[0]
    assert counted + lines.where("range_no IS NULL").count() == lines.count()


def test_kpis_of_nothing(spark):
    row = discount.kpis(_prepared(spark, [_line(0.1, 1.0)]).where("false")).first()
    assert (row["total_sales"], row["total_profit"], row["profit_margin"]) == (0.0, 0.0, 0.0)
    assert row["total_orders"] == 0 and row["avg_discount"] is None


def test_correlation_labels(spark):
    def label(pairs):
        lines = _prepared(spark, [_line(d, p) for d, p in pairs])
        return tuple(discount.correlation(lines).first())

    assert label([(0.1, 1.0), (0.1, 2.0)]) == (None, "unreadable", "n/a")
    assert label([(0.1, 3.0), (0.2, 2.0), (0.3, 1.0)]) == (-1.0, "strong negative", "-1.000")
    assert label([(0.1, 1.0), (0.2, 2.0)]) == (1.0, "positive", "1.000")
    assert label([(0.1, 1.0), (0.1, 2.0), (0.2, 1.0), (0.2, 2.0)])[1] == "not significant"


@pytest.mark.parametrize("bound, inside, outside", [(-0.3, "weak negative", "strong negative"), (-0.1, "not significant", "weak negative"), (0.1, "not significant", "positive")])
def test_correlation_label_next_to_a_bound(spark, bound, inside, outside):
    """Rounding for display does not move a correlation over a bound."""
    for step, expected in ((-4e-7, outside), (4e-7, inside)) if bound < 0 else ((4e-7, outside), (-4e-7, inside)):
        target = bound + step
        # discounts -1, 0, 1 with profits (x, y, -x) around their mean: r = -2x / sqrt(2 (2x^2 + y^2 * 3 / 2))
        x = 1e6 * -target
        y = (2 / 3 * ((1e6) ** 2 * 2 - 2 * x * x) / 1) ** 0.5
        lines = _prepared(spark, [_line(0.1, x - y / 2), _line(0.2, y), _line(0.3, -x - y / 2)])
        value, label, _ = discount.correlation(lines).first()
        assert (value, label) == (round(bound, 6), expected)


def test_insights(spark):
    rows = [
        _line(0.05, 10.0, name="b", category="B"),
        _line(0.05, 10.0, name="a", category="A"),
        _line(0.35, -4.0, name="z", category="A"),
        _line(0.25, 4.0, name="y", category="A"),
    ]
    found = discount.insights(_prepared(spark, rows)).collect()
    assert [(r["finding_no"], r["finding"], r["subject"], r["text"]) for r in found] == [
        (1, "best_category", "A", "$10"),
        (2, "best_product", "a", "$10"),
        (3, "worst_product", "z", "$-4"),
        (4, "highest_discount_category", "A", "21.7%"),
        (5, "best_range", "0-10%", "$10"),
    ]


def test_no_worst_product_without_a_loss(spark):
    found = discount.insights(_prepared(spark, [_line(0.05, 10.0)])).collect()
    assert "worst_product" not in [row["finding"] for row in found]


def test_findings_of_nothing(spark):
    empty = _prepared(spark, [_line(0.1, 1.0)]).where("false")
    for findings in (discount.insights(empty), discount.conclusions(empty)):
        assert [row["finding"] for row in findings.collect()] == ["no_data"]


def test_conclusions(spark):
    rows = [_line(0.05, 100.0), _line(0.15, 80.0), _line(0.25, 60.0), _line(0.45, 10.0)]
    found = discount.conclusions(_prepared(spark, rows)).collect()
    assert [(r["finding"], r["subject"], r["text"]) for r in found] == [
        ("discount_impact", "strong negative", "-0.998"),
        ("optimal_range", "0-10%", "$100"),
        ("decline_from", "20-30%", "$60"),
        ("strategy", "low discount", "low discount"),
        ("overall_margin", "all", "62.5%"),
        ("optimal_margin", "0-10%", "100.0%"),
    ]


def test_conclusions_when_every_range_loses(spark):
    rows = [_line(0.25, -10.0), _line(0.45, -20.0)]
    found = {r["finding"]: r["subject"] for r in discount.conclusions(_prepared(spark, rows)).collect()}
    assert found["optimal_range"] == "20-30%" and found["decline_from"] == "20-30%"
    assert found["strategy"] == "moderate discount"


def test_conclusions_without_a_range(spark):
    found = discount.conclusions(_prepared(spark, [_line(1.5, 1.0), _line(1.6, 2.0)])).collect()
    assert [row["finding"] for row in found] == ["discount_impact", "no_range"]


def test_high_sales_low_margin(spark):
    """Limits: sales 420 (between 400 and 500), margin 50 %."""
    facts = [("a", 500.0, 5.0), ("b", 400.0, 4.0), ("c", 10.0, 5.0), ("d", 20.0, 10.0), ("e", 30.0, 15.0)]
    lines = _prepared(spark, [_line(0.1, p, sales=s, name=n) for n, s, p in facts])
    best = discount.high_sales_low_margin(discount.product_summary(lines))
    assert [row["product_name"] for row in best.collect()] == ["a"]


def test_filter_lines(spark):
    lines = _prepared(spark, [_line(0.1, 1.0), _line(0.1, 1.0, date="2015-01-01", category="d")])
    assert discount.filter_lines(lines, {}).count() == 2
    assert discount.filter_lines(lines, {"year": [2015], "category": ["c"]}).count() == 0
    assert discount.filter_lines(lines, {"year": [2015], "category": []}).count() == 1
