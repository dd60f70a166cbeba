from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmargin.plans import trap


@pytest.fixture(scope="module")
def shop(spark):
    """Order 1 holds half of all lines; product 1 is twice in order 2."""
    lines = [(1, i % 40, 2.5) for i in range(150)] + [(2, 1, 10.0), (2, 1, 20.0), (2, 2, 5.0)]
    lines += [(o, o % 9, float(o)) for o in range(3, 140)] + [(o, 1, 1.0) for o in range(3, 20)]
    orders = spark.createDataFrame(lines, "order_id bigint, product_id bigint, sales double")
    product = spark.createDataFrame(
        [(i, f"name {i}") for i in range(40)], "product_id bigint, product_name string"
    )
    return lines, orders.repartition(4).cache(), product


def test_trap_score_is_the_sum_of_order_totals(shop):
    lines, orders, product = shop
    totals = Counter()
    for order, _, sales in lines:
        totals[order] += sales
    expected, counts = Counter(), Counter()
    for order, item, _ in lines:
        expected[item] += totals[order]
        counts[item] += 1
    rows = trap.trap_products(orders, product).collect()
    assert {r["product_id"]: r["frequency"] for r in rows} == dict(counts)
    assert {r["product_id"]: r["trap_score"] for r in rows} == pytest.approx(dict(expected))
    assert [r["trap_score"] for r in rows] == sorted((r["trap_score"] for r in rows), reverse=True)
    assert all(r["product_name"] == f"name {r['product_id']}" for r in rows)


def _pairs(lines, anchor):
    found = Counter()
    for order, item, _ in lines:
        if item == anchor:
            for other_order, other, _ in lines:
                if other_order == order and other != anchor:
                    found[other] += 1
    return dict(found)


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_companions_count_line_pairs(shop, hot_rows):
    lines, orders, product = shop
    rows = trap.bought_together(orders, product, 1, hot_rows).collect()
    assert {r["product_id"]: r["frequency"] for r in rows} == _pairs(lines, 1)
    assert trap.bought_together(orders, product, 999, hot_rows).count() == 0


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_companions_of_the_most_frequent_products(shop, hot_rows):
    lines, orders, product = shop
    counts = Counter(item for _, item, _ in lines)
    anchors = sorted(counts, key=lambda item: (-counts[item], item))[:5]
    rows = trap.bought_together_top(orders, product, 5, hot_rows).collect()
    for anchor in anchors:
        got = {r["product_id"]: r["frequency"] for r in rows if r["anchor_id"] == anchor}
        assert got == _pairs(lines, anchor)
    assert {r["anchor_id"] for r in rows} <= set(anchors)


def test_companion_counts_are_symmetric(shop):
    _, orders, product = shop
    one = trap.bought_together(orders, product, 1).where("product_id = 2").first()["frequency"]
    two = trap.bought_together(orders, product, 2).where("product_id = 1").first()["frequency"]
    assert one == two


def test_top_frequency_and_display(shop):
    _, orders, product = shop
    top = trap.top_frequency(trap.trap_products(orders, product), 3).collect()
    assert len(top) == 3 and top[0]["frequency"] >= top[1]["frequency"] >= top[2]["frequency"]
    shown = trap.companion_list(trap.bought_together(orders, product, 1))
    assert shown.columns == ["Companion product", "Frequency in same orders"]


def test_order_totals_match_basket_totals(shop):
    _, orders, _ = shop
    totals = {r[0]: r[1] for r in trap.order_totals(orders).collect()}
    for row in trap.basket_totals(orders).collect():
        assert row["order_total"] == totals[row["order_id"]]
    lines = trap.basket_totals(orders).agg(F.sum("line_count")).first()[0]
    assert lines == orders.count()
