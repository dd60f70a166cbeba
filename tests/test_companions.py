"""The best companions of every product, against all pairs in Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from shelfmargin.operators.companions import fold_baskets, top_companions
from shelfmargin.plans import trap
from shelfmargin.sources import testbed


def brute(lines, count):
    baskets: dict = {}
    for order, item in lines:
        if order is not None and item is not None:
            baskets.setdefault(order, Counter())[item] += 1
    pairs: dict = {}
    for basket in baskets.values():
        for a, x in basket.items():
            for b, y in basket.items():
                if a != b:
                    pairs.setdefault(a, Counter())[b] += x * y
    return {
        (a, b, n, k + 1)
        for a, found in pairs.items()
        for k, (b, n) in enumerate(sorted(found.items(), key=lambda one: (-one[1], one[0]))[:count])
    }


def shop(seed, products=40, large=6, small=60):
    """Small baskets, large ones with many products, and one that holds a third of all lines."""
    rng = random.Random(seed)
    lines = [(None, 1), (1, None), (2, 3)]
    for order in range(small):
        lines += [(order, rng.randrange(products)) for _ in range(rng.randint(1, 4))]
    for order in range(1000, 1000 + large):
        lines += [(order, min(int(rng.expovariate(0.08)), products - 1)) for _ in range(rng.randint(10, 60))]
    return lines + [(5000, rng.randrange(products)) for _ in range(len(lines) // 2)]


def table(spark, lines):
    return spark.createDataFrame(lines, "order_id bigint, product_id bigint").repartition(3)


@pytest.mark.parametrize("seed, heads, floor", [(1, 4, 100_000), (2, 4, 10), (3, 8, 10), (4, 64, 100_000), (5, 1000, 10)])
def test_every_product_has_its_best(spark, seed, heads, floor):
    lines = shop(seed)
    rows = [tuple(r) for r in top_companions(table(spark, lines), 3, heads, floor).select("anchor_id", "product_id", "frequency", "rank").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(lines, 3)


def test_one_large_basket_is_settled_by_its_heads(spark):
    lines = [(1, k) for k in range(500)] + [(1, 400)] * 2 + [(2, 450), (2, 499)]
    rows = top_companions(table(spark, lines), 2, 3)
    assert {tuple(r) for r in rows.select("anchor_id", "product_id", "frequency", "rank").collect()} == brute(lines, 2)


def test_equal_to_the_anchors_own_lists(spark, sf_dir):
    orders = testbed.order_lines(spark, sf_dir, ("order_id", "product_id")).cache()
    product = testbed.product(spark, sf_dir)
    every: dict = {}
    for row in trap.bought_together_every(orders, product, 10).collect():
        every.setdefault(row.anchor_id, []).append((row.rank, row.product_id, row.product_name, row.frequency))
    lists = trap.bought_together_top(orders, product, 50).collect()
    direct: dict = {}
    for row in lists:
        direct.setdefault(row.anchor_id, []).append((row.product_id, row.product_name, row.frequency))
    assert len(direct) == 50
    for anchor, rows in direct.items():
        rows.sort(key=lambda r: (-r[2], r[0]))
        assert [one[1:] for one in sorted(every[anchor])] == rows[:10]
    orders.unpersist()


def test_empty_and_alone(spark):
    assert top_companions(table(spark, []), 3, 8).count() == 0
    assert top_companions(table(spark, [(1, 1), (1, 1), (2, 1)]), 3, 8).count() == 0
    assert fold_baskets(table(spark, [(1, 1), (1, 1), (None, 1)])).collect()[0]["lines"] == 2
    with pytest.raises(ValueError, match="heads"):
        top_companions(table(spark, []), 8, 8)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from shelfmargin.operators import companions

    asked = []
    monkeypatch.setattr(companions, "task_count", lambda rows: asked.append(rows) or 3)
    lines = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    rows = top_companions(table(spark, lines), 2, 8).select("anchor_id", "product_id", "frequency", "rank").collect()
    assert {tuple(r) for r in rows} == brute(lines, 2)
    assert asked == [4 + 9]
