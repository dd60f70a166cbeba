"""Products that ride on large baskets, and what is bought with them.

``frequency`` counts order lines here. Lines of an order are never multiplied with each
other: an order's lines meet its total, or the few anchor counts of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmargin.functions.money import exact_sum, from_units, units
from shelfmargin.operators.companions import HEADS, top_companions
from shelfmargin.operators.skew import HOT_ROWS, hot_keys, join_by_key


def order_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_id").agg(exact_sum("sales").alias("order_total"))


def _order_units(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_id").agg(F.sum(units("sales")).alias("order_units"))


def basket_totals(orders: DataFrame) -> DataFrame:
    """Each product of each order with its line count and the total of the whole order.

    Lines are folded into products before they meet the total, and nothing groups by order
    after that, so adaptive execution can split an order of any size.
    """
    products = orders.groupBy("order_id", "product_id").agg(F.count("*").alias("line_count"))
    return products.join(_order_units(orders), "order_id").select(
        "order_id", "product_id", "line_count", from_units(F.col("order_units")).alias("order_total")
    )


def trap_products(orders: DataFrame, product: DataFrame) -> DataFrame:
    """Products by line count times mean basket value, highest first.

    Two reads of the lines: one for the order totals, one for the lines that meet them.
    """
    facts = (
        orders.select("order_id", "product_id")
        .join(_order_units(orders), "order_id")
        .groupBy("product_id")
        .agg(
            F.count("*").alias("frequency"),
            from_units(F.sum("order_units")).alias("value_sum"),
        )
    )
    mean = F.col("value_sum") / F.col("frequency")
    return (
        facts.join(product.select("product_id", "product_name"), "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "frequency",
            mean.alias("avg_basket_value"),
            (F.col("frequency") * mean).alias("trap_score"),
        )
        .orderBy(F.desc("trap_score"), "product_id")
    )


def top_frequency(traps: DataFrame, count: int = 20) -> DataFrame:
    return traps.orderBy(F.desc("frequency"), "product_id").limit(count)


def _companions(
    orders: DataFrame, anchored: DataFrame, product: DataFrame, floor: int
) -> DataFrame:
    """Line pairs per anchor and companion; ``anchored`` has one row per order and anchor.

    Only the orders of anchors are joined, counted and searched for hot ones.
    """
    some = anchored.select("order_id").distinct()
    lines = orders.select("order_id", "product_id").join(some, "order_id", "left_semi")
    hot = hot_keys(lines.select("order_id"), "order_id", floor=floor)
    together = join_by_key(lines, anchored, "order_id", hot)
    counted = (
        together.where(F.col("product_id") != F.col("anchor_id"))
        .groupBy("anchor_id", "product_id")
        .agg(F.sum(F.col("copies") * F.col("anchor_lines")).alias("frequency"))
    )
    return counted.join(product.select("product_id", "product_name"), "product_id", "left")


def bought_together(
    orders: DataFrame, product: DataFrame, anchor, floor: int = HOT_ROWS
) -> DataFrame:
    """Products in the same orders as ``anchor``, by number of line pairs."""
    anchored = (
        orders.where(F.col("product_id") == F.lit(anchor))
        .groupBy("order_id", F.col("product_id").alias("anchor_id"))
        .agg(F.count("*").alias("anchor_lines"))
    )
    return (
        _companions(orders, anchored, product, floor)
        .select("product_id", "product_name", "frequency")
        .orderBy(F.desc("frequency"), "product_id")
    )


def bought_together_top(
    orders: DataFrame, product: DataFrame, count: int = 20, floor: int = HOT_ROWS
) -> DataFrame:
    """Companions of each of the ``count`` most frequent products.

    Every line meets at most ``count`` anchors, so the work grows with the lines and not with
    the square of the order size.
    """
    by_product = orders.groupBy("product_id").agg(F.count("*").alias("frequency"))
    anchors = top_frequency(by_product, count).select(F.col("product_id").alias("anchor_id"))
    anchored = (
        orders.join(F.broadcast(anchors), F.col("product_id") == F.col("anchor_id"))
        .groupBy("order_id", "anchor_id")
        .agg(F.count("*").alias("anchor_lines"))
    )
    return (
        _companions(orders, anchored, product, floor)
        .select("anchor_id", "product_id", "product_name", "frequency")
        .orderBy("anchor_id", F.desc("frequency"), "product_id")
    )


def bought_together_every(
    orders: DataFrame, product: DataFrame, count: int = 10, heads: int = HEADS, floor: int = HOT_ROWS
) -> DataFrame:
    """The ``count`` best companions of every product, with the counts of ``bought_together``.

    The output grows with the products, and so does no list of pairs (``operators.companions``).
    """
    best = top_companions(orders.select("order_id", "product_id"), count, heads, floor)
    return best.join(product.select("product_id", "product_name"), "product_id", "left").select(
        "anchor_id", F.col("rank").cast("int").alias("rank"), "product_id", "product_name", "frequency"
    )


def companion_list(companions: DataFrame) -> DataFrame:
    """The two display columns of the drill-down."""
    return companions.select(
        F.col("product_name").alias("Companion product"),
        F.col("frequency").alias("Frequency in same orders"),
    )
