"""The best companions of every product, with exact counts, without a list of all pairs.

Baskets are folded to (order, product, lines). The frequency of a pair is the sum over common orders
of lines times lines. Every product of a basket meets only the basket's ``heads`` products with most
lines, so the work is at most ``heads`` times the folded rows whatever the size of a basket, and a
basket with no more products than that is counted whole.

In a larger basket a product may meet companions outside the heads. A companion that a product meets
in no counted pair has at most ``rest``: the sum, over its larger baskets, of its lines times the
lines of the first product after the heads. So the best of the counted pairs are right

* if the product has one larger basket: each of its heads, more than were asked for, has as many lines as
  any product after them, and a smaller id where they are equal;
* if the last of the best counts is above ``rest``.

For those products the counts of the pairs that may still win are completed from the rows after the
heads; the few other products take another round with sixteen times the heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmargin.operators.skew import HOT_ROWS, hot_keys, join_by_key
from shelfmargin.session import checkpointed, task_count

HEADS = 64
GROWTH = 16


def fold_baskets(orders: DataFrame) -> DataFrame:
    """``order_id, product_id, lines``; lines without either key belong to no basket."""
    return (
        orders.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("order_id", "product_id")
        .agg(F.count("*").alias("lines"))
    )


def _best(counted: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor_id").orderBy(F.desc("frequency"), "product_id")
    ranked = counted.select("anchor_id", "product_id", "frequency", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= count)


def _counted(anchors: DataFrame, heads: DataFrame, floor: int) -> DataFrame:
    """Line pairs of the rows of ``anchors`` with the heads of their baskets.

    Rows of two keys and a count are so small that tasks of even bytes would hold millions of pairs, so
    the pairs are dealt by their number, which the sizes of the baskets tell.
    """
    lines = anchors.select("order_id", F.col("product_id").alias("anchor_id"), F.col("lines").alias("anchor_lines"))
    hot = hot_keys(lines, "order_id", floor=floor)
    met = lines.groupBy("order_id").agg(F.count("*").alias("left")).join(
        heads.groupBy("order_id").agg(F.count("*").alias("right")), "order_id"
    )
    tasks = task_count(met.agg(F.sum(F.col("left") * F.col("right"))).first()[0] or 0)
    return (
        join_by_key(lines, heads.select("order_id", "product_id", "lines"), "order_id", hot)
        .where(F.col("product_id") != F.col("anchor_id"))
        .repartition(tasks, "anchor_id", "product_id")
        .groupBy("anchor_id", "product_id")
        .agg(F.sum(F.col("anchor_lines") * F.col("lines")).alias("frequency"))
    )


def _settled(
    anchors: DataFrame, items: DataFrame, large: DataFrame, count: int, heads: int, floor: int
) -> tuple[DataFrame, DataFrame]:
    """The best companions of the products that ``heads`` settle, and the other products."""
    by_lines = Window.partitionBy("order_id").orderBy(F.desc("lines"), "product_id")
    inside = items.join(large, "order_id", "left_semi")
    # the rows of large baskets alone are ranked; all rows of other baskets are heads
    first = inside.withColumn("place", F.row_number().over(by_lines)).where(F.col("place") <= heads + 1)
    first = checkpointed(first)
    head = first.where(F.col("place") <= heads).drop("place")
    after = first.where(F.col("place") == heads + 1).select("order_id", F.col("lines").alias("next_lines"))
    whole = items.join(large, "order_id", "left_anti")
    partial = checkpointed(_counted(anchors, whole.unionByName(head), floor))

    members = anchors.join(after, "order_id").select(
        "order_id", F.col("product_id").alias("anchor_id"), F.col("lines").alias("anchor_lines"), "next_lines"
    )
    open_ = members.groupBy("anchor_id").agg(
        F.count("*").alias("baskets"), F.sum(F.col("anchor_lines") * F.col("next_lines")).alias("rest")
    )
    last = _best(partial, count).where(F.col("rank") == count).select("anchor_id", F.col("frequency").alias("last"))
    known = (
        open_.join(last, "anchor_id", "left")
        .withColumn("last", F.coalesce("last", F.lit(0)))
        .withColumn("settled", (F.col("baskets") == 1) | (F.col("last") > F.col("rest")))
    )
    known = checkpointed(known)
    unsettled = known.where(~F.col("settled")).select(F.col("anchor_id").alias("product_id"))

    # pairs whose count may grow to the last of the best are completed from the rows after the heads
    may_win = partial.join(known.where("settled"), "anchor_id").where(F.col("frequency") + F.col("rest") >= F.col("last"))
    tail = inside.join(head.select("order_id", "product_id"), ["order_id", "product_id"], "left_anti")
    more = (
        may_win.select("anchor_id", "product_id")
        .join(members.select("order_id", "anchor_id", "anchor_lines"), "anchor_id")
        .join(tail, ["order_id", "product_id"])
        .select("anchor_id", "product_id", (F.col("anchor_lines") * F.col("lines")).alias("frequency"))
    )
    closed = partial.join(known.select("anchor_id"), "anchor_id", "left_anti")
    exact = (
        closed.unionByName(may_win.select("anchor_id", "product_id", "frequency"))
        .unionByName(more)
        .groupBy("anchor_id", "product_id")
        .agg(F.sum("frequency").alias("frequency"))
    )
    return _best(exact, count), unsettled


def top_companions(
    orders: DataFrame, count: int = 10, heads: int = HEADS, floor: int = HOT_ROWS
) -> DataFrame:
    """``anchor_id, product_id, frequency, rank``: the ``count`` best companions of every product.

    Frequency counts line pairs in common orders; ties go to the smaller product. A product that is
    alone in all its orders has no row. ``heads`` must exceed ``count``; it changes the work, not the
    result.
    """
    if heads <= count:
        raise ValueError("heads must exceed count")
    items = checkpointed(fold_baskets(orders))
    sizes = items.groupBy("order_id").agg(F.count("*").alias("products"))
    anchors, found = items, []
    while True:
        large = sizes.where(F.col("products") > heads).select("order_id")
        if large.isEmpty():
            found.append(_best(_counted(anchors, items, floor), count))
            break
        best, unsettled = _settled(anchors, items, large, count, heads, floor)
        found.append(best)
        if unsettled.isEmpty():
            break
        anchors, heads = items.join(unsettled, "product_id", "left_semi"), heads * GROWTH
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every
