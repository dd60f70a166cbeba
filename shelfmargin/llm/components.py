"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmargin.session import checkpointed


def _both(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Two rows of two columns for each row."""
    pairs = [F.struct(*[F.col(held).alias(name) for held, name in zip(pair, names)]) for pair in (first, second)]
    return rows.select(F.inline(F.array(*pairs)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (or smaller) neighbours of each node to its least neighbour.

    The minimum is pre-aggregated, and the join back may be split by adaptive execution, so
    a node with very many neighbours is spread over tasks. ``edges`` has u > v. Both rows of an
    edge come from one task: a union would double the tasks, which the driver keeps account of.
    """
    if large:
        ends = _both(edges, ("u", "v"), ("v", "u"), ("node", "other"))
    else:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    least = ends.groupBy("node").agg(F.min("other").alias("low")).select(
        "node", F.least("node", "low").alias("low")
    )
    joined = ends.join(least, "node")
    if large:
        moved = joined.where(F.col("other") > F.col("node")).select(F.col("other").alias("u"), F.col("low").alias("v"))
    else:
        moved = _both(joined, ("other", "low"), ("node", "low"), ("u", "v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``: each linked node and the least node it can reach.

    Nodes without a link do not appear; nulls link nothing. Every round is checkpointed; the
    number of rounds grows with the logarithm of the longest chain. Only an order-free
    fingerprint of the edges reaches the driver.
    """
    edges = checkpointed(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    mark = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = edges.agg(*mark).first()
    while before[0]:
        edges = checkpointed(_star(_star(edges, True), False))
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
