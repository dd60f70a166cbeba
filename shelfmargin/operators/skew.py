"""Grouping and joining when one key may hold a large share of all rows.

A key is hot when it has more than ``max(floor, rows / max_keys)`` rows. By counting,
fewer than ``max_keys`` keys can be hot, so the list of hot keys has a fixed size bound
whatever the data look like, and every other key is small enough for one task. Operators
treat the two kinds apart and unite the results. When no key is hot, adaptive execution
sees the empty list and drops the hot branch before it reads anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmargin.session import cached

HOT_ROWS = 100_000
MAX_HOT_KEYS = 200_000


def hot_keys(
    rows: DataFrame, key: str, floor: int = HOT_ROWS, max_keys: int = MAX_HOT_KEYS
) -> DataFrame:
    """``key, slices``: hot keys and the number of slices that make each slice small.

    The list is small and several branches read it, so it is kept.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("key_rows"))
    total = rows.agg(F.count("*")).scalar()
    limit = F.greatest(F.lit(float(floor)), total / F.lit(float(max_keys)))
    return cached(
        counts.where(F.col(key).isNotNull() & (F.col("key_rows") > limit)).select(
            key, F.ceil(F.col("key_rows") / limit).cast("int").alias("slices")
        )
    )


def cold_rows(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows whose key fits one task."""
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti")


def hot_rows(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows of the hot keys, with the ``slices`` of their key."""
    return rows.join(F.broadcast(hot), key)


def _every_slice(sliced: DataFrame, name: str) -> DataFrame:
    """Each row once per slice of its key."""
    numbers = F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)
    return sliced.withColumn(name, F.explode(numbers)).drop("slices")


def join_by_key(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``few`` rows per key, plus a ``copies`` count.

    Equal rows of a hot key are folded into one with their count, then spread over the
    slices of the key by a hash, and the ``few`` rows of that key are repeated once per
    slice. All other rows join as they are and count as one copy.
    """
    cold = cold_rows(rows, key, hot).withColumn("copies", F.lit(1).cast("long")).join(few, key)
    folded = (
        hot_rows(rows, key, hot)
        .groupBy(*rows.columns, "slices")
        .agg(F.count("*").alias("copies"))
    )
    slice_no = F.pmod(F.xxhash64(*rows.columns), F.col("slices")).cast("int")
    left = folded.withColumn("slice", slice_no).drop("slices")
    right = _every_slice(hot_rows(few, key, hot), "slice")
    return cold.unionByName(left.join(right, [key, "slice"]).drop("slice"))
