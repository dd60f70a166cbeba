"""1-based row numbers in a total order, without a window over the whole data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmargin.session import checkpointed

_SLICE_BITS = 33


def number_rows(
    df: DataFrame, order_by: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Number rows by ``order_by``, restarting for each (non-null) ``within`` group.

    The rows are sorted by range partitioning, so ``order_by`` should be unique: then a
    group of any size is spread over many slices. The sorted rows with their place inside
    the slice go to the checkpoint folder, because slice bounds come from a sample and
    could move on a retry. What remains is one total per (group, slice).
    """
    columns = df.columns
    placed = checkpointed(
        df.orderBy(*[F.col(column) for column in within], *order_by).withColumn(
            "row_place", F.monotonically_increasing_id()
        )
    ).select(
        "*",
        F.shiftright("row_place", _SLICE_BITS).alias("row_slice"),
    )
    slices = placed.groupBy(*within, "row_slice").agg(
        F.min("row_place").alias("first_place"), F.count("*").alias("slice_rows")
    )
    earlier = (
        Window.partitionBy(*within)
        .orderBy("row_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = slices.select(
        *within,
        "row_slice",
        "first_place",
        F.coalesce(F.sum("slice_rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    number = F.col("row_place") - F.col("first_place") + F.col("rows_before") + 1
    return placed.join(offsets, [*within, "row_slice"]).select(
        *columns, number.cast("long").alias(name)
    )
