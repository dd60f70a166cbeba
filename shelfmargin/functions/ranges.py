"""Discount ranges as an ordered category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Range labels with their right-closed upper bounds in percent.
DISCOUNT_RANGES = (("0-10%", 10), ("10-20%", 20), ("20-30%", 30), ("30-40%", 40), ("40%+", 100))
LOWEST_PERCENT = -0.01
_DIGITS = 4


def discount_range_no(discount: Column) -> Column:
    """1-based range of a 0-1 discount, NULL outside ``(-0.01 %, 100 %]``.

    Compared as whole ten-thousandths of a percent, so that 0.1 is exactly 10 %.
    """
    scale = 10**_DIGITS
    percent = F.rint(discount.cast("double") * float(100 * scale))
    number = F.when(percent <= LOWEST_PERCENT * scale, None)
    for index, (_, upper) in enumerate(DISCOUNT_RANGES, start=1):
        number = number.when(percent <= float(upper * scale), index)
    return number.cast("int")


def discount_range_label(number: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label, _ in DISCOUNT_RANGES]), number - 1)


def discount_ranges(spark: SparkSession) -> DataFrame:
    """All ranges, used or not."""
    numbers = spark.range(1, len(DISCOUNT_RANGES) + 1, 1, 1).select(
        F.col("id").cast("int").alias("range_no")
    )
    return numbers.withColumn("discount_range", discount_range_label(F.col("range_no")))
