"""Histograms with equal bins: as many as asked for, or with round borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, bin_start, bin_end, row_count`` of the non-empty bins."""
    value = F.col(column).cast("double")
    known = df.where(F.col(column).isNotNull())
    span = known.agg(
        F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("span")
    ).scalar()
    binned = known.select(value.alias("value"), span.alias("span")).select(
        F.col("span.low").alias("low"),
        ((F.col("span.high") - F.col("span.low")) / F.lit(float(bins))).alias("width"),
        "value",
    )
    place = F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("width")))
    bin_no = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = binned.groupBy(bin_no.alias("bin"), "low", "width").agg(
        F.count("*").alias("row_count")
    )
    return counted.select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        "row_count",
    ).orderBy("bin")


_STEPS = (1, 2, 5, 10, 20, 50)


def nice_histogram(df: DataFrame, column: str, most: int) -> DataFrame:
    """``bin, bin_start, bin_end, row_count`` of the non-empty bins, whose borders are round numbers.

    The width is the least of 1, 2 and 5 times a power of ten with which at most ``most`` bins, all
    starting at multiples of the width, hold every value. Bins are counted from that of the least
    value. A constant column has one bin of width 1; values on both sides of 0 have two bins where one
    is asked for. Values that are not finite are left out.
    """
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    span = known.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("span")).scalar()
    power = F.floor(F.log10(F.try_divide(F.col("span.high") - F.col("span.low"), F.lit(float(most)))))
    ranged = known.select(value.alias("value"), span.alias("span")).select(
        "value",
        "span",
        F.when(F.col("span.high") > F.col("span.low"), power).otherwise(0).cast("int").alias("power"),
    )
    up = F.pow(F.lit(10.0), F.greatest("power", F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-F.col("power"), F.lit(0)))

    def place(of: Column, step: Column) -> Column:
        """The multiple of the width at or below a value; the noise of the division is rounded away."""
        return F.floor(F.rint(of * F.col("down") / (step * F.col("up")) * 1e9) / 1e9)

    scaled = ranged.withColumns({"up": up, "down": down})
    fits = F.filter(
        F.array(*[F.lit(float(step)) for step in _STEPS]),
        lambda step: place(F.col("span.high"), step) - place(F.col("span.low"), step) < most,
    )
    stepped = scaled.withColumn(
        "step", F.when(F.col("span.high") > F.col("span.low"), F.coalesce(F.get(fits, F.lit(0)), F.lit(float(_STEPS[-1])))).otherwise(1.0)
    )
    counted = (
        stepped.select(
            place(F.col("value"), F.col("step")).alias("at"),
            place(F.col("span.low"), F.col("step")).alias("first"),
            "step",
            "up",
            "down",
        )
        .groupBy("at", "first", "step", "up", "down")
        .agg(F.count("*").alias("row_count"))
    )
    border = lambda at: at * F.col("step") * F.col("up") / F.col("down")
    return counted.select(
        (F.col("at") - F.col("first")).cast("int").alias("bin"),
        border(F.col("at")).alias("bin_start"),
        border(F.col("at") + 1).alias("bin_end"),
        "row_count",
    ).orderBy("bin")
