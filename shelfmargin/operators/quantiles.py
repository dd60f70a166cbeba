"""Exact interpolated quantiles as a one-row DataFrame, by bracketed selection.

A mergeable KLL sketch of the values puts a bracket around each wanted rank. One pass then counts the
values below the bracket, at its two ends and inside it, which settles the rank if an end holds it, and
sketches the inside, which gives the next bracket. A sketch that has seen no more values than it keeps
is exact, so the last bracket is a value. Nothing is sorted or shuffled but one row of counts and sketches
per task; the inside shrinks by the error of the sketch each time, about a hundredfold.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.functions.money import rounded
from shelfmargin.session import kept

_DIGITS = 7
SKETCH_SIZE = 2048
# the error of a normalised rank is about 2.3 / size ** 0.9 at 99 %; the bracket is twice as wide
_ERROR = 2 * 2.3 / SKETCH_SIZE**0.9


@dataclass
class _Rank:
    """A wanted rank of a column, and what is known of it.

    Its value lies strictly between ``low`` and ``high`` (None: no bound); ``before`` values are not above
    ``low`` and ``size`` lie between. ``bracket`` is what the last sketch says, not a bound.
    """

    column: str
    rank: int
    before: int
    size: int
    low: float | None = None
    high: float | None = None
    bracket: tuple[float, float] | None = None
    value: float | None = None

    def between(self) -> Column:
        value, inside = F.col(self.column), F.lit(True)
        if self.low is not None:
            inside = inside & (value > self.low)
        if self.high is not None:
            inside = inside & (value < self.high)
        return inside

    def narrowed(self, low: float | None, high: float | None, before: int, size: int) -> None:
        self.low, self.high, self.before, self.size, self.bracket = low, high, before, size, None


def _sketch(column: str, where: Column) -> Column:
    return F.kll_sketch_agg_double(F.when(where, F.col(column)), F.lit(SKETCH_SIZE))


def _read_sketches(spark: SparkSession, asked: list[tuple[bytes, float]]) -> list[float]:
    """The quantiles of (sketch, normalised rank) pairs; evaluated on the driver, without a job."""
    if not asked:
        return []
    values = [F.kll_sketch_get_quantile_double(F.lit(sketch), F.lit(rank)).alias(f"q{k}") for k, (sketch, rank) in enumerate(asked)]
    return list(spark.sql("SELECT 1 AS one").select(*values).first())


def _bracket(spark: SparkSession, sketched: list[tuple[_Rank, bytes]]) -> None:
    """Settle ranks whose sketch holds every value between the bounds, and bracket the others."""
    asked = []
    for rank, sketch in sketched:
        middle = (rank.rank - rank.before + 0.5) / rank.size
        error = 0.0 if rank.size <= SKETCH_SIZE // 2 else _ERROR
        asked += [(bytes(sketch), max(middle - error, 0.0)), (bytes(sketch), min(middle + error, 1.0))]
    found = _read_sketches(spark, asked)
    for (rank, _), low, high in zip(sketched, found[::2], found[1::2]):
        if rank.size <= SKETCH_SIZE // 2:
            rank.value = low
        else:
            rank.bracket = low, high


def _count(values: DataFrame, ranks: list[_Rank]) -> list[tuple[_Rank, bytes]]:
    """One pass over the values: settle or narrow every rank; those left, with a sketch."""
    asked: list[Column] = []
    for k, rank in enumerate(ranks):
        value, inside = F.col(rank.column), rank.between()
        if rank.bracket is None:
            asked.append(F.struct(_sketch(rank.column, inside).alias("sketch")).alias(f"r{k}"))
            continue
        low, high = rank.bracket
        within = (value > low) & (value < high)
        asked.append(
            F.struct(
                F.count(F.when(inside & (value < low), 1)).alias("below"),
                F.count(F.when(inside & (value == low), 1)).alias("at_low"),
                F.count(F.when(within, 1)).alias("within"),
                F.count(F.when(inside & (value == high), 1)).alias("at_high"),
                _sketch(rank.column, within).alias("sketch"),
            ).alias(f"r{k}")
        )
    row = values.agg(*asked).first()
    left = []
    for k, rank in enumerate(ranks):
        got = row[f"r{k}"]
        if rank.bracket is None:
            left.append((rank, got["sketch"]))
            continue
        low, high = rank.bracket
        place = rank.rank - rank.before
        if place < got["below"]:  # the sketch erred: look below the bracket
            rank.narrowed(rank.low, low, rank.before, got["below"])
        elif (place := place - got["below"]) < got["at_low"]:
            rank.value = low
        elif (place := place - got["at_low"]) < got["within"]:
            rank.narrowed(low, high, rank.before + got["below"] + got["at_low"], got["within"])
            left.append((rank, got["sketch"]))
        elif place - got["within"] < got["at_high"] and high > low:
            rank.value = high
        else:
            seen = got["below"] + got["at_low"] + got["within"] + (got["at_high"] if high > low else 0)
            rank.narrowed(high, rank.high, rank.before + seen, rank.size - seen)
    return left


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``wanted`` maps an output name to ``(column, quantile)``; NULLs are skipped.

    Values are compared as doubles; not-a-number is above all others, as in Spark's order. The two
    neighbouring ranks of a quantile are interpolated and rounded to 7 decimals, which removes the
    noise of interpolation. The wanted columns are kept for the few passes; the result is made of
    constants, so it costs nothing to use it again.
    """
    spark = df.sparkSession
    names = {column: f"v{k}" for k, column in enumerate(sorted({column for column, _ in wanted.values()}))}
    numbers = df.select(*[F.col(column).cast("double").alias(name) for column, name in names.items()])
    with kept(numbers) as values:
        known = {name: F.col(name).isNotNull() & ~F.isnan(name) for name in names.values()}
        first = values.agg(
            *[F.count(F.when(sound, 1)).alias(name) for name, sound in known.items()],
            *[F.count(name).alias(f"{name}_all") for name in known],
            *[_sketch(name, sound).alias(f"{name}_sketch") for name, sound in known.items()],
        ).first()
        ranks: dict[tuple[str, int], _Rank] = {}
        ends: dict[str, tuple[str, float]] = {}
        for output, (column, quantile) in wanted.items():
            name = names[column]
            if first[f"{name}_all"]:
                position = (first[f"{name}_all"] - 1) * float(quantile)
                ends[output] = name, position
                for rank in {math.floor(position), math.ceil(position)}:
                    found = _Rank(name, rank, 0, first[name])
                    found.value = math.nan if rank >= first[name] else None
                    ranks[name, rank] = found
        _bracket(spark, [(r, first[f"{r.column}_sketch"]) for r in ranks.values() if r.value is None])
        while open_ := [r for r in ranks.values() if r.value is None]:
            _bracket(spark, _count(values, open_))
    row = []
    for output in wanted:
        value = None
        if output in ends:
            name, position = ends[output]
            low, high = ranks[name, math.floor(position)].value, ranks[name, math.ceil(position)].value
            value = low if low == high else (math.ceil(position) - position) * low + (position - math.floor(position)) * high
        row.append(rounded(F.lit(value).cast("double"), _DIGITS).alias(output))
    return spark.sql("SELECT 1 AS one").select(*row)
