"""Repeatable row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(
    df: DataFrame, size: int, key: Sequence[str], seed: int, ties: Sequence[str] = ()
) -> DataFrame:
    """At most ``size`` rows, chosen by a seeded hash of ``key`` (then ``key`` and ``ties``); all rows if there are fewer.

    Each task keeps only its own best ``size`` rows, so nothing is sorted as a whole.
    """
    ticket = F.md5(F.concat_ws("|", *[F.col(column).cast("string") for column in key], F.lit(str(seed))))
    return (
        df.withColumn("ticket", ticket)
        .orderBy("ticket", *key, *ties)
        .limit(size)
        .drop("ticket")
    )
