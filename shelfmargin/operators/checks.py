"""Counts that tell whether keys are unique and joins keep every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` and its counts, gathered by the job that uses it: ``rows``, and the rows meeting each condition.

    The counts are there after the first action on the returned frame.
    """
    watch = Observation(name)
    counts = [F.count_if(F.coalesce(test, F.lit(False))).alias(label) for label, test in conditions.items()]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), watch


def _any_null(keys: Sequence[str]) -> Column:
    test = F.lit(False)
    for key in keys:
        test = test | F.col(key).isNull()
    return test


def key_check(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: ``check, rows, null_keys, repeated_keys, extra_rows``.

    ``null_keys`` are rows with a null in the key, which no plain join matches; the others count
    by key: keys that several rows have, and the rows beyond the first of each.
    """
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    null, repeated = _any_null(keys), ~_any_null(keys) & (F.col("held") > 1)
    zero = F.lit(0).cast("long")
    return held.agg(
        F.coalesce(F.sum("held"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(null, F.col("held"))), zero).alias("null_keys"),
        F.count_if(repeated).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("held") - 1)), zero).alias("extra_rows"),
    ).select(F.lit(name).alias("check"), "*")


def match_check(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: ``check, rows, unmatched, repeated, added``: what a left join on ``keys`` would do.

    ``unmatched`` rows find no partner, ``repeated`` ones several, and the result has ``added`` rows
    more than ``rows``. Both sides are counted by key first, so no row is repeated to find out.
    """
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    partners = lookup.where(~_any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("partners"))
    joined = many.join(partners, list(keys), "left")
    zero = F.lit(0).cast("long")
    several = F.when(F.col("partners") > 1, F.col("held"))
    return joined.agg(
        F.coalesce(F.sum("held"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("partners").isNull(), F.col("held"))), zero).alias("unmatched"),
        F.coalesce(F.sum(several), zero).alias("repeated"),
        F.coalesce(F.sum(several * (F.col("partners") - 1)), zero).alias("added"),
    ).select(F.lit(name).alias("check"), "*")


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` unless a key without nulls stands in several rows; then a ValueError says how many."""
    found = key_check(df, keys, name).first()
    if found.repeated_keys:
        raise ValueError(f"{name}: {found.repeated_keys} keys ({', '.join(keys)}) stand in {found.extra_rows} rows too many")
    return df
