"""Aggregates that name the group with the best value; ties go to the smallest key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of_max(key: Column, value: Column) -> Column:
    return F.min_by(key, F.when(value.isNotNull(), F.struct((-value).alias("v"), key.alias("k"))))


def key_of_min(key: Column, value: Column) -> Column:
    return F.min_by(key, F.when(value.isNotNull(), F.struct(value.alias("v"), key.alias("k"))))
