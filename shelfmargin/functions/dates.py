"""Dates in the extract's ``dd-MM-yyyy`` form and calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EXTRACT_FORMAT = "dd-MM-yyyy"


def strict_date(text: Column) -> Column:
    """Fails the job on unreadable text."""
    return F.to_date(text, EXTRACT_FORMAT)


def lenient_date(df: DataFrame, column: str, pattern: str | None = None) -> Column:
    """NULL for unreadable text; date and timestamp columns are only cast.

    Text is read as ISO by default, or by ``pattern`` (such as the extract's ``dd-MM-yyyy``).
    """
    value = F.col(column)
    if isinstance(df.schema[column].dataType, StringType):
        value = F.try_to_timestamp(value, F.lit(pattern)) if pattern else F.try_to_timestamp(value)
    return value.cast("date")


def date_text(date: Column) -> Column:
    return F.date_format(date, EXTRACT_FORMAT)


def month_bucket(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
