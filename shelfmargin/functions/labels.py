"""Numbers as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dollars(value: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, digits))


def plain(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(plain(value, digits), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.concat(plain(value / 1000, 1), F.lit("K"))
