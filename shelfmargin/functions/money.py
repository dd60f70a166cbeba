"""Exact sums, safe ratios and rounding.

Amounts are doubles, but a sum of doubles depends on the order in which partitions arrive.
So amounts are added as whole numbers of their smallest unit and scaled back once, which
gives the same total on any cluster.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_DIGITS = 4


def units(measure: Column | str, digits: int = AMOUNT_DIGITS) -> Column:
    """The amount in whole units of its last digit; the decimal type leaves room for sums."""
    column = F.col(measure) if isinstance(measure, str) else measure
    return F.rint(column.cast("double") * float(10**digits)).cast("long").cast("decimal(18,0)")


def from_units(total: Column, digits: int = AMOUNT_DIGITS) -> Column:
    return (total * F.lit(Decimal(1).scaleb(-digits))).cast("double")


def exact_sum(measure: Column | str, digits: int = AMOUNT_DIGITS) -> Column:
    return from_units(F.sum(units(measure, digits)), digits)


def exact_mean(measure: Column | str) -> Column:
    column = F.col(measure) if isinstance(measure, str) else measure
    return F.try_divide(exact_sum(column), F.count(column))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding by scaling; ``round`` on doubles differs between engines."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two doubles; NULL where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * 100


def percent_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(percent(numerator, denominator), F.lit(0.0))
