"""The discount page for every filter choice from one table of mergeable measures.

One read of the lines groups them by the five filters, and by the filters with each panel's own key:
product, discount range or month. Any choice of filters is a union of those cells, and every measure
merges: amounts are whole units, means are sums with counts, and the correlation comes from exact
moments. So a choice reads the cells of one panel and never the facts again.

The totals have at most one cell for each combination of filter values that occurs; the product panel
has one for each product and combination, the largest part. Write the cube partitioned by ``panel``
to let a choice read its panel alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.functions.money import from_units, ratio, rounded, units
from shelfmargin.operators.facets import apply_facets
from shelfmargin.plans import discount

Choice = Mapping[str, Sequence | None]

PANELS = {"total": None, "product": "product_name", "range": "range_no", "month": "month_year"}
_KEYS = tuple(key for key in PANELS.values() if key)
_SUMS = ("line_count", "order_ids", "sales_units", "profit_units", "profits", "discount_units", "discounts", "margin_sum", "margins")


def facet_cube(lines: DataFrame) -> DataFrame:
    """Cells of ``discount.prepare_lines`` rows: ``panel``, the filters, the panel keys, the measures.

    The lines are dealt by the filters first: each cell then has its lines in one task, which sends it
    on once. Cells are several times as wide as lines, and tasks that each met all of them would send
    each as often.
    """
    facets = list(discount.FACETS)
    margin = F.col("profit_margin").cast("double")
    sums = {
        "line_count": F.count("*"),
        "order_ids": F.count("order_id"),
        "sales_units": F.sum(units("sales")),
        "profit_units": F.sum(units("profit")),
        "profits": F.count("profit"),
        "discount_units": F.sum(units("discount")),
        "discounts": F.count("discount"),
        "margin_sum": F.sum(margin),
        "margins": F.count(margin),
    }
    sets = [facets + ([key] if key else []) for key in PANELS.values()]
    cells = lines.repartition(*facets).groupingSets(sets, *facets, *_KEYS).agg(
        *[F.grouping(key).alias(f"no_{key}") for key in _KEYS],
        *[sums[name].alias(name) for name in _SUMS],
        *discount.moments(),
    )
    panel = F.lit("total")
    for name, key in PANELS.items():
        if key:
            panel = F.when(F.col(f"no_{key}") == 0, name).otherwise(panel)
    return cells.select(panel.alias("panel"), *facets, *_KEYS, *_SUMS, *discount.MOMENTS)


def _cells(cube: DataFrame, panel: str, choice: Choice) -> DataFrame:
    return apply_facets(
        cube.where(F.col("panel") == panel), {facet: choice.get(facet) for facet in discount.FACETS}
    )


def _amount(name: str) -> Column:
    return from_units(F.sum(f"{name}_units"))


def _mean_discount() -> Column:
    return F.try_divide(_amount("discount"), F.sum("discounts")) * 100


def kpis(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.kpis`` of the chosen lines."""
    totals = _cells(cube, "total", choice).agg(
        F.coalesce(_amount("sales"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(_amount("profit"), F.lit(0.0)).alias("total_profit"),
        F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("total_orders"),
        _mean_discount().alias("avg_discount"),
    )
    return discount.kpi_texts(totals)


def product_summary(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.product_summary``."""
    return (
        _cells(cube, "product", choice)
        .where(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            _amount("sales").alias("sales"),
            _amount("profit").alias("profit"),
            rounded(ratio(F.sum("margin_sum"), F.sum("margins")), 6).alias("profit_margin"),
            _mean_discount().alias("avg_discount"),
            F.sum("order_ids").alias("order_count"),
        )
    )


def range_summary(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.range_summary``."""
    measured = (
        _cells(cube, "range", choice)
        .where(F.col("range_no").isNotNull())
        .groupBy("range_no")
        .agg(
            F.try_divide(_amount("profit"), F.sum("profits")).alias("avg_profit"),
            _amount("profit").alias("total_profit"),
            F.sum("order_ids").alias("order_count"),
            _amount("sales").alias("total_sales"),
            _mean_discount().alias("avg_discount"),
        )
    )
    return discount.every_range(measured)


def category_discount(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.category_discount``."""
    return _cells(cube, "total", choice).groupBy("category").agg(_mean_discount().alias("avg_discount"))


def region_profit(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.region_profit``."""
    return (
        _cells(cube, "total", choice)
        .groupBy("region")
        .agg(_amount("profit").alias("profit"))
        .orderBy(F.desc("profit"), "region")
    )


def monthly_trend(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.monthly_trend``."""
    return (
        _cells(cube, "month", choice)
        .groupBy("month_year")
        .agg(_amount("sales").alias("sales"), _amount("profit").alias("profit"))
        .orderBy("month_year")
    )


def correlation(cube: DataFrame, choice: Choice) -> DataFrame:
    """As ``discount.correlation``."""
    return discount.correlation_texts(_cells(cube, "total", choice).agg(*discount.merged_moments()))


def for_choices(
    cube: DataFrame, choices: Mapping[str, Choice], answer: Callable[[DataFrame, Choice], DataFrame]
) -> DataFrame:
    """``answer`` for each named choice, as one table with the ``choice`` it belongs to."""
    parts = [answer(cube, choice).select(F.lit(name).alias("choice"), "*") for name, choice in choices.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
