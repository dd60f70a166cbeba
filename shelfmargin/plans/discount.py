"""How discounts relate to profit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.functions.choice import key_of_max, key_of_min
from shelfmargin.functions.dates import lenient_date, month_bucket
from shelfmargin.functions.labels import dollars, percent_text, plain
from shelfmargin.functions.money import (
    exact_mean,
    exact_sum,
    from_units,
    percent_or_zero,
    ratio,
    rounded,
    units,
)
from shelfmargin.functions.ranges import (
    discount_range_label,
    discount_range_no,
    discount_ranges,
)
from shelfmargin.operators.facets import apply_facets, facet_options
from shelfmargin.operators.quantiles import exact_quantiles
from shelfmargin.operators.sampling import hash_sample
from shelfmargin.sources.files import require_columns

REQUIRED_COLUMNS = (
    "order_id",
    "product_id",
    "location_id",
    "sales",
    "discount",
    "profit",
    "order_date",
    "product_name",
    "category",
    "sub_category",
    "country",
    "region",
)
FACETS = ("year", "category", "sub_category", "region", "country")


def star_join(orders: DataFrame, product: DataFrame, location: DataFrame) -> DataFrame:
    """Order lines with product and location columns; lines without a place are left out."""
    placed = location.select("location_id", "country", "region").where(
        (F.col("region") != "") & (F.col("country") != "")
    )
    return (
        orders.select(
            "order_id",
            "product_id",
            "location_id",
            "sales",
            "quantity",
            "discount",
            "profit",
            "order_date",
        )
        .join(product, "product_id")
        .join(placed, "location_id")
    )


def prepare_lines(joined: DataFrame) -> DataFrame:
    """Usable lines with year, month, line margin and discount range."""
    require_columns(joined, REQUIRED_COLUMNS)
    dated = (
        joined.dropna(subset=["region", "country", "category", "sub_category"])
        .withColumn("order_date", lenient_date(joined, "order_date"))
        .where(F.col("order_date").isNotNull())
    )
    margin = percent_or_zero(F.col("profit").cast("double"), F.col("sales").cast("double"))
    return dated.select(
        "*",
        F.year("order_date").alias("year"),
        month_bucket(F.col("order_date")).alias("month_year"),
        margin.alias("profit_margin"),
        discount_range_no(F.col("discount")).alias("range_no"),
    ).withColumn("discount_range", discount_range_label(F.col("range_no")))


def discount_lines(orders: DataFrame, product: DataFrame, location: DataFrame) -> DataFrame:
    return prepare_lines(star_join(orders, product, location))


def filter_lines(lines: DataFrame, selections: Mapping[str, Sequence | None]) -> DataFrame:
    return apply_facets(lines, {facet: selections.get(facet) for facet in FACETS})


def filter_options(
    lines: DataFrame, categories: Sequence[str] = (), regions: Sequence[str] = ()
) -> DataFrame:
    """Options of the five filters; sub-categories follow the chosen categories and countries
    the chosen regions."""
    return facet_options(
        lines,
        FACETS,
        {"sub_category": ("category", categories), "country": ("region", regions)},
    )


def _mean_discount() -> Column:
    return exact_mean("discount") * 100


def kpis(lines: DataFrame) -> DataFrame:
    """``total_orders`` counts order lines."""
    totals = lines.agg(
        F.coalesce(exact_sum("sales"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(exact_sum("profit"), F.lit(0.0)).alias("total_profit"),
        F.count("*").alias("total_orders"),
        _mean_discount().alias("avg_discount"),
    )
    return kpi_texts(totals)


def kpi_texts(totals: DataFrame) -> DataFrame:
    """The totals with their margin and display texts."""
    margin = percent_or_zero(F.col("total_profit"), F.col("total_sales"))
    return totals.select(
        "total_sales",
        "total_profit",
        margin.alias("profit_margin"),
        "total_orders",
        "avg_discount",
        dollars(F.col("total_sales")).alias("total_sales_text"),
        dollars(F.col("total_profit")).alias("total_profit_text"),
        percent_text(margin).alias("profit_margin_text"),
        F.format_number("total_orders", 0).alias("total_orders_text"),
        percent_text(F.col("avg_discount")).alias("avg_discount_text"),
    )


def product_summary(lines: DataFrame) -> DataFrame:
    """Per product name; the margin is the plain mean of line margins and ``order_count``
    counts lines."""
    return (
        lines.where(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            exact_sum("sales").alias("sales"),
            exact_sum("profit").alias("profit"),
            rounded(F.avg("profit_margin"), 6).alias("profit_margin"),
            _mean_discount().alias("avg_discount"),
            F.count("order_id").alias("order_count"),
        )
    )


def top_products(products: DataFrame, by: str, count: int = 10) -> DataFrame:
    return products.orderBy(F.desc(by), "product_name").limit(count)


def bottom_products(products: DataFrame, by: str = "profit", count: int = 10) -> DataFrame:
    return products.orderBy(F.asc(by), "product_name").limit(count)


def high_sales_low_margin(products: DataFrame, count: int = 10) -> DataFrame:
    """Best sellers (sales in the top fifth) whose margin is at most the median."""
    limits = exact_quantiles(
        products, {"sales_limit": ("sales", 0.8), "margin_limit": ("profit_margin", 0.5)}
    )
    limit = limits.select(F.struct("sales_limit", "margin_limit")).scalar()
    chosen = products.where(
        (F.col("sales") >= limit["sales_limit"])
        & (F.col("profit_margin") <= limit["margin_limit"])
    )
    return top_products(chosen, "sales", count)


def _range_measures() -> list[Column]:
    return [
        exact_mean("profit").alias("avg_profit"),
        exact_sum("profit").alias("total_profit"),
        F.count("order_id").alias("order_count"),
        exact_sum("sales").alias("total_sales"),
        _mean_discount().alias("avg_discount"),
    ]


def range_summary(lines: DataFrame) -> DataFrame:
    """All five ranges in order; the margin is the ratio of sums."""
    measured = (
        lines.where(F.col("range_no").isNotNull()).groupBy("range_no").agg(*_range_measures())
    )
    return every_range(measured)


def every_range(measured: DataFrame) -> DataFrame:
    """Measures by ``range_no`` as the rows of all ranges."""
    zero = F.lit(0.0)
    return (
        discount_ranges(measured.sparkSession)
        .join(measured, "range_no", "left")
        .select(
            "range_no",
            "discount_range",
            "avg_profit",
            F.coalesce("total_profit", zero).alias("total_profit"),
            F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"),
            F.coalesce("total_sales", zero).alias("total_sales"),
            "avg_discount",
            percent_or_zero(F.col("total_profit"), F.col("total_sales")).alias("profit_margin"),
        )
        .orderBy("range_no")
    )


def category_discount(lines: DataFrame) -> DataFrame:
    return lines.groupBy("category").agg(_mean_discount().alias("avg_discount"))


def region_profit(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("region")
        .agg(exact_sum("profit").alias("profit"))
        .orderBy(F.desc("profit"), "region")
    )


def monthly_trend(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("month_year")
        .agg(exact_sum("sales").alias("sales"), exact_sum("profit").alias("profit"))
        .orderBy("month_year")
    )


MOMENTS = ("n", "sum_d", "sum_p", "sum_dp", "sum_dd", "sum_pp", "min_d", "max_d", "min_p", "max_p")


def moments() -> list[Column]:
    """Exact sums for the correlation of discount and profit; groups of them can be merged."""
    both = F.col("discount").isNotNull() & F.col("profit").isNotNull()
    d, p = (F.when(both, units(name)) for name in ("discount", "profit"))
    whole = "decimal(38,0)"
    sums = {
        "n": F.count(F.when(both, 1)), "sum_d": F.sum(d), "sum_p": F.sum(p),
        "sum_dp": F.sum((d * p).cast(whole)), "sum_dd": F.sum((d * d).cast(whole)), "sum_pp": F.sum((p * p).cast(whole)),
        "min_d": F.min(d), "max_d": F.max(d), "min_p": F.min(p), "max_p": F.max(p),
    }
    return [sums[name].alias(name) for name in MOMENTS]


def merged_moments() -> list[Column]:
    merge = {"min": F.min, "max": F.max}
    return [merge.get(name[:3], F.sum)(name).alias(name) for name in MOMENTS]


def _correlation() -> Column:
    """Pearson correlation from the moments, not rounded; NULL when either side is constant."""
    n, d, p, dp, dd, pp = (F.col(name).cast("double") for name in MOMENTS[:6])
    spread = F.sqrt(n * dd - d * d) * F.sqrt(n * pp - p * p)
    varies = (F.col("min_d") < F.col("max_d")) & (F.col("min_p") < F.col("max_p"))
    return F.when(varies, ratio(n * dp - d * p, spread))


def _impact(correlation: Column) -> Column:
    return (
        F.when(correlation.isNull(), "unreadable")
        .when(correlation < -0.3, "strong negative")
        .when(correlation < -0.1, "weak negative")
        .when(correlation > 0.1, "positive")
        .otherwise("not significant")
    )


def correlation(lines: DataFrame) -> DataFrame:
    """The value is rounded for display alone; label and text come from the full value."""
    return correlation_texts(lines.agg(*moments()))


def correlation_texts(summed: DataFrame) -> DataFrame:
    """Correlation, label and text of a row of moments."""
    value = summed.select(_correlation().alias("value"))
    return value.select(
        rounded(F.col("value"), 6).alias("correlation"),
        _impact(F.col("value")).alias("impact"),
        F.coalesce(plain(F.col("value"), 3), F.lit("n/a")).alias("correlation_text"),
    )


def _row(kind: str, subject: Column, value: Column, text: Column, keep: Column) -> Column:
    return F.when(
        keep,
        F.struct(
            F.lit(kind).alias("finding"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
            text.alias("text"),
        ),
    )


def _findings(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """The findings that hold, in order, as rows."""
    kept = F.filter(F.array(*rows), lambda row: row.isNotNull())
    return one_row.select(F.posexplode(kept).alias("finding_no", "entry")).select(
        (F.col("finding_no") + 1).alias("finding_no"), "entry.*"
    )


def insights(lines: DataFrame) -> DataFrame:
    """Best category, product and range, worst product, most discounted category.

    One pass folds the lines into product, category and range; grouping sets over that small
    result give the three groupings, and one row picks every winner.
    """
    folded = lines.groupBy("category", "product_name", "range_no").agg(
        F.sum(units("profit")).alias("profit_units"),
        F.count("profit").alias("profits"),
        F.sum(units("discount")).alias("discount_units"),
        F.count("discount").alias("discounts"),
    )
    profit = from_units(F.sum("profit_units"))
    sets = folded.groupingSets(
        [["category"], ["product_name"], ["range_no"]], "category", "product_name", "range_no"
    ).agg(
        F.grouping("category").alias("not_category"),
        F.grouping("product_name").alias("not_product"),
        F.grouping("range_no").alias("not_range"),
        profit.alias("profit"),
        ratio(profit, F.sum("profits")).alias("avg_profit"),
        (ratio(from_units(F.sum("discount_units")), F.sum("discounts")) * 100).alias("avg_discount"),
    )

    def category(value: str) -> Column:
        return F.when(F.col("not_category") == 0, F.col(value))

    def product(value: str) -> Column:
        named = (F.col("not_product") == 0) & F.col("product_name").isNotNull()
        return F.when(named, F.col(value))

    def range_(value: str) -> Column:
        known = (F.col("not_range") == 0) & F.col("range_no").isNotNull()
        return F.when(known, F.col(value))

    best = sets.agg(
        F.count("*").alias("groups"),
        key_of_max(F.col("category"), category("profit")).alias("best_category"),
        F.max(category("profit")).alias("best_category_profit"),
        key_of_max(F.col("product_name"), product("profit")).alias("best_product"),
        F.max(product("profit")).alias("best_product_profit"),
        key_of_min(F.col("product_name"), product("profit")).alias("worst_product"),
        F.min(product("profit")).alias("worst_product_profit"),
        key_of_max(F.col("category"), category("avg_discount")).alias("discount_category"),
        F.max(category("avg_discount")).alias("discount_value"),
        key_of_max(F.col("range_no"), range_("avg_profit")).alias("best_range"),
        F.max(range_("avg_profit")).alias("best_range_profit"),
    )
    c = F.col
    some = c("groups") > 0
    return _findings(
        best,
        [
            _row("no_data", F.lit(None), F.lit(None), F.lit("no data"), ~some),
            _row(
                "best_category",
                c("best_category"),
                c("best_category_profit"),
                dollars(c("best_category_profit")),
                c("best_category").isNotNull(),
            ),
            _row(
                "best_product",
                c("best_product"),
                c("best_product_profit"),
                dollars(c("best_product_profit")),
                c("best_product").isNotNull(),
            ),
            _row(
                "worst_product",
                c("worst_product"),
                c("worst_product_profit"),
                dollars(c("worst_product_profit")),
                c("worst_product_profit") < 0,
            ),
            _row(
                "highest_discount_category",
                c("discount_category"),
                c("discount_value"),
                percent_text(c("discount_value")),
                c("discount_category").isNotNull(),
            ),
            _row(
                "best_range",
                discount_range_label(c("best_range")),
                c("best_range_profit"),
                dollars(c("best_range_profit")),
                c("best_range").isNotNull(),
            ),
        ],
    )


def conclusions(lines: DataFrame) -> DataFrame:
    """Correlation, optimal range, first range in decline, strategy and margins.

    The lines are folded into their ranges once; the totals are merged from those few rows.
    """
    c = F.col
    used = c("range_no").isNotNull() & (c("order_count") > 0)
    level = (
        lines.groupBy("range_no")
        .agg(
            F.count("*").alias("line_count"),
            F.sum(units("profit")).alias("profit_units"),
            F.sum(units("sales")).alias("sales_units"),
            *moments(),
            *_range_measures(),
        )
        .withColumn("profit_margin", percent_or_zero(c("total_profit"), c("total_sales")))
    )
    picked = (
        level.agg(
            F.sum("line_count").alias("line_count"),
            *merged_moments(),
            percent_or_zero(from_units(F.sum("profit_units")), from_units(F.sum("sales_units"))).alias("overall_margin"),
            key_of_max(c("range_no"), F.when(used, c("avg_profit"))).alias("optimal_no"),
            F.max(F.when(used, c("avg_profit"))).alias("optimal_profit"),
            F.sort_array(
                F.collect_list(F.when(used, F.struct("range_no", "avg_profit", "profit_margin")))
            ).alias("ranges"),
        )
        .withColumn("correlation", _correlation())
    )
    decline = F.filter("ranges", lambda one: one["avg_profit"] < c("optimal_profit") * 0.7)
    optimal = F.filter("ranges", lambda one: one["range_no"] == c("optimal_no"))
    ready = picked.withColumns(
        {
            "optimal_margin": F.get(optimal, F.lit(0))["profit_margin"],
            "decline": F.get(decline, F.lit(0)),
            "some": F.coalesce(c("line_count"), F.lit(0)) > 0,
        }
    )
    strategy = (
        F.when(c("optimal_no") <= 2, "low discount")
        .when(c("optimal_no") == 3, "moderate discount")
        .otherwise("high volume")
    )
    known = c("some") & c("optimal_no").isNotNull()
    optimal_label = discount_range_label(c("optimal_no"))
    return _findings(
        ready,
        [
            _row("no_data", F.lit(None), F.lit(None), F.lit("no data"), ~c("some")),
            _row(
                "discount_impact",
                _impact(c("correlation")),
                rounded(c("correlation"), 6),
                F.coalesce(plain(c("correlation"), 3), F.lit("n/a")),
                c("some"),
            ),
            _row(
                "no_range",
                F.lit(None),
                F.lit(None),
                F.lit("no range to evaluate"),
                c("some") & c("optimal_no").isNull(),
            ),
            _row(
                "optimal_range", optimal_label, c("optimal_profit"), dollars(c("optimal_profit")), known
            ),
            _row(
                "decline_from",
                discount_range_label(c("decline.range_no")),
                c("decline.avg_profit"),
                dollars(c("decline.avg_profit")),
                known & c("decline").isNotNull(),
            ),
            _row("strategy", strategy, F.lit(None), strategy, known),
            _row(
                "overall_margin",
                F.lit("all"),
                c("overall_margin"),
                percent_text(c("overall_margin")),
                known,
            ),
            _row(
                "optimal_margin",
                optimal_label,
                c("optimal_margin"),
                percent_text(c("optimal_margin")),
                known,
            ),
        ],
    )


def scatter_sample(lines: DataFrame, size: int = 1000, seed: int = 42) -> DataFrame:
    """Points of the discount-profit scatter."""
    points = lines.select(
        "order_id",
        "product_id",
        "quantity",
        F.col("sales").cast("decimal(18,4)").alias("sales"),
        (F.col("discount").cast("double") * 100).alias("discount_pct"),
        F.col("profit").cast("double").alias("profit"),
        "category",
        "product_name",
        "region",
        "country",
    )
    chosen = hash_sample(
        points, size, ["order_id", "product_id", "quantity", "sales"], seed, ("discount_pct", "profit")
    )
    return chosen.withColumn("sales", F.col("sales").cast("double"))
