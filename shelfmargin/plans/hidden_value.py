"""Products that sell rarely but earn a lot per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfmargin.functions.choice import key_of_max
from shelfmargin.functions.labels import percent_text, thousands
from shelfmargin.functions.money import exact_sum, percent, ratio, rounded
from shelfmargin.functions.names import ATTRIBUTES, UNKNOWN, attribute
from shelfmargin.operators.bins import histogram, nice_histogram
from shelfmargin.operators.facets import ALL, apply_facets, facet_options, single_choice
from shelfmargin.operators.numbering import number_rows
from shelfmargin.operators.quantiles import exact_quantiles

HIDDEN = "Hidden High-Value"
CORE = "Core Product"
NICHE = "Low Impact Niche"
VOLUME = "Volume Driver"

# The quantile behind each threshold.
THRESHOLDS = {
    "freq_th": ("frequency", 0.50),
    "profit_th": ("total_profit", 0.95),
    "margin_th": ("profit_margin", 0.90),
    "avg_profit_th": ("avg_profit_per_order", 0.95),
}
GRAIN = ("product_id", "region")


def product_region_facts(
    orders: DataFrame, location: DataFrame, tasks: int | None = None
) -> DataFrame:
    """Units, distinct orders, profit and sales per product and region.

    With ``tasks`` the lines are dealt to that many before they are grouped, by the grain and the order,
    which spreads the lines of any product; otherwise the joins' tasks group them.
    """
    lines = orders.select("order_id", "product_id", "location_id", "quantity", "profit", "sales")
    placed = lines.join(location.select("location_id", "region"), "location_id")
    if tasks:
        placed = placed.drop("location_id").repartition(tasks, *GRAIN, "order_id")
    return (
        placed.groupBy(*GRAIN)
        .agg(
            F.sum("quantity").alias("total_qty"),
            F.count_distinct("order_id").alias("frequency"),
            exact_sum("profit").alias("total_profit"),
            exact_sum("sales").alias("total_sales"),
        )
    )


def hidden_base(
    orders: DataFrame,
    location: DataFrame,
    product: DataFrame,
    catalog: DataFrame,
    tasks: int | None = None,
) -> DataFrame:
    """Product-region facts with names, categories and attributes.

    Both lookups come after the aggregation. A catalogue that lists a product more than once
    repeats its rows.
    """
    if "part" in catalog.columns:
        catalog = catalog.where(F.col("part") == 0)
    return (
        product_region_facts(orders, location, tasks)
        .join(product.select("product_id", "product_name"), "product_id", "left")
        .join(
            catalog.select("product_id", "full_name", "category", "sub_category", "attributes"),
            "product_id",
            "left",
        )
        .select(
            *GRAIN,
            "product_name",
            "full_name",
            "category",
            "sub_category",
            *[attribute(name).alias(name) for name in ATTRIBUTES],
            "total_qty",
            "frequency",
            "total_profit",
            "total_sales",
        )
    )


def filter_base(
    base: DataFrame, category: str | None = None, regions: Sequence[str] = ()
) -> DataFrame:
    """Filters come before the thresholds, which are then those of the remaining rows."""
    return apply_facets(base, {"category": single_choice(category), "region": regions})


def filter_options(base: DataFrame) -> DataFrame:
    """``facet, option_no, option``: the values of the page's two filters in order.

    The category filter takes one value or ``All``, its option 0; the region filter any number.
    """
    found = facet_options(base, ("category", "region"))
    every = base.sparkSession.range(1).select(F.lit("category").alias("facet"), F.lit(0).alias("option_no"), F.lit(ALL).alias("option"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy("option"))
    return every.unionByName(found.select("facet", place.alias("option_no"), "option")).orderBy("facet", "option_no")


def unit_economics(base: DataFrame) -> DataFrame:
    """Margin, prices and per-order averages with two decimals; NULL for a zero divisor."""
    profit, sales = F.col("total_profit"), F.col("total_sales")
    units, frequency = F.col("total_qty").cast("double"), F.col("frequency").cast("double")
    return base.select(
        "*",
        rounded(percent(profit, sales), 2).alias("profit_margin"),
        rounded(ratio(sales, units), 2).alias("price_per_unit"),
        rounded(ratio(profit, units), 2).alias("profit_per_unit"),
        rounded(ratio(profit, frequency), 2).alias("avg_profit_per_order"),
        rounded(ratio(sales, frequency), 2).alias("avg_sales_per_order"),
    )


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row with the four limits."""
    return exact_quantiles(metrics, THRESHOLDS)


def _limit(limits: DataFrame, *names: str) -> Column:
    """Limits as one scalar that Spark fills in while the query runs."""
    return limits.select(F.struct(*names)).scalar()


def select_hidden(metrics: DataFrame, limits: DataFrame, metric: str) -> DataFrame:
    """Rare rows that are high by ``Total Profit``, ``Profit Margin`` or, for any other
    metric, profit per order."""
    measure, name = {
        "Total Profit": ("total_profit", "profit_th"),
        "Profit Margin": ("profit_margin", "margin_th"),
    }.get(metric, ("avg_profit_per_order", "avg_profit_th"))
    limit = _limit(limits, "freq_th", name)
    return metrics.where(
        (F.col("frequency") <= limit["freq_th"]) & (F.col(measure) >= limit[name])
    )


def segments(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``segment``; a row that cannot be compared is a volume driver."""
    limit = _limit(limits, "freq_th", "avg_profit_th")
    rare = F.col("frequency") <= limit["freq_th"]
    frequent = F.col("frequency") > limit["freq_th"]
    lucrative = F.col("avg_profit_per_order") >= limit["avg_profit_th"]
    modest = F.col("avg_profit_per_order") < limit["avg_profit_th"]
    return metrics.withColumn(
        "segment",
        F.when(rare & lucrative, HIDDEN)
        .when(frequent & lucrative, CORE)
        .when(rare & modest, NICHE)
        .otherwise(VOLUME),
    )


def hidden_rows(segmented: DataFrame) -> DataFrame:
    return segmented.where(F.col("segment") == HIDDEN)


def scatter_points(segmented: DataFrame) -> DataFrame:
    """Frequency against profit per order, with size and hover columns."""
    return segmented.select(
        *GRAIN,
        "frequency",
        "avg_profit_per_order",
        "segment",
        "total_sales",
        "product_name",
        "category",
        "total_profit",
    )


def margin_points(segmented: DataFrame, legend: str = "category") -> DataFrame:
    """Profit per order against margin of the hidden rows."""
    return hidden_rows(segmented).select(*GRAIN, "avg_profit_per_order", "profit_margin", legend)


def legend_column(category: str | None) -> str:
    return "sub_category" if single_choice(category) else "category"


def kpis(segmented: DataFrame, limits: DataFrame) -> DataFrame:
    """Totals and the share of hidden products, or their loss coverage if nothing is earned."""
    is_hidden = F.col("segment") == HIDDEN
    profit = F.col("total_profit").cast("decimal(38,4)")
    totals = segmented.agg(
        F.count_distinct(F.when(is_hidden, F.col("product_id"))).alias("hidden_products"),
        F.coalesce(F.sum(profit).cast("double"), F.lit(0.0)).alias("total_profit"),
        F.coalesce(F.sum(F.when(is_hidden, profit)).cast("double"), F.lit(0.0)).alias(
            "hidden_profit"
        ),
    ).withColumn("non_hidden_profit", F.col("total_profit") - F.col("hidden_profit"))
    limit = _limit(limits, "freq_th", "avg_profit_th")
    total, hidden, other = (
        F.col("total_profit"),
        F.col("hidden_profit"),
        F.col("non_hidden_profit"),
    )
    share = ratio(hidden, total)
    caption = (
        F.when(share > 1, "hidden products offset losses of other products")
        .when(total > 0, "hidden products contribute to total profit")
        .when(total < 0, "hidden products offset overall losses")
    )
    return totals.select(
        "hidden_products",
        "total_profit",
        "hidden_profit",
        "non_hidden_profit",
        share.alias("contribution"),
        F.when((total <= 0) & (other < 0), ratio(hidden, F.abs(other))).alias("loss_coverage"),
        caption.alias("caption"),
        limit["freq_th"].alias("freq_th"),
        limit["avg_profit_th"].alias("avg_profit_th"),
    )


def _products() -> Column:
    return F.count_distinct("product_id").alias("hidden_count")


def _profit() -> Column:
    return F.sum(F.col("total_profit").cast("decimal(38,4)")).cast("double").alias("total_profit")


def by_subcategory(segmented: DataFrame) -> DataFrame:
    return (
        hidden_rows(segmented)
        .where(F.col("sub_category").isNotNull())
        .groupBy("sub_category")
        .agg(_profit(), _products())
        .orderBy("total_profit", "sub_category")
    )


def region_totals(segmented: DataFrame) -> DataFrame:
    """Regions by falling number of hidden products."""
    return (
        hidden_rows(segmented)
        .where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(_products(), _profit())
        .orderBy(F.desc("hidden_count"), "region")
    )


def region_mix(segmented: DataFrame, legend: str = "category") -> DataFrame:
    """Hidden products and profit per region and legend value, with the share in the region."""
    counted = (
        hidden_rows(segmented)
        .where(F.col("region").isNotNull() & F.col(legend).isNotNull())
        .groupBy("region", legend)
        .agg(_products(), _profit())
    )
    in_region = F.sum("hidden_count").over(Window.partitionBy("region"))
    share = F.col("hidden_count") / in_region
    return counted.select(
        "*",
        share.alias("pct"),
        thousands(F.col("total_profit")).alias("profit_text"),
        percent_text(share * 100, 0).alias("pct_text"),
    ).orderBy(F.desc("total_profit"), "region", legend)


def top_regions(segmented: DataFrame, legend: str = "category") -> DataFrame:
    """Region with most hidden products, region with most hidden profit, and in each the
    legend value that leads by the same measure."""
    mix = region_mix(segmented, legend)
    totals = region_totals(segmented)
    leaders = mix.groupBy("region").agg(
        key_of_max(F.col(legend), F.col("hidden_count")).alias("top_by_count"),
        key_of_max(F.col(legend), F.col("total_profit")).alias("top_by_profit"),
    )
    joined = totals.join(leaders, "region", "left")

    def pick(measure: str, leader: str) -> Column:
        first = F.min(F.struct((-F.col(measure)).alias("order"), "region", leader))
        return F.struct(
            F.lit(measure).alias("measure"),
            first["region"].alias("region"),
            first[leader].alias("leading"),
        )

    return (
        joined.agg(
            F.count("*").alias("regions"),
            F.array(
                pick("hidden_count", "top_by_count"), pick("total_profit", "top_by_profit")
            ).alias("picks"),
        )
        .where(F.col("regions") > 0)
        .select(F.explode("picks").alias("pick"))
        .select("pick.*")
    )


def attribute_coverage(segmented: DataFrame) -> DataFrame:
    """Share of hidden products with a known type, per category."""
    known = F.when(F.col("type") != UNKNOWN, F.col("product_id"))
    return (
        hidden_rows(segmented)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.count_distinct("product_id").alias("total_products"),
            F.count_distinct(known).alias("with_type"),
        )
        .withColumn("coverage_pct", F.col("with_type") / F.col("total_products"))
    )


def missing_attributes(segmented: DataFrame) -> DataFrame:
    """Hidden products without a known type or variant, and their share."""
    counts = hidden_rows(segmented).agg(
        F.count_distinct("product_id").alias("products"),
        *[
            F.count_distinct(F.when(F.col(name) == UNKNOWN, F.col("product_id"))).alias(name)
            for name in ATTRIBUTES
        ],
    )
    entries = [
        F.struct(F.lit(name).alias("attribute"), F.col(name).alias("unknown_products"))
        for name in ATTRIBUTES
    ]
    share = F.coalesce(F.try_divide(F.col("entry.unknown_products"), F.col("products")), F.lit(0.0))
    return counts.select("products", F.explode(F.array(*entries)).alias("entry")).select(
        "entry.attribute", "entry.unknown_products", "products", share.alias("unknown_pct")
    )


def by_attribute(segmented: DataFrame, name: str) -> DataFrame:
    """Hidden products and profit per known ``type`` or ``variant``."""
    return (
        hidden_rows(segmented)
        .where(F.col(name) != UNKNOWN)
        .groupBy(name)
        .agg(_products(), _profit())
        .orderBy("hidden_count", name)
    )


def top_attributes(segmented: DataFrame) -> DataFrame:
    """Most frequent type and variant; ``-`` and 0 if none is known."""

    def top(name: str) -> DataFrame:
        best = (
            by_attribute(segmented, name)
            .agg(
                key_of_max(F.col(name), F.col("hidden_count")).alias("value"),
                F.max("hidden_count").alias("hidden_count"),
            )
        )
        return best.select(
            F.lit(name).alias("attribute"),
            F.coalesce("value", F.lit("-")).alias("value"),
            F.coalesce("hidden_count", F.lit(0)).cast("long").alias("hidden_count"),
        )

    first, second = ATTRIBUTES
    return top(first).unionAll(top(second))


def type_pivot(segmented: DataFrame, sub_category: str | None = None) -> DataFrame:
    """Hidden against other products per type, within one sub-category or within each.

    A product may count on both sides, because rows are per product and region.
    """
    rows = segmented.where((F.col("type") != UNKNOWN) & F.col("sub_category").isNotNull())
    rows = apply_facets(rows, {"sub_category": single_choice(sub_category)})
    flag = F.when(F.col("segment") == HIDDEN, "hidden").otherwise("non_hidden")
    pivoted = (
        rows.withColumn("hv_flag", flag)
        .groupBy("sub_category", "type")
        .pivot("hv_flag", ["hidden", "non_hidden"])
        .agg(F.count_distinct("product_id"))
        .fillna(0, ["hidden", "non_hidden"])
    )
    total = F.col("hidden") + F.col("non_hidden")
    return pivoted.select(
        "sub_category",
        "type",
        "hidden",
        "non_hidden",
        total.alias("total"),
        (F.col("hidden") / total).alias("hidden_ratio"),
    ).orderBy("sub_category", "hidden_ratio", "type")


def drilldown(segmented: DataFrame, sub_category: str | None = None) -> DataFrame:
    """Hidden products numbered from the rarest, within one sub-category or within each."""
    rows = hidden_rows(segmented).where(F.col("sub_category").isNotNull())
    rows = apply_facets(rows, {"sub_category": single_choice(sub_category)})
    order = [
        F.asc("frequency"),
        F.desc("profit_margin"),
        F.desc("avg_profit_per_order"),
        F.asc("product_id"),
        F.asc("region"),
    ]
    numbered = number_rows(rows, order, "no", within=["sub_category"])
    return numbered.select(
        F.col("no").alias("No"),
        F.col("product_id"),
        F.col("region"),
        F.col("product_name").alias("Product"),
        F.col("sub_category").alias("Sub-Cat"),
        F.col("frequency").alias("Freq"),
        F.col("total_sales").alias("Sales"),
        F.col("total_profit").alias("Profit"),
        F.col("avg_profit_per_order").alias("Avg Profit"),
        F.col("profit_margin").alias("Margin (%)"),
        F.col("price_per_unit").alias("Price/Unit"),
        F.col("profit_per_unit").alias("Profit/Unit"),
    )


def frequency_histogram(metrics: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(metrics, "frequency", bins)


def avg_profit_histogram(metrics: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(metrics, "avg_profit_per_order", bins)


def frequency_chart(metrics: DataFrame, most: int = 40) -> DataFrame:
    """The frequency histogram with the round borders a chart shows."""
    return nice_histogram(metrics, "frequency", most)


def avg_profit_chart(metrics: DataFrame, most: int = 30) -> DataFrame:
    return nice_histogram(metrics, "avg_profit_per_order", most)
