"""Every analysis as ``name -> (spark, sf_dir) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.functions.dates import date_text
from shelfmargin.operators.checks import key_check, match_check
from shelfmargin.plans import discount, etl, facet_cube, trap
from shelfmargin.plans import hidden_value as hidden
from shelfmargin.session import cached, checkpointed, new_folder, removed, shuffles_removed, task_count
from shelfmargin.sources import testbed
from shelfmargin.sources.files import read_documents, read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]

FACET_CHOICE = {"year": [1996, 1998], "category": ["SMALL", "LARGE"], "region": ["ASIA", "EUROPE"]}
CUBE_CHOICES = {"all": {}, "chosen": FACET_CHOICE, "asia_1997": {"year": [1997], "region": ["ASIA"]}}
HIDDEN_CHOICE = {"category": "SMALL", "regions": ["ASIA", "EUROPE"]}
ANCHOR = 100
LINE_ORDER = ("ori_product_id", "quantity", "sales", "discount", "shipping_cost")

_RECAP_COLUMNS = (*etl.PRODUCT_KEY, *LINE_ORDER, "order_id", "order_date", "customer_id", "ship_mode", "ship_date", "profit")
_ITEM_COLUMNS = ("order_id", "product_id", "sales")
_HIDDEN_COLUMNS = ("order_id", "product_id", "location_id", "quantity", "profit", "sales")
_DISCOUNT_COLUMNS = (*_HIDDEN_COLUMNS, "discount", "order_date")


def _discount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discount.discount_lines(
        testbed.order_lines(spark, sf_dir, _DISCOUNT_COLUMNS),
        testbed.product(spark, sf_dir),
        testbed.location(spark, sf_dir),
    )


def _discount(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: analysis(_discount_lines(spark, sf_dir))


def _products(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return _discount(lambda lines: analysis(discount.product_summary(lines)))


def _cube(answer: Callable) -> Query:
    """``answer`` for three choices of filters, from one cube."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cube = checkpointed(facet_cube.facet_cube(_discount_lines(spark, sf_dir)))
        return facet_cube.for_choices(cube, CUBE_CHOICES, answer)

    return query


def _hidden_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden.hidden_base(
        testbed.order_lines(spark, sf_dir, _HIDDEN_COLUMNS),
        testbed.location(spark, sf_dir),
        testbed.product(spark, sf_dir),
        testbed.product_catalog(spark, sf_dir),
        task_count(testbed.line_count(spark, sf_dir)),
    )


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(hidden.unit_economics(_hidden_base(spark, sf_dir)))


def _with_limits(analysis: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        metrics = _metrics(spark, sf_dir)
        return analysis(metrics, hidden.thresholds(metrics))

    return query


def _segmented(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return _with_limits(lambda metrics, limits: analysis(hidden.segments(metrics, limits)))


def _hidden_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = hidden.filter_base(_hidden_base(spark, sf_dir), **HIDDEN_CHOICE)
    metrics = cached(hidden.unit_economics(base))
    return hidden.segments(metrics, hidden.thresholds(metrics))


def _traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trap.trap_products(
        testbed.order_lines(spark, sf_dir, _ITEM_COLUMNS), testbed.product(spark, sf_dir)
    )


def _companions(function: Callable, *arguments) -> Query:
    return lambda spark, sf_dir: function(
        testbed.order_lines(spark, sf_dir, _ITEM_COLUMNS),
        testbed.product(spark, sf_dir),
        *arguments,
    )


def _keyed(sales: DataFrame) -> DataFrame:
    return etl.attach_product(sales, etl.product_table(sales))


def _star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = testbed.sales_extract(spark, sf_dir)
    return etl.order_table(etl.attach_location(_keyed(sales), etl.location_table(sales)))


def _split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = testbed.listed_names(spark, sf_dir).withColumnRenamed("listed_name", "product_name")
    return etl.split_product_name(names).select(
        "product_id", "product_name", "full_name", "type", "variant"
    )


def _catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = testbed.sales_extract(spark, sf_dir)
    return etl.product_catalog(
        _keyed(sales.select(*etl.PRODUCT_KEY, "ori_product_id").distinct())
    )


def _exported(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``documents`` written as JSON arrays to the shared folder and read from there in slices."""
    folder = new_folder(spark, "export")
    write_table(documents, folder, "json_array")
    return read_documents(spark, folder, documents.schema, "json_array")


def _catalog_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_catalog(_catalog_documents(spark, sf_dir))


def _catalog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_catalog(_exported(spark, _catalog_documents(spark, sf_dir)))


def _flat_catalog(documents: DataFrame) -> DataFrame:
    return documents.select(
        "product_id",
        "part",
        "full_name",
        "category",
        "sub_category",
        F.explode("original_product_ids").alias("original_product_id"),
        F.try_element_at("attributes", F.lit("type")).alias("type"),
        F.try_element_at("attributes", F.lit("variant")).alias("variant"),
        F.size("attributes").alias("attribute_count"),
    )


def _staged_lines(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the extract's lines with their product key.

    Extract and keyed lines are staged once each, as in ``run_etl``, and what only a step before needs goes:
    its shuffle files, the product names and the extract.
    """
    extract, keyed = new_folder(spark, "extract"), new_folder(spark, "keyed")
    with shuffles_removed(spark):
        write_table(testbed.sales_extract(spark, sf_dir).select(*_RECAP_COLUMNS), extract, "parquet")
        write_table(_keyed(read_table(spark, extract)).drop(*etl.PRODUCT_KEY), keyed, "parquet")
    removed(spark, extract)
    return keyed


def _recap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.order_recap(read_table(spark, _staged_lines(spark, sf_dir)), LINE_ORDER)


def _recap_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recap_documents(spark, sf_dir).select(
        "order_id",
        "part",
        "order_date",
        "customer_id",
        F.size("products").alias("product_count"),
        "total_profit",
        "total_sales",
        "shipping.*",
    )


def _recap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_of_recap(_recap_documents(spark, sf_dir))


def _recap_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are staged too, so that the arrays, many times as large as the lines, never lie
    beside the lines and their shuffle."""
    keyed, staged = _staged_lines(spark, sf_dir), new_folder(spark, "recap")
    with shuffles_removed(spark):
        write_table(etl.order_recap(read_table(spark, keyed), LINE_ORDER), staged, "parquet")
        removed(spark, keyed)
        documents = _exported(spark, read_table(spark, staged))
    removed(spark, staged)
    return _lines_of_recap(documents)


def _lines_of_recap(documents: DataFrame) -> DataFrame:
    return documents.select(
        "order_id", "first_line_no", F.posexplode("products").alias("place", "product")
    ).select("order_id", (F.col("first_line_no") - 1 + F.col("place")).cast("int").alias("line_no"), "product.*")


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per shipping delay, negative delays included."""
    lines = testbed.order_lines(spark, sf_dir, ("order_date", "ship_date"))
    return lines.groupBy(F.datediff("ship_date", "order_date").alias("delay")).agg(
        F.count("*").alias("line_count"),
        date_text(F.min("order_date")).alias("first_order_date"),
    )


def _key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the keys and names of the dimensions and the catalogue are unique."""
    tables = {
        "customer": (testbed.customer(spark, sf_dir), "customer_id"),
        "customer_name": (testbed.customer(spark, sf_dir), "customer_name"),
        "product": (testbed.product(spark, sf_dir), "product_id"),
        "product_name": (testbed.product(spark, sf_dir), "product_name"),
        "catalog": (testbed.product_catalog(spark, sf_dir), "product_id"),
        "location": (testbed.location(spark, sf_dir), "location_id"),
    }
    return reduce(DataFrame.unionAll, [key_check(table, [key], name) for name, (table, key) in tables.items()])


def _match_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joining the order lines to their products by id and by name would do."""
    lines = testbed.order_lines(spark, sf_dir, ("order_id", "product_id"))
    named = testbed.sales_extract(spark, sf_dir).select("product_name")
    names = testbed.listed_names(spark, sf_dir).withColumnRenamed("listed_name", "product_name")
    known = testbed.product(spark, sf_dir)
    return (
        match_check(lines, known, ["product_id"], "product")
        .unionAll(match_check(named, names, ["product_name"], "listed_name"))
        .unionAll(match_check(named, known, ["product_name"], "product_name"))
    )


QUERIES: dict[str, Query] = {
    # checks of keys and joins
    "key_checks": _key_checks,
    "match_checks": _match_checks,
    # star tables and documents
    "dim_customer": lambda s, d: etl.customer_table(testbed.sales_extract(s, d)),
    "dim_product": lambda s, d: etl.product_table(testbed.sales_extract(s, d)),
    "dim_location": lambda s, d: etl.location_table(testbed.sales_extract(s, d)),
    "star_orders": _star_orders,
    "split_product_name": _split_names,
    "product_catalog_flat": _catalog_flat,
    "order_recap_flat": _recap_flat,
    "order_recap_lines": _recap_lines,
    "product_catalog_export": _catalog_export,
    "order_recap_export": _recap_export,
    "shipping_delays": _delays,
    # discount
    "discount_base": _discount_lines,
    "discount_filtered": _discount(lambda lines: discount.filter_lines(lines, FACET_CHOICE)),
    "facet_options": _discount(discount.filter_options),
    "facet_options_scoped": _discount(
        lambda lines: discount.filter_options(
            lines, FACET_CHOICE["category"], FACET_CHOICE["region"]
        )
    ),
    "discount_kpis": _discount(discount.kpis),
    "product_summary": _products(lambda p: p.orderBy(F.desc("sales"), "product_name")),
    "discount_range_summary": _discount(discount.range_summary),
    "category_avg_discount": _discount(discount.category_discount),
    "region_profit": _discount(discount.region_profit),
    "monthly_trend": _discount(discount.monthly_trend),
    "discount_correlation": _discount(discount.correlation),
    "discount_insights": _discount(discount.insights),
    "discount_conclusions": _discount(discount.conclusions),
    "scatter_sample": _discount(discount.scatter_sample),
    "top_products_by_sales": _products(lambda p: discount.top_products(p, "sales")),
    "top_products_by_profit": _products(lambda p: discount.top_products(p, "profit")),
    "low_profit_products": _products(discount.bottom_products),
    "high_sales_low_profit": _products(discount.high_sales_low_margin),
    "cube_kpis": _cube(facet_cube.kpis),
    "cube_product_summary": _cube(facet_cube.product_summary),
    "cube_range_summary": _cube(facet_cube.range_summary),
    "cube_category_discount": _cube(facet_cube.category_discount),
    "cube_region_profit": _cube(facet_cube.region_profit),
    "cube_monthly_trend": _cube(facet_cube.monthly_trend),
    "cube_correlation": _cube(facet_cube.correlation),
    # hidden value
    "hidden_options": lambda s, d: hidden.filter_options(_hidden_base(s, d)),
    "hidden_base": _hidden_base,
    "hidden_metrics": _metrics,
    "hidden_thresholds": _with_limits(lambda _, limits: limits),
    "hidden_segments": _segmented(lambda segmented: segmented),
    "hidden_filtered": _hidden_filtered,
    "hidden_by_total_profit": _with_limits(
        lambda m, t: hidden.select_hidden(m, t, "Total Profit")
    ),
    "hidden_by_margin": _with_limits(lambda m, t: hidden.select_hidden(m, t, "Profit Margin")),
    "hidden_by_avg_profit": _with_limits(
        lambda m, t: hidden.select_hidden(m, t, "avg_profit_per_order")
    ),
    "hidden_scatter": _segmented(hidden.scatter_points),
    "hidden_margin_scatter": _segmented(hidden.margin_points),
    "hidden_kpis": _with_limits(lambda m, t: hidden.kpis(hidden.segments(m, t), t)),
    "hidden_by_subcategory": _segmented(hidden.by_subcategory),
    "hidden_region_mix": _segmented(hidden.region_mix),
    "hidden_region_totals": _segmented(hidden.region_totals),
    "top_region_category": _segmented(hidden.top_regions),
    "attribute_coverage": _segmented(hidden.attribute_coverage),
    "attribute_missing": _segmented(hidden.missing_attributes),
    "hidden_by_type": _segmented(lambda s: hidden.by_attribute(s, "type")),
    "hidden_by_variant": _segmented(lambda s: hidden.by_attribute(s, "variant")),
    "hidden_top_attributes": _segmented(hidden.top_attributes),
    "hidden_type_pivot": _segmented(hidden.type_pivot),
    "hidden_drilldown": _segmented(hidden.drilldown),
    "hist_frequency": lambda s, d: hidden.frequency_histogram(_metrics(s, d)),
    "hist_avg_profit": lambda s, d: hidden.avg_profit_histogram(_metrics(s, d)),
    "chart_frequency": lambda s, d: hidden.frequency_chart(_metrics(s, d)),
    "chart_avg_profit": lambda s, d: hidden.avg_profit_chart(_metrics(s, d)),
    # trap products
    "order_totals": lambda s, d: trap.order_totals(testbed.order_lines(s, d, _ITEM_COLUMNS)),
    "order_basket_totals": lambda s, d: trap.basket_totals(
        testbed.order_lines(s, d, _ITEM_COLUMNS)
    ),
    "trap_products": _traps,
    "trap_top_frequency": lambda s, d: trap.top_frequency(_traps(s, d)),
    "bought_together": _companions(trap.bought_together, ANCHOR),
    "bought_together_top": _companions(trap.bought_together_top),
    "bought_together_every": _companions(trap.bought_together_every),
}
