"""The test tables seen as retail tables.

Every key in these tables has its partner row, so a reader that needs no column of a
partner table leaves that join out; the scan then reads only the columns it uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.functions.names import attribute_map, split_name
from shelfmargin.sources.files import read_table

ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "product_id",
    "location_id",
    "sales",
    "quantity",
    "discount",
    "profit",
    "shipping_cost",
    "order_date",
    "ship_date",
    "ship_mode",
    "order_priority",
)

# Columns of the test tables.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

_FROM_CUSTOMER = {"location_id", "customer_name", "segment"}
_FROM_ORDERS = {"customer_id", "order_date", "order_priority"} | _FROM_CUSTOMER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema=_SCHEMAS[name])


def order_lines(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = ORDER_COLUMNS
) -> DataFrame:
    """The ``orders`` table (one row per line) with the given columns.

    Prices have two decimals and discounts are whole percents, so amounts are computed as
    whole ten-thousandths and divided once, after the joins, so that lines travel as few numbers.
    Orders meet their customers before the lines, which are then dealt by order and by product alone.
    """
    lines = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "cast(l_quantity AS bigint) AS quantity",
        "cast(rint(l_discount * 100) AS bigint) * 5 AS percent_off",
        "cast(rint(l_extendedprice * 100) AS bigint) AS price_units",
        "cast(rint(l_tax * 100) AS bigint) AS tax_units",
        "cast(l_shipdate AS date) AS ship_date",
        "l_returnflag AS ship_mode",
    )
    if _FROM_ORDERS & set(columns):
        orders = _table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "cast(o_orderdate AS date) AS order_date",
            "o_orderpriority AS order_priority",
        )
        if "location_id" in columns:
            places = _table(spark, sf_dir, "customer").selectExpr(
                "c_custkey AS customer_id", "c_nationkey AS location_id"
            )
            orders = orders.join(places, "customer_id")
        if {"customer_name", "segment"} & set(columns):
            orders = orders.join(customer(spark, sf_dir), "customer_id")
        lines = lines.join(orders, "order_id")
    if "profit" in columns:
        part = _table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS product_id", "cast(rint(p_retailprice * 100) AS bigint) AS cost_units"
        )
        lines = lines.join(part, "product_id").withColumn(
            "profit", F.expr("(price_units * (100 - percent_off) - quantity * cost_units * 100) / 10000")
        )
    return lines.selectExpr(
        "*",
        "percent_off / 100 AS discount",
        "price_units * (100 - percent_off) / 10000 AS sales",
        "price_units * (100 - percent_off) * tax_units / 1000000 AS shipping_cost",
    ).select(*columns)


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the line table; Parquet's footers tell, no column is read."""
    return _table(spark, sf_dir, "lineitem").count()


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "p_type AS category",
        "p_brand AS sub_category",
    )


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations at any scale. Spark takes the size of a join for a product and may not see that it is
    small; the lines would then be dealt by nation, to 25 tasks at most."""
    nation = _table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    region = _table(spark, sf_dir, "region")
    places = nation.join(region, "r_regionkey").selectExpr(
        "n_nationkey AS location_id", "n_name AS country", "r_name AS region"
    )
    return F.broadcast(places)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_name", "c_mktsegment AS segment"
    )


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, type and size in one text: one, two or three comma parts."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "concat_ws(', ', p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END,"
        " CASE WHEN p_size % 3 = 2 THEN concat('size ', p_size) END) AS listed_name",
        "p_type AS category",
        "p_brand AS sub_category",
    )


def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue documents, one per part, without the source ids no analysis reads."""
    return (
        listed_names(spark, sf_dir)
        .select("product_id", "category", "sub_category", *split_name(F.col("listed_name")))
        .select("product_id", "full_name", "category", "sub_category", attribute_map().alias("attributes"))
    )


def sales_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide extract as the ETL job sees it after renaming.

    Cities and states are not in the test tables: the country's name stands for the city,
    the region's for the market, and state and postal code are NULL on every row.
    """
    lines = order_lines(spark, sf_dir, (*ORDER_COLUMNS, "customer_name", "segment"))
    names = listed_names(spark, sf_dir)
    places = location(spark, sf_dir)
    return (
        lines.join(names, "product_id")
        .join(places, "location_id")
        .select(
            F.col("order_id"),
            "order_date",
            "ship_date",
            "ship_mode",
            "customer_id",
            "customer_name",
            "segment",
            F.col("country").alias("city"),
            F.lit(None).cast("string").alias("state"),
            "country",
            F.lit(None).cast("string").alias("postal_code"),
            F.col("region").alias("market"),
            "region",
            F.col("product_id").alias("ori_product_id"),
            "category",
            "sub_category",
            F.col("listed_name").alias("product_name"),
            "sales",
            "quantity",
            "discount",
            "profit",
            "shipping_cost",
            "order_priority",
        )
    )
