"""From one wide sales extract to star tables and nested documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.functions.dates import date_text, strict_date
from shelfmargin.functions.money import exact_sum, rounded
from shelfmargin.functions.names import attribute_map, padded_key, split_name
from shelfmargin.operators.checks import key_check, observed
from shelfmargin.operators.numbering import number_rows
from shelfmargin.operators.parts import ITEMS_PER_PART, collect_in_parts
from shelfmargin.sources.files import read_sales_csv, read_table, rename_sales, write_table
from shelfmargin.sources.testbed import ORDER_COLUMNS
from shelfmargin.sources.versions import committed

PRODUCT_KEY = ("product_name", "category", "sub_category")
OUTPUTS = {
    "customer": "csv",
    "product": "csv",
    "location": "csv",
    "orders": "csv",
    "product_catalog": "json",
    "order_recap": "json",
}
LOCATION_KEY = ("city", "state", "country", "region", "market", "postal_code")


def parse_dates(sales: DataFrame) -> DataFrame:
    return sales.withColumns(
        {name: strict_date(F.col(name)) for name in ("order_date", "ship_date")}
    )


def split_product_name(sales: DataFrame) -> DataFrame:
    """Adds ``full_name``, ``type`` and ``variant``."""
    return sales.select("*", *split_name(F.col("product_name")))


def customer_table(sales: DataFrame) -> DataFrame:
    return sales.select("customer_id", "customer_name", "segment").distinct()


def _keyed(rows: DataFrame, natural_key: Sequence[str], name: str, width: int) -> DataFrame:
    """Distinct natural keys with their place in sorted order as a text key."""
    numbered = number_rows(
        rows.select(*natural_key).distinct(), [F.col(column) for column in natural_key], name
    )
    return numbered.select(padded_key(F.col(name), width).alias(name), *natural_key)


def product_table(sales: DataFrame) -> DataFrame:
    return _keyed(sales, PRODUCT_KEY, "product_id", 5)


def location_table(sales: DataFrame) -> DataFrame:
    return _keyed(sales, LOCATION_KEY, "location_id", 4)


def _attach(sales: DataFrame, table: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """Left join on columns where NULL matches NULL."""
    side = table.select(key, *[F.col(column).alias(f"{key}_{column}") for column in on])
    same = reduce(
        lambda left, right: left & right,
        [F.col(column).eqNullSafe(F.col(f"{key}_{column}")) for column in on],
    )
    return sales.join(side, same, "left").select(*sales.columns, key)


def attach_product(
    sales: DataFrame, products: DataFrame, on: Sequence[str] = PRODUCT_KEY
) -> DataFrame:
    """Adds ``product_id``. Joining on fewer columns than the natural key repeats lines whose
    name belongs to several products."""
    return _attach(sales, products, "product_id", on)


def attach_location(sales: DataFrame, locations: DataFrame) -> DataFrame:
    return _attach(sales, locations, "location_id", LOCATION_KEY)


def order_table(sales: DataFrame) -> DataFrame:
    """The fact table: one row per order line, keys attached."""
    return sales.select(*ORDER_COLUMNS)


def product_catalog(sales: DataFrame, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """One document per product with its source ids and known attributes.

    ``sales`` needs the product key. Names are split after the duplicates are gone. Every
    product follows one rule: its ids in order, ``items_per_part`` to a document, as ``part`` 0,
    1, ... with the same head.
    """
    heads = sales.select("product_id", *PRODUCT_KEY).distinct()
    heads = split_product_name(heads).drop("product_name").distinct()
    ids = sales.select("product_id", "ori_product_id").distinct().where(F.col("product_id").isNotNull())
    lists = collect_in_parts(ids, "product_id", ["ori_product_id"], "ids", items_per_part)
    return lists.join(heads, "product_id").select(
        "product_id",
        "part",
        "full_name",
        "category",
        "sub_category",
        F.transform("ids", lambda item: item["ori_product_id"].cast("string")).alias(
            "original_product_ids"
        ),
        attribute_map().alias("attributes"),
    )


def order_recap(
    sales: DataFrame, line_order: Sequence[str] = ("row_id",), items_per_part: int = ITEMS_PER_PART
) -> DataFrame:
    """Documents of each order: head, products and shipping.

    The head takes date, customer and shipping from the first line by ``line_order``, which
    also sorts ``products``. Every order follows one rule: ``items_per_part`` lines to a
    document, as ``part`` 0, 1, ...; ``first_line_no`` (from 1) is the place of a document's
    first product in the order. Head, totals and shipping stand in part 0 alone, so sums over
    documents are sums over orders.
    """
    item_fields = ("product_id", "quantity", "sales", "profit", "discount")
    first_line = F.struct(*line_order, "order_date", "customer_id", "ship_mode", "ship_date")
    totals = {
        "first": F.min(first_line),
        "total_profit": rounded(exact_sum("profit"), 3),
        "total_sales": rounded(exact_sum("sales"), 3),
        "total_shipping_cost": rounded(exact_sum("shipping_cost", 6), 3),
    }
    fields = list(dict.fromkeys([*line_order, *item_fields]))
    docs = collect_in_parts(sales, "order_id", fields, "lines", items_per_part, totals)

    def item(line: Column) -> Column:
        return F.struct(
            line["product_id"].alias("product_id"),
            line["quantity"].alias("quantity"),
            *[line[name].cast("double").alias(name) for name in item_fields[2:]],
        )

    return docs.select(
        "order_id",
        "part",
        F.col("first_no").alias("first_line_no"),
        date_text(F.col("first.order_date")).alias("order_date"),
        F.col("first.customer_id").alias("customer_id"),
        F.transform("lines", item).alias("products"),
        "total_profit",
        "total_sales",
        F.when(F.col("part") == 0, F.struct(
            F.col("first.ship_mode").alias("ship_mode"),
            date_text(F.col("first.ship_date")).alias("ship_date"),
            F.datediff("first.ship_date", "first.order_date").alias("delay"),
            F.col("total_shipping_cost").alias("shipping_cost"),
        )).alias("shipping"),
    )


def run_etl(spark: SparkSession, extract_path: str, out_dir: str) -> dict[str, dict[str, int]]:
    """Read the extract and write all six outputs under ``out_dir``.

    The parsed extract is staged as Parquet once, so that each output reads only the
    columns it needs instead of parsing the text again. Returns counts gathered on the way: lines
    without order or product name, lines that found no key, lines that a join added, and
    dimension keys that several rows have.
    """
    parsed = parse_dates(rename_sales(read_sales_csv(spark, extract_path)))
    parsed, lines = observed(
        parsed,
        "sales",
        without_order=F.col("order_id").isNull(),
        without_product=F.col("product_name").isNull(),
        shipped_before_order=F.col("ship_date") < F.col("order_date"),
    )
    write_table(parsed, f"{out_dir}/staged/sales", "parquet")
    sales = read_table(spark, f"{out_dir}/staged/sales")

    products = product_table(sales)
    locations = location_table(sales)
    write_table(customer_table(sales), f"{out_dir}/customer", "csv")
    write_table(products, f"{out_dir}/product", "csv")
    write_table(locations, f"{out_dir}/location", "csv")

    write_table(attach_product(sales, products), f"{out_dir}/staged/sales_with_product", "parquet")
    with_product = read_table(spark, f"{out_dir}/staged/sales_with_product")
    facts, matched = observed(
        attach_location(with_product, locations),
        "orders",
        without_product=F.col("product_id").isNull(),
        without_location=F.col("location_id").isNull(),
    )
    write_table(order_table(facts), f"{out_dir}/orders", "csv")
    write_table(product_catalog(with_product), f"{out_dir}/product_catalog", "json")
    write_table(order_recap(with_product), f"{out_dir}/order_recap", "json")

    people = read_table(spark, f"{out_dir}/customer", "csv", {"header": "true"})
    keys = {"customer": (people, ["customer_id"]), "product_name": (products, ["product_name"])}
    checks = {name: key_check(table, key, name).drop("check").first().asDict() for name, (table, key) in keys.items()}
    return {
        "sales": dict(lines.get),
        "orders": {**matched.get, "added": matched.get["rows"] - lines.get["rows"]},
        **checks,
    }


def publish_etl(spark: SparkSession, extract_path: str, out_dir: str) -> dict[str, Any]:
    """``run_etl`` into a new version under ``out_dir``; all six outputs appear together or none does.

    Returns the manifest with the counts as ``metrics``; ``sources.versions`` reads the outputs.
    """
    return committed(spark, out_dir, OUTPUTS, lambda folder: run_etl(spark, extract_path, folder))
