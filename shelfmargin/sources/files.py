"""Sales extract, stored tables, document collections and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfmargin.sources.json_arrays import read_json_array, write_json_array

_MEASURE = T.DecimalType(18, 4)

# The extract's column titles, our names and their types, in file order.
SALES_COLUMNS = (
    ("Row ID", "row_id", T.LongType()),
    ("Order ID", "order_id", T.StringType()),
    ("Order Date", "order_date", T.StringType()),
    ("Ship Date", "ship_date", T.StringType()),
    ("Ship Mode", "ship_mode", T.StringType()),
    ("Customer ID", "customer_id", T.StringType()),
    ("Customer Name", "customer_name", T.StringType()),
    ("Segment", "segment", T.StringType()),
    ("City", "city", T.StringType()),
    ("State", "state", T.StringType()),
    ("Country", "country", T.StringType()),
    ("Postal Code", "postal_code", T.StringType()),
    ("Market", "market", T.StringType()),
    ("Region", "region", T.StringType()),
    ("Product ID", "ori_product_id", T.StringType()),
    ("Category", "category", T.StringType()),
    ("Sub-Category", "sub_category", T.StringType()),
    ("Product Name", "product_name", T.StringType()),
    ("Sales", "sales", _MEASURE),
    ("Quantity", "quantity", T.LongType()),
    ("Discount", "discount", _MEASURE),
    ("Profit", "profit", _MEASURE),
    ("Shipping Cost", "shipping_cost", _MEASURE),
    ("Order Priority", "order_priority", T.StringType()),
)

SALES_SCHEMA = T.StructType([T.StructField(title, kind) for title, _, kind in SALES_COLUMNS])

_TEXT = T.StringType()
_AMOUNT = T.DoubleType()

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("product_id", _TEXT),
        T.StructField("part", T.IntegerType()),
        T.StructField("full_name", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("sub_category", _TEXT),
        T.StructField("original_product_ids", T.ArrayType(_TEXT)),
        T.StructField("attributes", T.MapType(_TEXT, _TEXT)),
    ]
)

RECAP_SCHEMA = T.StructType(
    [
        T.StructField("order_id", _TEXT),
        T.StructField("part", T.IntegerType()),
        T.StructField("first_line_no", T.LongType()),
        T.StructField("order_date", _TEXT),
        T.StructField("customer_id", _TEXT),
        T.StructField(
            "products",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("product_id", _TEXT),
                        T.StructField("quantity", T.LongType()),
                        T.StructField("sales", _AMOUNT),
                        T.StructField("profit", _AMOUNT),
                        T.StructField("discount", _AMOUNT),
                    ]
                )
            ),
        ),
        T.StructField("total_profit", _AMOUNT),
        T.StructField("total_sales", _AMOUNT),
        T.StructField(
            "shipping",
            T.StructType(
                [
                    T.StructField("ship_mode", _TEXT),
                    T.StructField("ship_date", _TEXT),
                    T.StructField("delay", T.IntegerType()),
                    T.StructField("shipping_cost", _AMOUNT),
                ]
            ),
        ),
    ]
)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """The extract as stored: ``;`` between fields, decimal comma, titles as column names.

    The locale applies to decimal columns only, so all measures are read as decimals. A value
    that does not fit its type stops the job instead of turning into NULL.
    """
    return (
        spark.read.schema(SALES_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", ";")
        .option("locale", "de-DE")
        .option("encoding", "UTF-8")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def rename_sales(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({title: name for title, name, _ in SALES_COLUMNS})


def read_table(
    spark: SparkSession,
    name: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A stored table by path (Parquet, CSV, ...) or, for ``jdbc``, by database name.

    With a ``schema`` no job runs to look it up. For a large database table pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` among the options, so that many tasks read it.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt == "jdbc":
        return reader.option("dbtable", name).load()
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(name)


def read_documents(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A document collection without its ``_id``; one JSON object per line by default.

    ``json_array`` reads files that are one array each in many tasks (see ``json_arrays``).
    """
    if fmt == "json_array":
        return read_json_array(spark, path, schema, options).drop("_id")
    reader = spark.read.format(fmt).schema(schema).options(**(options or {}))
    return reader.load(path).drop("_id")


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """CSV with a header, JSON with one record per line or one array per file (``json_array``), or Parquet."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"unsupported data for {fmt}: {type(df).__name__}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        nested = [
            field.name
            for field in df.schema
            if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        ]
        if nested:
            raise ValueError(f"csv cannot hold nested columns: {', '.join(nested)}")
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "json_array":
        write_json_array(df, path, mode)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
