from __future__ import annotations

import datetime
import glob
import json
import os
import time
from decimal import Decimal
from pathlib import Path

import pytest

from shelfmargin import registry, session
from shelfmargin.plans import etl
from shelfmargin.sources import files, testbed

TITLES = ";".join(title for title, _, _ in files.SALES_COLUMNS)
LINES = [
    "1;O-1;05-11-2014;09-11-2014;First;C-1;Ann;Home;Oslo;;Norway;;EU;North;S-1;Tech;Phones;Phone, black, 64 GB;1.234,56;2;0,1;-3,5;12,25;High",
    "2;O-1;05-11-2014;10-11-2014;Second;C-1;Ann;Home;Oslo;;Norway;;EU;North;S-2;Tech;Phones;Cable, red;10,5;1;0;4,25;1,5;Low",
    "3;O-2;06-11-2014;05-11-2014;First;C-2;Bob;Office;Oslo;;Norway;;EU;North;S-3;Office;Paper;Cable, red;7;3;0,2;1;0;Low",
    "4;O-3;07-11-2014;07-11-2014;First;C-2;Bob;Office;Bergen;West;Norway;5003;EU;North;S-4;Office;Paper;Folder;7;3;0,2;1;0;Low",
    "5;O-3;07-11-2014;07-11-2014;First;C-2;Bob;Office;Bergen;West;Norway;5003;EU;North;S-9;Tech;Phones;Cable, red;8;1;0;2;0;Low",
]


def _extract(tmp_path, lines=LINES):
    path = tmp_path / "sales.csv"
    path.write_text("\n".join([TITLES, *lines]) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def sales(spark, tmp_path):
    return etl.parse_dates(files.rename_sales(files.read_sales_csv(spark, _extract(tmp_path))))


def test_localized_numbers(sales):
    row = sales.where("row_id = 1").first()
    assert row["sales"] == Decimal("1234.5600") and row["profit"] == Decimal("-3.5000")
    assert row["postal_code"] is None and row["quantity"] == 2
    assert row["order_date"] == datetime.date(2014, 11, 5)
    assert len(sales.columns) == 24


def test_bad_number_and_bad_date_fail(spark, tmp_path):
    bad = [LINES[0].replace("1.234,56", "many")]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_sales_csv(spark, _extract(tmp_path, bad)).collect()
    late = [LINES[0].replace("05-11-2014", "2014-11-05")]
    df = etl.parse_dates(files.rename_sales(files.read_sales_csv(spark, _extract(tmp_path, late))))
    with pytest.raises(Exception, match="(?i)parse"):
        df.collect()


def test_keys_follow_sorted_natural_keys(sales):
    products = [tuple(r) for r in etl.product_table(sales).orderBy("product_id").collect()]
    assert products == [
        ("00001", "Cable, red", "Office", "Paper"),
        ("00002", "Cable, red", "Tech", "Phones"),
        ("00003", "Folder", "Office", "Paper"),
        ("00004", "Phone, black, 64 GB", "Tech", "Phones"),
    ]
    locations = etl.location_table(sales).orderBy("location_id").collect()
    assert [(r["location_id"], r["city"], r["postal_code"]) for r in locations] == [
        ("0001", "Bergen", "5003"),
        ("0002", "Oslo", None),
    ]


def test_null_postal_codes_match(sales):
    keyed = etl.attach_location(sales, etl.location_table(sales))
    assert keyed.count() == 5 and keyed.where("location_id IS NULL").count() == 0


def test_name_only_join_repeats_lines(sales):
    products = etl.product_table(sales)
    assert etl.attach_product(sales, products).count() == 5
    fanned = etl.attach_product(sales, products, on=["product_name"])
    assert fanned.count() == 8


def test_catalog_documents(sales):
    keyed = etl.attach_product(sales, etl.product_table(sales))
    docs = {r["product_id"]: r.asDict() for r in etl.product_catalog(keyed).collect()}
    assert docs["00002"]["original_product_ids"] == ["S-2", "S-9"]
    assert docs["00002"]["attributes"] == {"type": "red"}
    assert docs["00003"]["attributes"] == {} and docs["00003"]["part"] == 0
    assert docs["00004"]["attributes"] == {"type": "black", "variant": "64 GB"}
    assert docs["00004"]["full_name"] == "Phone"


def test_order_documents(sales):
    keyed = etl.attach_product(sales, etl.product_table(sales))
    docs = {r["order_id"]: r.asDict(recursive=True) for r in etl.order_recap(keyed).collect()}
    first = docs["O-1"]
    assert (first["order_date"], first["customer_id"]) == ("05-11-2014", "C-1")
    assert (first["total_profit"], first["total_sales"]) == (0.75, 1245.06)
    assert first["shipping"] == {
        "ship_mode": "First",
        "ship_date": "09-11-2014",
        "delay": 4,
        "shipping_cost": 13.75,
    }
    assert [p["product_id"] for p in first["products"]] == ["00004", "00002"]
    assert docs["O-2"]["shipping"]["delay"] == -1


def test_a_large_order_is_split_into_parts(spark, sales):
    keyed = etl.attach_product(sales, etl.product_table(sales))
    big = keyed.where("row_id = 2").crossJoin(spark.range(3000).select("id"))
    big = big.withColumn("row_id", big["id"] % 1500).drop("id")
    docs = etl.order_recap(keyed.unionByName(big), items_per_part=200).orderBy("part").collect()
    parts = [doc for doc in docs if doc["order_id"] == "O-1"]
    assert [len(doc["products"]) for doc in parts] == [200] * 15 + [2]
    assert [doc["first_line_no"] for doc in parts] == [200 * part + 1 for part in range(16)]
    assert [doc["part"] for doc in parts if doc["total_sales"] is not None] == [0]
    assert [doc["part"] for doc in parts if doc["shipping"] is not None] == [0]
    together = [p["product_id"] for doc in parts for p in doc["products"]]
    whole = etl.order_recap(keyed.unionByName(big)).where("order_id = 'O-1'").first()
    assert together == [p["product_id"] for p in whole["products"]]
    assert [len(doc["products"]) for doc in docs if doc["order_id"] == "O-3"] == [2]


def test_whole_job(spark, tmp_path):
    out = str(tmp_path / "out")
    etl.run_etl(spark, _extract(tmp_path), out)
    orders = spark.read.option("header", True).csv(f"{out}/orders")
    assert orders.columns == list(etl.ORDER_COLUMNS) and orders.count() == 5
    assert spark.read.option("header", True).csv(f"{out}/customer").count() == 2
    catalog = files.read_documents(spark, f"{out}/product_catalog", files.CATALOG_SCHEMA)
    assert catalog.count() == 4
    assert catalog.where("product_id = '00004'").first()["attributes"] == {
        "type": "black",
        "variant": "64 GB",
    }
    recap = files.read_documents(spark, f"{out}/order_recap", files.RECAP_SCHEMA)
    assert sorted(r["order_id"] for r in recap.collect()) == ["O-1", "O-2", "O-3"]
    one = json.loads(
        next(
            line
            for file in Path(out, "order_recap").glob("*.json")
            for line in file.read_text().splitlines()
        )
    )
    assert {"order_id", "products", "shipping"} <= set(one)


def test_documents_lose_their_database_id(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text('{"_id": "x", "product_id": "1", "attributes": {"type": "t"}}\n')
    schema = "_id string, product_id string, attributes map<string,string>"
    assert files.read_documents(spark, str(path), schema).columns == ["product_id", "attributes"]


def test_sinks_reject_what_they_cannot_write(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError, match="unknown format"):
        files.write_table(df, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError, match="unsupported data"):
        files.write_table([1], str(tmp_path / "x"), "json")
    with pytest.raises(ValueError, match="nested"):
        files.write_table(df.selectExpr("array(id) AS ids"), str(tmp_path / "x"), "csv")


def test_testbed_keys_have_partners(spark, sf_dir):
    from shelfmargin.sources import testbed

    narrow = testbed.order_lines(spark, sf_dir, ("order_id", "product_id", "sales"))
    assert narrow.count() == testbed.order_lines(spark, sf_dir).count()


def test_lines_are_dealt_once_for_documents_and_heads(spark, sales, tmp_path):
    files.write_table(etl.attach_product(sales, etl.product_table(sales)), str(tmp_path / "keyed"), "parquet")
    docs = etl.order_recap(files.read_table(spark, str(tmp_path / "keyed")))
    assert docs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert docs.where("order_id = 'O-1'").first()["total_sales"] == 1245.06


def _star(spark, folder):
    """Three orders of five lines over two parts, as star tables."""
    day = datetime.datetime(1996, 1, 2)
    rows = {
        "region": [(0, "ASIA")],
        "nation": [(0, "CHINA", 0)],
        "customer": [(0, "Ann", 0, 1.0, "AUTO")],
        "part": [(0, "bolt", "Brand#1", "SMALL", 3, 900.0), (1, "ring", "Brand#2", "LARGE", 4, 901.5)],
        "orders": [(k, 0, "O", 1.0, day, "1-URGENT") for k in range(3)],
        "lineitem": [(k % 3, k % 2, 0, k, 1.0 + k, 1000.0 + k, 0.1, 0.02, "N", "O", day) for k in range(5)],
    }
    for name, table in rows.items():
        spark.createDataFrame(table, testbed._SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _held(spark):
    """Shuffle files on disk, and staged tables in the shared folder."""
    disks = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shared = session.shared_folder(spark).removeprefix("file:")
    staged = {path for name in ("extract", "keyed", "recap", "export") for path in glob.glob(f"{shared}/{name}-*")}
    return {path for disk in disks for path in glob.glob(f"{disk}/*/shuffle_*.data")}, staged


def _left(spark, query, folder):
    """What a query's result waits on: its shuffle files and the kinds of its staged tables."""
    shuffles, staged = _held(spark)
    result = registry.QUERIES[query](spark, folder)
    for _ in range(50):  # files go soon after their action
        if not _held(spark)[0] - shuffles:
            break
        time.sleep(0.1)
    after = _held(spark)
    return result, after[0] - shuffles, sorted(os.path.basename(path).split("-")[0] for path in after[1] - staged)


def test_recap_keeps_no_file_of_earlier_steps(spark, tmp_path):
    result, shuffles, staged = _left(spark, "order_recap_flat", _star(spark, tmp_path))
    assert not shuffles and staged == ["keyed"]
    rows = {r["order_id"]: r for r in result.collect()}
    assert [rows[k]["product_count"] for k in range(3)] == [2, 2, 1]
    assert rows[2]["total_sales"] == 501.0 and rows[2]["shipping_cost"] == 10.02


def test_recap_export_keeps_only_the_arrays(spark, tmp_path):
    result, shuffles, staged = _left(spark, "order_recap_export", _star(spark, tmp_path))
    assert not shuffles and staged == ["export"]
    found = sorted((r["order_id"], r["line_no"], r["quantity"]) for r in result.collect())
    assert found == [(0, 0, 1), (0, 1, 4), (1, 0, 5), (1, 1, 2), (2, 0, 3)]
