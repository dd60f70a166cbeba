from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfmargin.functions import choice, dates, labels, money, names, ranges


def _one(df):
    return tuple(df.first())


def test_name_parts(spark):
    rows = [
        ("a",),
        ("a, b",),
        ("a, b, c",),
        ("a,b,c,d",),
        ("a,,b",),
        ("\ta\t, b ",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "name string").select(*names.split_name(F.col("name")))
    assert [tuple(row) for row in df.collect()] == [
        ("a", None, None),
        ("a", "b", None),
        ("a", "b", "c"),
        ("a", "b", "c"),
        ("a", "", "b"),
        ("a", "b", None),
        (None, None, None),
    ]


def test_attributes(spark):
    df = spark.createDataFrame(
        [("x", None), (None, "y"), (None, None), ("", "y")], "type string, variant string"
    )
    maps = df.select(names.attribute_map().alias("attributes"))
    assert [row[0] for row in maps.collect()] == [
        {"type": "x"},
        {"variant": "y"},
        {},
        {"type": "", "variant": "y"},
    ]
    known = maps.unionAll(spark.createDataFrame([(None,)], "attributes map<string,string>"))
    read = known.select(names.attribute("type"), names.attribute("variant")).collect()
    assert tuple(read[0]) == ("x", "not have")
    assert tuple(read[4]) == ("not have", "not have")


def test_padded_key_keeps_long_numbers(spark):
    df = spark.createDataFrame([(1,), (1_234_567,)], "n bigint")
    assert [row[0] for row in df.select(names.padded_key(F.col("n"), 5)).collect()] == [
        "00001",
        "1234567",
    ]


def test_dates(spark):
    good = spark.createDataFrame([("05-11-2014",)], "d string")
    day = datetime.date(2014, 11, 5)
    assert _one(good.select(dates.strict_date(F.col("d")))) == (day,)
    assert _one(
        good.select(dates.month_bucket(dates.strict_date(F.col("d"))), dates.date_text(F.lit(day)))
    ) == ("2014-11", "05-11-2014")
    bad = spark.createDataFrame([("2014-13-45",), ("2014-11-05",)], "d string")
    with pytest.raises(Exception, match="(?i)parse"):
        bad.select(dates.strict_date(F.col("d"))).collect()
    assert [row[0] for row in bad.select(dates.lenient_date(bad, "d")).collect()] == [None, day]


def test_discount_ranges(spark):
    values = [-0.01, -0.0001, 0.0, 0.1, 0.1001, 0.2, 0.3, 0.4, 0.41, 1.0, 1.01, None]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    numbers = df.select(ranges.discount_range_no(F.col("d")).alias("n"))
    assert [row[0] for row in numbers.collect()] == [None, None, 1, 1, 2, 2, 3, 4, 5, 5, None, None]
    text = numbers.select(ranges.discount_range_label(F.col("n"))).collect()
    assert text[2][0] == "0-10%" and text[9][0] == "40%+" and text[0][0] is None


def test_rounding_is_half_even_on_the_scaled_double(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (0.125,), (-0.125,)], "x double")
    assert [row[0] for row in df.select(money.rounded(F.col("x"), 2)).collect()] == [
        1.0,
        2.5,
        0.12,
        -0.12,
    ]


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(10_000).select(F.lit(0.1).alias("x"))
    assert _one(df.repartition(7).agg(money.exact_sum("x"), money.exact_mean("x"))) == (1000.0, 0.1)


def test_exact_sum_of_decimals(spark):
    df = spark.sql("SELECT cast('1234.5678' AS decimal(18,4)) AS x UNION ALL SELECT 0.0001")
    assert _one(df.agg(money.exact_sum("x"))) == (1234.5679,)


def test_zero_divisors(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert _one(
        df.select(
            money.ratio(F.col("a"), F.col("b")), money.percent_or_zero(F.col("a"), F.col("b"))
        )
    ) == (None, 0.0)


def test_ties_go_to_the_smallest_key(spark):
    df = spark.createDataFrame(
        [("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", 1.0), ("e", None)], "k string, v double"
    )
    best = df.agg(
        choice.key_of_max(F.col("k"), F.col("v")), choice.key_of_min(F.col("k"), F.col("v"))
    )
    assert _one(best) == ("a", "c")


def test_labels(spark):
    df = spark.createDataFrame([(1234.5,), (-5.0,)], "x double")
    x = F.col("x")
    assert [
        tuple(row)
        for row in df.select(
            labels.dollars(x), labels.dollars(x, 2), labels.percent_text(x), labels.thousands(x)
        ).collect()
    ] == [("$1,234", "$1,234.50", "1234.5%", "1.2K"), ("$-5", "$-5.00", "-5.0%", "-0.0K")]
