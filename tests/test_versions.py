"""Outputs that are committed together, and the counts gathered on the way."""

from __future__ import annotations

from pathlib import Path

import pytest
from test_etl import LINES, _extract

from shelfmargin.operators.checks import key_check, match_check, observed, require_unique
from shelfmargin.plans import etl
from shelfmargin.sources import versions
from shelfmargin.sources.files import CATALOG_SCHEMA


def test_outputs_appear_together(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    first = etl.publish_etl(spark, _extract(tmp_path), out)
    assert first["number"] == 1 and set(first["outputs"]) == set(etl.OUTPUTS)
    assert versions.read_committed(spark, out, "orders").count() == 5
    assert versions.read_committed(spark, out, "product_catalog", CATALOG_SCHEMA).count() == 4

    def broken(sales):
        raise RuntimeError("fifth output")

    more = _extract(tmp_path, [*LINES, LINES[3].replace("4;O-3", "6;O-4", 1)])
    with monkeypatch.context() as patch:
        patch.setattr(etl, "product_catalog", broken)
        with pytest.raises(RuntimeError, match="fifth"):
            etl.publish_etl(spark, more, out)
    assert versions.manifest(spark, out)["folder"] == first["folder"]
    assert versions.read_committed(spark, out, "orders").count() == 5
    assert [f"{out}/versions/{path.name}" for path in Path(out, "versions").iterdir()] == [first["folder"]]

    second = etl.publish_etl(spark, more, out)
    assert second["number"] == 2 and versions.read_committed(spark, out, "orders").count() == 6
    assert versions.read_committed(spark, out, "orders", number=1).count() == 5
    assert versions.drop_versions(spark, out, keep=1) == 1
    assert versions.read_committed(spark, out, "orders").count() == 6
    with pytest.raises(ValueError, match="no such version"):
        versions.manifest(spark, out, 1)


def test_an_output_that_is_missing_is_not_committed(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="b is not complete"):
        versions.committed(spark, out, {"a": "parquet", "b": "parquet"}, lambda at: spark.range(2).write.parquet(f"{at}/a"))
    with pytest.raises(ValueError, match="no such version"):
        versions.manifest(spark, out)
    assert not list(Path(out, "versions").glob("*"))


def test_a_number_is_committed_once(spark, tmp_path):
    out = str(tmp_path / "out")

    def slow(folder):
        spark.range(1).write.parquet(f"{folder}/a")
        if not Path(out, "commits").exists():  # another run ends first
            versions.committed(spark, out, {"a": "parquet"}, lambda at: spark.range(7).write.parquet(f"{at}/a"))

    with pytest.raises(Exception, match="(?i)exist"):
        versions.committed(spark, out, {"a": "parquet"}, slow)
    assert versions.read_committed(spark, out, "a").count() == 7
    assert len(list(Path(out, "versions").iterdir())) == 1


def test_counts_of_the_job(spark, tmp_path):
    lines = [*LINES, LINES[0].replace("1;O-1;", "6;;", 1)]
    counts = etl.run_etl(spark, _extract(tmp_path, lines), str(tmp_path / "out"))
    assert counts["sales"] == {"rows": 6, "without_order": 1, "without_product": 0, "shipped_before_order": 1}
    assert counts["orders"] == {"rows": 6, "without_product": 0, "without_location": 0, "added": 0}
    assert counts["product_name"] == {"rows": 4, "null_keys": 0, "repeated_keys": 1, "extra_rows": 1}
    assert counts["customer"] == {"rows": 2, "null_keys": 0, "repeated_keys": 0, "extra_rows": 0}


def test_key_and_match_checks(spark):
    keyed = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f")], "k int, v string")
    assert tuple(key_check(keyed, ["k"], "x").first()) == ("x", 6, 2, 1, 2)
    assert tuple(key_check(keyed, ["k", "v"], "x").first()) == ("x", 6, 2, 0, 0)
    assert tuple(key_check(keyed.limit(0), ["k"], "x").first()) == ("x", 0, 0, 0, 0)
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    assert tuple(match_check(rows, keyed, ["k"], "m").first()) == ("m", 5, 2, 2, 4)
    assert rows.join(keyed, "k", "left").count() == 5 + 4
    assert tuple(match_check(rows.limit(0), keyed, ["k"], "m").first()) == ("m", 0, 0, 0, 0)
    assert require_unique(keyed, ["k", "v"], "x") is keyed
    with pytest.raises(ValueError, match=r"x: 1 keys \(k\) stand in 2 rows too many"):
        require_unique(keyed, ["k"], "x")


def test_observed_counts_nulls_as_not_met(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    watched, watch = observed(rows, "w", large=rows.k > 2)
    watched.collect()
    assert watch.get == {"rows": 3, "large": 1}
