"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmargin.llm import byte_bpe, context_tree, exact_topk, language_id, license_scan, mixing, near_dedup
from shelfmargin.llm import periodic_runs, quality_rules, secret_scan, substring_dedup, warc_archive
from shelfmargin.session import new_folder


LONG = "word " * 30_000
ODD_ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "é日本 😀 x", None, "b"),
    (5, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (5, "another text under the same id", "en", None),
    (None, "no id at all here", "en", "b"),
    (None, "no id at all here", "en", "b"),
    (6, "1234 !!", "en", "b"),
]

PER_ROW = {
    "mix": lambda docs: mixing.mix(mixing.sized(docs)),
    "language": language_id.identify,
    "bpe": byte_bpe.round_trip,
    "near": lambda docs: near_dedup.near_duplicates(docs)[0],
    "quality": quality_rules.judged,
    "score": lambda docs: context_tree.score_texts(docs, docs),
    "license": license_scan.scan,
    "secrets": secret_scan.scan,
    "runs": periodic_runs.periodic_runs,
}
STAGES = {
    "accepted": language_id.accepted,
    "one_of_each": near_dedup.one_of_each,
    "cut": lambda docs: substring_dedup.without_spans(docs, substring_dedup.repeated_spans(docs)),
    "mixed": mixing.mixed,
    "encoded": lambda docs: byte_bpe.encoded(docs).drop("ids"),
}
CLASHING = (
    "text_hash score size value ids component kept label tokens words line lang_pred n_words copies salt word n class "
    "start stop digest held group"
).split()


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(documents, name):
    assert PER_ROW[name](documents(ODD_ROWS)).count() == len(ODD_ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(documents, name):
    assert PER_ROW[name](documents([])).count() == 0


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES])
def test_clashing_columns(documents, name):
    docs = documents(ODD_ROWS[:4] + ODD_ROWS[-1:])
    clash = docs.withColumns({c: F.lit("x") for c in CLASHING})
    operator = {**PER_ROW, **STAGES}[name]
    assert operator(clash).count() == operator(docs).count()


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES])
def test_typed_columns(documents, name):
    """Extra columns of any type and name, and ids that are decimals."""
    docs = documents(ODD_ROWS[:4] + ODD_ROWS[-1:])
    typed = docs.withColumns(
        {
            "doc_id": F.col("doc_id").cast("decimal(10,0)"),
            "a,b": F.lit(1),
            "_value": F.lit("x"),
            "with.dot": F.struct(F.lit(1).alias("a"), F.lit("y").alias("b")),
            "money": F.lit("2.50").cast("decimal(10,2)"),
            "map": F.create_map(F.lit("k"), F.array(F.lit(1))),
        }
    )
    operator = {**PER_ROW, **STAGES}[name]
    assert operator(typed).count() == operator(docs).count()
    assert operator(typed.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(documents, name):
    docs = documents(ODD_ROWS)
    out = STAGES[name](docs)
    assert out.dtypes == docs.dtypes
    assert out.count() <= 3 * len(ODD_ROWS)
    assert STAGES[name](documents([])).count() == 0


def test_archive_edges(spark):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, "u\r\nv", ""), (3, None, "x"), (3, None, "x"), (None, "w", "x"), (None, "w", "y")],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("clash"))
    folder = new_folder(spark, "warc")
    warc_archive.write(pages, folder)
    got = sorted(
        ((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in warc_archive.read(spark, folder).collect()),
        key=str,
    )
    assert got == sorted(
        [
            (1, "revisit", 2, b""), (2, "response", None, b""), (3, "response", None, b"x"),
            (3, "response", None, b"x"), (None, "revisit", 3, b"x"), (None, "response", None, b"y"),
        ],
        key=str,
    )
    empty = new_folder(spark, "warc")
    warc_archive.write(pages.limit(0), empty)
    assert warc_archive.read(spark, empty).count() == 0


def test_archive_detects_damage(spark):
    folder = new_folder(spark, "warc")
    warc_archive.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    other = new_folder(spark, "warc")
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.encode(F.lit("z"), "UTF-8")).write.parquet(
        f"{other}/payloads"
    )
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc_archive.read(spark, other).collect()


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    got = [tuple(r) for r in exact_topk.top_k(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 2048), (20, 1, 0, 2048), (20, 2, 1, 2048), (20, 3, 2, 2048),
    ]
    assert exact_topk.top_k(table.limit(0), F.col("id") % 20 == 0).count() == 0
