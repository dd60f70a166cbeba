"""From raw documents to token ids: language, near duplicates, repeated passages, mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.llm.byte_bpe import decoded, encoded
from shelfmargin.llm.language_id import accepted
from shelfmargin.llm.mixing import mixed
from shelfmargin.llm.near_dedup import one_of_each
from shelfmargin.llm.substring_dedup import repeated_spans, without_spans
from shelfmargin.session import new_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or without a likely language."""
    return accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that an earlier document or place has; no document is dropped."""
    return without_spans(docs, repeated_spans(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them repeatedly, until each source has its share of words."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded_equal`` of every document."""
    ids = encoded(docs.select("doc_id", "lang", "source", "text"))
    return decoded(ids).select(
        "doc_id",
        "lang",
        "source",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("decoded_equal"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # most stages cannot be said in SQL; the tests hold brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
