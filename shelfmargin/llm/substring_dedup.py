"""Repeated passages, found as variable chunks with equal digests.

A gear hash rolls over the last 16 bytes. A position is a boundary when its hash is the least
within ``REACH`` bytes on both sides, moved on to the next white space, so chunks are whole
words and depend on nearby bytes only: text inserted before a passage does not move the
boundaries inside it. Where no white space follows within ``FAR`` bytes, as in Chinese or in data,
the boundary is the next start of a character. Chunks are about 45 bytes long. Chunks with equal
digests are equal text; the first by (doc_id, text hash, position) is kept, all others are repeats.

Consecutive repeats form a span. Spans with fewer than ``LEAST_WORDS`` words and ``LEAST_BYTES``
bytes are left alone, because a phrase of common words repeats by chance, the more so the larger the
corpus. East Asian characters and others of four bytes count as words. A passage of more than 50
words has whole chunks inside whatever stands around it; up to one chunk of some ten words at either
end of a passage stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import BYTE_KEYS, SPACE, column, cut, fresh, map_batches, slices, splitmix, utf8

REACH = 20
LEAST_WORDS = 20
LEAST_BYTES = 160
FAR = 64
_PAD = 64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the last ``width`` values at each place."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.concatenate((out[:step], np.minimum(out[step:], out[:-step])))
        have += step
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end inside rows (ends of rows are not listed), as places in ``data``."""
    lengths = np.diff(offsets)
    places = np.arange(len(data)) + np.repeat((np.arange(len(lengths)) + 1) * _PAD, lengths)
    rolled = np.zeros(len(data) + (len(lengths) + 1) * _PAD, np.uint64)
    rolled[places] = BYTE_KEYS[data]
    for step in (1, 2, 4, 8):
        moved = rolled[:-step] << np.uint64(4 * step)
        rolled[step:] += moved
    marks = np.full(len(rolled), _NONE)
    marks[places] = splitmix(rolled[places])
    least = _lowest(marks, REACH)
    before, after = least[places - 1], least[places + REACH]
    found = np.flatnonzero((marks[places] < before) & (marks[places] <= after)) + 1
    spaces = np.append(np.flatnonzero(SPACE[data]), len(data))
    ends = offsets[np.searchsorted(offsets, found - 1, "right")]
    blank = np.minimum(spaces[np.searchsorted(spaces, found)], ends)
    character = found.copy()
    for _ in range(3):  # a character has at most three bytes after its first
        inside = character < ends
        inside[inside] = (data[character[inside]] & 0xC0) == 0x80
        character[inside] += 1
    return np.unique(np.where(blank - found > FAR, character, blank))


def word_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte whether a word begins there; ``starts`` begin words of their own."""
    inside = ~SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = inside[:-1]
    after[starts] = False
    return (inside & ~after) | (data >= 0xE3)


def chunk_rows(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the chunks of one text."""
    data = np.frombuffer(text, np.uint8)
    ends = boundaries(data, np.array([0, len(data)]))
    edges = [0, *[e for e in ends.tolist() if e < len(data)], len(data)]
    return list(zip(edges[:-1], edges[1:]))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, start, stop, words, digest`` of each chunk that holds a word."""

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        data, offsets = utf8(batch.column(2))
        for first, last in slices(offsets):
            part, places = cut(data, offsets, first, last)
            if not len(part):
                continue
            edges = np.unique(np.concatenate((boundaries(part, places), places)))
            starts, stops = edges[:-1], edges[1:]
            words = np.add.reduceat(word_starts(part, starts).astype(np.int64), starts)
            worded = words > 0
            starts, stops, words = starts[worded], stops[worded], words[worded]
            owner = np.searchsorted(places, starts, "right") - 1
            held = part.tobytes()
            digests = [
                hashlib.blake2b(held[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), stops.tolist())
            ]
            index = pa.array(owner + first)
            yield [
                batch.column(0).take(index),
                batch.column(1).take(index),
                pa.array((starts - places[owner]).astype(np.int64)),
                pa.array((stops - places[owner]).astype(np.int64)),
                pa.array(words.astype(np.int32)),
                pa.array(digests, pa.binary()),
            ]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(source, rows, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, start long, stop long, words int, digest binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = LEAST_WORDS, least: int = LEAST_BYTES) -> DataFrame:
    """``doc_id, text_hash, start, stop, n_chunks, first_doc_ids``: repeated passages of each row, of at
    least ``words`` words or ``least`` bytes.

    ``start`` and ``stop`` are byte positions in the UTF-8 text; ``first_doc_ids`` are the
    documents that keep the first copy of the chunks. Rows equal in id and text count as one
    document. Null, empty and blank texts have no chunks; an id may be null (first in order).
    A chunk of any frequency is pre-aggregated; its rows meet its first place in a join that
    adaptive execution can split.
    """
    every = chunks(docs, doc_id, text)
    firsts = (
        every.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .select("digest", "first")
    )
    here = F.struct("doc_id", "text_hash", "start")
    repeats = (
        every.join(firsts, "digest")
        .where(here != F.col("first"))
        .groupBy("doc_id", "text_hash", "start", "stop")
        .agg(F.min("first.doc_id").alias("first_id"), F.max("words").alias("words"))
    )
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    opens = F.when(F.lag("stop").over(order) == F.col("start"), 0).otherwise(1)
    spans = (
        repeats.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(order))
        .groupBy("doc_id", "text_hash", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.count("*").alias("n_chunks"),
            F.sum("words").alias("words"),
            F.array_sort(F.collect_set("first_id")).alias("first_doc_ids"),
        )
    )
    enough = (F.col("words") >= words) | (F.col("stop") - F.col("start") >= least)
    return spans.where(enough).drop("span", "words")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; ``n_chars``, if there, follows the text."""
    text_hash, key, other, cuts = (fresh(docs, name) for name in ("text_hash", "span_id", "span_hash", "cuts"))
    lists = spans.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(other)).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts)
    )
    raw = F.encode("text", "UTF-8")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))), cuts)
    pieces = F.transform(
        edges,
        lambda span, k: F.decode(
            F.substring(
                raw,
                (span["stop"] + 1).cast("int"),
                F.coalesce(F.get(F.col(cuts), k)["start"] - span["stop"], F.octet_length("text").cast("long")).cast("int"),
            ),
            "UTF-8",
        ),
    )
    joined = docs.withColumn(text_hash, F.xxhash64("text")).join(
        lists, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(text_hash) == F.col(other)), "left"
    )
    cleaned = joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(pieces, "")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return cleaned.select(*[column(c) for c in docs.columns])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Spans of documents that repeat text kept elsewhere."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.select("doc_id", "start", "stop", "n_chunks", "first_doc_ids")
