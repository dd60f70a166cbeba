"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Letters are folded to lower case, every run of other characters counts as one blank, and
n-grams of one to ``LONGEST`` characters are hashed into ``BUCKETS`` features. Training counts
are added up per task and then per (language, feature); the log-probability matrix has at
most ``MOST_LANGUAGES`` x ``BUCKETS`` numbers, whatever the corpus, and is broadcast. Batches
are scored sparsely: one gather per n-gram and one sum per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmargin.llm.arrays import column, cut, fresh, giving_back, map_batches, powers, ready, slices, splitmix, utf8

BUCKETS = 1 << 15
LONGEST = 3
MOST_LANGUAGES = 256
UNKNOWN = "und"
LEAST_SCORE = 0.5
_BLANK = 32


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of some rows, the row of each, and which rows have a letter."""
    rows = len(offsets) - 1
    joined = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # characters before each row
    folded = _folds()[joined]
    owner = np.repeat(np.arange(rows), np.diff(heads))
    keep = np.ones(len(folded), bool)
    blank = folded == _BLANK
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    lettered = np.zeros(rows, bool)
    lettered[owner[folded != _BLANK]] = True
    grams, owners = [], []
    for n in range(1, LONGEST + 1):
        if len(folded) < n:
            break
        mixed = np.full(len(folded) - n + 1, n, np.uint64)
        for k in range(n):
            mixed += folded[k : len(mixed) + k] * powers(16)[k + 1]
        whole = owner[: len(mixed)] == owner[n - 1 :]
        grams.append((splitmix(mixed[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[: len(mixed)][whole])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    return np.concatenate(grams), np.concatenate(owners), lettered


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix ``[feature, language]`` of log probabilities.

    Every row with text and language counts; add-one smoothing; languages are equally likely
    beforehand. No labelled row gives an empty model. More than ``MOST_LANGUAGES`` labels
    raise ``ValueError``, because the matrix is broadcast.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            places = {name: k for k, name in enumerate(dict.fromkeys(names))}
            rows = np.array([places[name] for name in names], np.int64)
            data, offsets = utf8(batch.column(1))
            for first, last in slices(offsets):
                grams, owner, _ = features(*cut(data, offsets, first, last))
                label = rows[first:last][owner]
                for name, k in places.items():
                    totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                    totals[name] += np.bincount(grams[label == k], minlength=BUCKETS)
        for name, counts in totals.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(counts[found])],
                ["lang", "feature", "held"],
            )

    partial = ready(known).mapInArrow(giving_back(count), "lang string, feature long, held long")
    summed = partial.groupBy("lang", "feature").agg(F.sum("held").alias("held"))
    counts: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator(prefetchPartitions=True):
        if row.lang not in counts:
            if len(counts) == MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            counts[row.lang] = np.zeros(BUCKETS)
        counts[row.lang][row.feature] = row.held
    names = sorted(counts)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    table = np.stack([counts[name] for name in names], axis=1) + 1
    return names, np.log(table / table.sum(axis=0))


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the prediction.

    A text that is null or has no letter, and any text under an empty model, is ``und`` with
    score 0. On a tie the first language in order wins. Same-named columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    count = len(others)

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        labels, table = shared.value
        data, offsets = utf8(batch.column(count))
        for first, last in slices(offsets):
            grams, owner, lettered = features(*cut(data, offsets, first, last))
            if labels:
                total = np.stack(
                    [np.bincount(owner, table[grams, k], last - first) for k in range(len(labels))], axis=1
                )
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                lettered = np.zeros(last - first, bool)
                best, score = np.zeros(last - first, int), np.zeros(last - first)
            yield [
                *[batch.column(k).slice(first, last - first) for k in range(count)],
                pa.array([labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], pa.string()),
                pa.array(np.where(lettered, score, 0.0)),
            ]

    value = fresh(docs, "value")
    taken = docs.select(*[column(c) for c in others], F.col(text).alias(value))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_batches(taken, rows, T.StructType([*taken.schema.fields[:-1], *made]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document stays out of training: crc32 of its id as text is 0 modulo 5 (null: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learnt from the documents that are not held out."""
    names, matrix = train(docs.where(~held_out()))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, names, matrix).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that have no letter or no language more likely than all others together."""
    names, matrix = train(docs.where(~held_out()))
    kept = predict(docs, names, matrix)
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return kept.where(good).select(*[column(c) for c in docs.columns])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
