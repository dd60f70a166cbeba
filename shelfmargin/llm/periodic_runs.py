"""Runs of a text: stretches of words that repeat with a small period, found online.

A diagonal is a lag q with the number of words, up to the present one, that equal the word q
before them. Words are read once, in order. Earlier occurrences of a word open diagonals, each
later word lengthens the active ones or ends them, and a diagonal that ends after enough words
is emitted as a run at once.

A frequent word has too many earlier occurrences to open a diagonal for each. A run of period q
needs ``max(6 - q, 3 * q)`` equal words on its diagonal, so an occurrence counts only with the
words that follow it: five for q < 4, else the least power of two above q. Of the occurrences with
equal following words the nearest alone can be the smallest period there (two periods of one
stretch would make their greatest common divisor a period). So each word opens at most one
diagonal per octave of lags, and n words cost O(n log n) whatever they are; no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmargin.llm.arrays import column, fresh, map_batches
from shelfmargin.llm.quality_rules import words_of

LEAST_WORDS = 6
LEAST_PERIODS = 4
_SHORT = 5  # words that every run has on its diagonal

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def _named(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for pairs, equal for equal pairs; places with an equal earlier pair, and how far the
    nearest one lies back."""
    keys = left * (int(right.max(initial=0)) + 1) + right
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~again)])
    places = order[1:][again]
    return names, places, places - order[:-1][again]


def openings(ids: np.ndarray) -> list[tuple[int, int]]:
    """(word, lag) in order of words: where diagonals begin that may become runs."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    two = _named(ids[:-1], ids[1:])[0]
    names = _named(two[:-2], two[2:])[0]  # four words from each place on
    width, least, found = 4, 1, []
    ahead = _named(names[:-1], names[1:])  # five words
    while len(ahead[1]):
        places, lags = ahead[1:]
        most = 2 * least if least > 1 else 4
        fits = (lags >= least) & (lags < most)
        places, lags = places[fits], lags[fits]
        before = places - 1 - lags
        begins = (before < 0) | (ids[places - 1] != ids[before])
        found += zip(places[begins].tolist(), lags[begins].tolist())
        least, step = most, width
        if LEAST_PERIODS * least > n:
            break
        width *= 2
        ahead = _named(names[:-step], names[step:])
        names = ahead[0]
    return sorted(found)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    begin = openings(ids)
    if not begin:
        return []
    words, n = ids.tolist(), len(ids)
    runs, active, k, i = [], {}, 0, 0
    while active or k < len(begin):
        if not active:
            i = begin[k][0]
        for lag, matched in list(active.items()):
            if i < n and words[i] == words[i - lag]:
                active[lag] = matched + 1
                continue
            del active[lag]
            length = matched + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                runs.append((i - length, length, lag))
        while k < len(begin) and begin[k][0] == i:
            active[begin[k][1]] = 1
            k += 1
        i += 1
    return sorted(runs, key=lambda run: (run[0], run[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(word, len(known)) for word in words], np.int64)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those a run has after its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (array of ``start, length, period``, by start, then
    period) and ``collapsed`` (string); same-named columns go.

    Words are what ASCII white space separates. Null, empty and blank texts have no word, no run and an
    empty ``collapsed``. A text is handled whole in its row: nothing is shuffled, repeated rows
    and ids are rows of their own, and an empty table gives an empty one.
    """
    made = ("n_words", "runs", "collapsed")
    others = [field for field in docs.schema if field.name.lower() not in made]
    held = fresh(docs, "whole_text")
    sent = docs.select(*[column(f.name) for f in others], column(text).cast("string").alias(held))
    schema = T.StructType(
        [
            *others,
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in RUN.names]))

    def find(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        counts, found, kept = [], [], []
        for value in batch.column(len(others)):
            words = (value.as_py() or "").encode().split()
            runs = runs_of(numbered(words))
            counts.append(len(words))
            found.append([dict(zip(RUN.names, run)) for run in runs])
            kept.append(collapsed(words, runs).decode())
        yield [
            *batch.columns[: len(others)],
            pa.array(counts, pa.int64()),
            pa.array(found, run_type),
            pa.array(kept, pa.string()),
        ]

    return map_batches(sent, find, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole products; the first on a tie.

    Null without runs.
    """
    none = F.lit(None).cast(RUN)
    return F.aggregate(
        runs,
        none,
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the periodic tail that the checksum of the id plants in one text of ten.

    With h the checksum and g = h div 10: if h % 10 is 0, the words from a = g % n on repeat the
    first 1 + (n - a) div (3 + g % 8) of them. A null id plants nothing.
    """
    checksum = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("checksum div 10")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        first = g % n
        period = F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8))
        place = lambda k: F.when(k < first, k).otherwise(first + (k - first) % period)
        repeated = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.get(words, place(k).cast("int"))
        )
        return F.when(n > 0, F.array_join(repeated, " "))

    # an array of one value binds the words, so that a text is split once
    planted = F.get(F.transform(F.array(words_of(F.col("text"))), tail), 0)
    return docs.select("doc_id", "text", checksum.alias("checksum")).select(
        "doc_id", F.when(F.col("checksum") % 10 == 0, planted).otherwise(F.col("text")).alias("text")
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, its strongest run, and digests of all runs and of the collapsed text."""
    docs = with_repeated_tail(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    line = F.transform("runs", lambda run: F.concat(F.array_join(F.array(*[run[c].cast("string") for c in RUN.names]), ","), F.lit("\n")))
    found = periodic_runs(docs).select("*", strongest(F.col("runs")).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in RUN.names],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


# Pairs of equal five-word windows make the diagonals here; a run has at least five equal words.
OP13_SQL = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS o,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) AS h
    FROM documents
), tails AS (
    SELECT *, h // 10 AS g, (h // 10) % len(o) AS a FROM split
), texts AS (
    SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN list_transform(range(0, len(o)), lambda i:
        o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(o) - a) // (3 + g % 8)) END]) ELSE o END AS w
    FROM tails
), grams AS (
    SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS five
    FROM (SELECT r, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS i FROM texts)
), matches AS (
    SELECT b.r, b.i - a.i AS lag, b.i FROM grams a JOIN grams b ON a.r = b.r AND a.five = b.five AND a.i < b.i
    WHERE 4 * (b.i - a.i) <= b.n
), stretches AS (
    SELECT r, lag AS period, min(i) - lag AS start, count(*) + 4 + lag AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS part FROM matches) GROUP BY r, lag, part
), runs AS (
    SELECT * FROM stretches WHERE length >= greatest(6, 4 * period)
    QUALIFY row_number() OVER (PARTITION BY r, start, length ORDER BY period) = 1
), dropped AS (
    SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed
    FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts) ANTI JOIN dropped USING (r, i) GROUP BY r
), lists AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY r
), best AS (
    SELECT r, start, length, period FROM runs
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
    CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN lists USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
