"""Periodic runs against a brute-force search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmargin.llm.periodic_runs import numbered, op13_periodic_runs, openings, periodic_runs, runs_of


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            stretch = words[i - q : j]
            smaller = any(stretch[d:] == stretch[:-d] for d in range(1, q))
            if len(stretch) >= max(6, 4 * q) and not smaller:
                out.append((i - q, len(stretch), q))
            i = j
    return sorted(out, key=lambda run: (run[0], run[2]))


def kept_words(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_of_small_alphabets():
    rng, found = random.Random(2), 0
    for _ in range(3000):
        words = []
        while len(words) < rng.randint(0, 70):
            words += [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 10))] * rng.randint(1, 6)
        expected = brute(words)
        found += len(expected)
        assert runs_of(np.array(words, np.int64)) == expected, words
    assert found > 1000


def test_frequent_words_open_few_diagonals():
    assert runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    ids = np.random.default_rng(1).integers(0, 2, 50_000)
    assert len(openings(ids)) < 50_000 * 16
    tail = np.concatenate([np.arange(1000), np.tile(np.arange(3000, 13_000), 5), np.arange(1000)])
    assert runs_of(tail) == [(1000, 50_000, 10_000)]


def test_whole_texts(documents):
    texts = [None, "", " \t\n", "a", "a a a a a a", "A a A a A a A a", "x é é é é é é y", "a b " * 3, "a b " * 4 + "c " * 6, "ab ab ab ab ab ab ab"]
    rows = sorted(periodic_runs(documents(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    for row, text in zip(rows, texts):
        words = (text or "").encode().split()
        assert [tuple(r) for r in row.runs] == brute(words)
        assert row.n_words == len(words)
        assert row.collapsed.encode() == b" ".join(kept_words(words, brute(words)))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))) for k in range(400)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for row in op13_periodic_runs(spark, str(tmp_path)).collect():
        words = planted(row.doc_id, dict(rows)[row.doc_id])
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert tuple(row)[1:5] == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()


def test_numbers_tell_words_apart():
    assert numbered([b"a", b"b", b"a"]).tolist() == [0, 1, 0]


@pytest.mark.parametrize("name", ["runs", "n_words", "collapsed", "whole_text", "a,b"])
def test_clashing_and_typed_columns(documents, name):
    docs = documents([(1, "a " * 8), (None, None)]).withColumns(
        {name: F.lit("x"), "money": F.lit("1.50").cast("decimal(10,2)"), "pair": F.struct(F.lit(1).alias("a")), "map": F.create_map(F.lit("k"), F.lit(2))}
    )
    out = periodic_runs(docs)
    row = out.where("doc_id = 1").first()
    assert [tuple(r) for r in row.runs] == [(0, 8, 1)] and row.collapsed == "a" and str(row.money) == "1.50" and row.map == {"k": 2}
    assert out.count() == 2 and periodic_runs(docs.limit(0)).count() == 0
