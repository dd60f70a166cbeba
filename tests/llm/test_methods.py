"""Each operator against a brute-force version, a round trip or held-out accuracy."""

from __future__ import annotations

import base64
import glob
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmargin import session
from shelfmargin.llm import arrays, byte_bpe, components, context_tree, exact_topk, language_id, license_scan, mixing, near_dedup
from shelfmargin.llm import substring_dedup
from shelfmargin.llm.queries import QUERIES


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """(doc_id, n_shingles, component, kept) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.fixture(scope="module")
def rows(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def test_near_duplicates_on_table(spark, sf_dir, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op4_near_dedup"](spark, sf_dir).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows])


def test_near_duplicates_in_hot_groups(documents):
    """Near copies with edits on both sides of the threshold, around a passage that all share."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    table = []
    for i in range(150):
        text = base[:60] if i % 3 == 0 else base[:]
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        own = [f"y{i}-{k}" for k in range(rng.choice([0, 0, 10, 30]))]
        table.append((i, " ".join(text + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(table))[0].collect()}
    assert got == brute_components(table)


def test_sets_only_of_classes_to_compare(documents, monkeypatch):
    """A set is larger than its text: it stays unmade where a text only shares a block with another."""
    apart = [(i, " ".join(f"p{block % 60}-{k}" for block in (i, i + 1) for k in range(30))) for i in range(60)]
    near = [(100 + i, " ".join(f"q{k}" for k in range(100 + i))) for i in range(2)]
    made, laid = {}, near_dedup._laid_down

    def counted(df, folder, name):
        table = laid(df, folder, name)
        made[name] = (table.count(), table.columns)
        return table

    monkeypatch.setattr(near_dedup, "_laid_down", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(apart + near))[0].collect()}
    assert got == brute_components(apart + near)
    listed = {name: rows for name, (rows, columns) in made.items() if "members" in columns and "value" not in columns}
    assert made["shared"][0] > 60 and sum(listed.values()) == 2


def test_shuffles_go_with_their_action(spark):
    """Not when the driver collects its garbage: near dedup would hold those of all its steps."""
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)

    def held():
        return {path for folder in folders for path in glob.glob(f"{folder}/*/shuffle_*.data")}

    old = held()
    with session.shuffles_removed(spark):
        rows = session.checkpointed(spark.range(1000).repartition(7, "id"))
        assert rows.count() == 1000
    for _ in range(50):
        if not held() - old:
            break
        time.sleep(0.1)
    assert not held() - old
    assert rows.distinct().count() == 1000 and spark.conf.get(setting, None) == before


def test_workers_give_back_memory(documents, monkeypatch):
    """Arrow keeps what its arrays had: idle workers would hold it beside those at work."""
    calls, wrapped = [], []

    class Pool:
        def release_unused(self):
            calls.append(len(calls))

    def failing(batches):
        yield next(batches)
        raise ValueError

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(arrays.pa, "default_memory_pool", Pool)
        assert list(arrays.giving_back(lambda batches: batches)(iter([1, 2]))) == [1, 2] and len(calls) == 1
        with pytest.raises(ValueError):
            list(arrays.giving_back(failing)(iter([1])))
        assert len(calls) == 2

    def noted(function):
        wrapped.append(function)
        return given_back(function)

    given_back = arrays.giving_back
    for module in (arrays, language_id, near_dedup):
        monkeypatch.setattr(module, "giving_back", noted)
    table = documents([(k, "a b c") for k in range(6)])
    near_dedup._bucket_counts(near_dedup.sketches(table, "text", ()).select("sketch"), 4)
    assert len(wrapped) == 2
    assert language_id.train(table)[0] == ["en"] and len(wrapped) == 3


def test_overlap_bounds():
    assert near_dedup.least_overlap(4) == 3
    assert near_dedup.least_overlap(40) == 30
    assert 20 <= near_dedup.least_overlap(10_000) < 48
    for n in range(1, 400):
        assert near_dedup.least_overlap(n) <= math.ceil(0.75 * min(n, 64))


def test_parity_maps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n, other in ((1, 0), (40, 6), (300, 80), (5000, 900)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[other:], rng.integers(0, 1 << 63, other).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
        maps = [near_dedup.parity_map(x).view(np.uint8) for x in (a, b)]
        differing = int(np.unpackbits(maps[0] ^ maps[1]).sum())
        assert differing <= len(np.setxor1d(a, b))
        assert len(maps[0]) == 8 * len(near_dedup.PARITY)


def test_bpe_equals_library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日", "1", "²", "!", "\x1c", " ", "\x85", "don't", "😀", "́", "x" * 70]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == library.encode_ordinary(long)


def test_bpe_query(spark, sf_dir, rows):
    codec = byte_bpe._codec("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf_dir).collect()}
    for row in rows[:100]:
        ids = codec.encode(row["text"])
        assert got[row["doc_id"]].n_tokens == len(ids) // 4
        assert got[row["doc_id"]].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[row["doc_id"]].decoded_sha256 == hashlib.sha256(row["text"].encode()).hexdigest()


def test_language_held_out_accuracy(spark, sf_dir, rows):
    lang = {r["doc_id"]: r["lang"] for r in rows}
    got = QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_brute_force(documents):
    table = [(1, "abc Abd", "en", "a"), (3, "été", "fr", "a"), (4, "ab", None, "a")]
    names, matrix = language_id.train(documents(table))
    counts = {}
    for _, text, lang, _ in table[:2]:
        folded = text.lower()
        grams = [folded[k : k + n] for n in (1, 2, 3) for k in range(len(folded) - n + 1)]
        counts[lang] = len(grams)
    assert names == ["en", "fr"]
    total = np.exp(matrix).sum(axis=0)
    assert np.allclose(total, 1)
    for k, lang in enumerate(names):
        smallest = np.exp(matrix[:, k].min())
        assert np.isclose(smallest, 1 / (counts[lang] + language_id.BUCKETS))


def test_chunks_resist_insertions():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(51))
    for _ in range(200):
        texts = [f"{' '.join(word() for _ in range(rng.randint(0, 40)))} {passage} {' '.join(word() for _ in range(9))}".encode() for _ in range(2)]
        cut = [{t[a:b] for a, b in substring_dedup.chunk_rows(t)} for t in texts]
        assert len(b" ".join(cut[0] & cut[1]).split()) >= substring_dedup.LEAST_WORDS
        for text in texts:
            assert b"".join(text[a:b] for a, b in substring_dedup.chunk_rows(text)) == text


def test_repeated_spans_brute_force(spark, sf_dir, rows):
    seen, expected = set(), {}
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        text, run, spans = row["text"].encode(), None, []
        for a, b in substring_dedup.chunk_rows(text):
            piece = text[a:b]
            repeat = bool(piece.strip()) and piece in seen
            seen.add(piece)
            if repeat and run and run[1] == a:
                run[1] = b
            elif repeat:
                run = [a, b]
                spans.append(run)
        words = {(a, b): sum(len(text[x:y].split()) for x, y in substring_dedup.chunk_rows(text) if a <= x and y <= b) for a, b in spans}
        expected[row["doc_id"]] = [
            tuple(s) for s in spans
            if s[1] - s[0] >= substring_dedup.LEAST_BYTES or words[tuple(s)] >= substring_dedup.LEAST_WORDS
        ]
    got = {i: [] for i in expected}
    for r in QUERIES["op6_substring_dedup"](spark, sf_dir).orderBy("start").collect():
        got[r.doc_id].append((r.start, r.stop))
    assert got == expected
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cleaned = substring_dedup.without_spans(docs, substring_dedup.repeated_spans(docs)).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in rows}
    for r in cleaned:
        text, at, left = texts[r.doc_id], 0, b""
        for a, b in expected[r.doc_id]:
            left, at = left + text[at:a], b
        assert r.text.encode() == left + text[at:]


def test_passages_without_white_space(documents):
    """Shared text of another script, and of data on one line, inside different text."""
    rng = random.Random(6)
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    data = lambda n: "".join(rng.choice("0123456789abcdef,:{}") for _ in range(n))
    shared, packed = chinese(90), data(400)
    table = [(1, chinese(40) + shared + chinese(30)), (2, chinese(55) + shared + chinese(3)), (3, data(70) + packed), (4, data(9) + packed + data(50)), (5, chinese(200))]
    got = {}
    for r in substring_dedup.repeated_spans(documents(table)).collect():
        got.setdefault(r.doc_id, []).append(table[r.doc_id - 1][1].encode()[r.start : r.stop].decode())
    assert set(got) == {2, 4} and all(len(v) == 1 for v in got.values())
    assert got[2][0] in shared and len(got[2][0]) >= 45 and got[4][0] in packed and len(got[4][0]) >= 160
    for _, text in table:
        assert b"".join(text.encode()[a:b] for a, b in substring_dedup.chunk_rows(text.encode())) == text.encode()


def test_mix_near_targets(spark, sf_dir, rows):
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, target, size = Counter(), {}, Counter()
    table = QUERIES["op1_pareto_mix"](spark, sf_dir).collect()
    for r in table:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        size[source[r.doc_id]] += r.size
    assert math.isclose(sum(target.values()), sum(size.values()))
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    classes = {}  # copies of the documents of a source with equally long sizes: drawn ones differ by one
    for r in table:
        if r.size:
            classes.setdefault((source[r.doc_id], r.size.bit_length()), []).append((r.taken // r.size, r.size))
    unused = {}
    for (s, _), held in classes.items():
        low = min(held)[0]
        if low < max(held)[0]:
            unused[s] = min(unused.get(s, math.inf), min(size for copies, size in held if copies == low))
    for s in target:
        off = abs(taken[s] - target[s])
        assert off <= 1 or off <= 0.02 * target[s] or off < unused.get(s, math.inf), (s, taken[s], target[s])


def brute_weight(items, depth):
    """ln of the weighted probability of (bytes before, nearest first; decision) pairs, by recursion."""
    ones = sum(decision for _, decision in items)
    zeros = len(items) - ones
    own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(len(items) + 1) - math.log(math.pi)
    if depth == context_tree.DEPTH:
        return own
    children = {}
    for context, decision in items:
        children.setdefault(context[depth], []).append((context, decision))
    return math.log(0.5) + np.logaddexp(own, sum(brute_weight(child, depth + 1) for child in children.values()))


def brute_decisions(text):
    """(bits of the byte so far, bytes before it, next bit) of every decision of a text."""
    end, depth = bytes([context_tree.END]), context_tree.DEPTH
    line = end * depth + re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode() + end
    for place in range(depth, len(line)):
        bits = format(line[place], "08b")
        for k in range(8):
            yield bits[:k], line[place - depth : place][::-1], int(bits[k])


def test_context_tree_by_sequence_probability(documents):
    """Each decision's chance is P(training, decision) / P(training), also for contexts never seen."""
    learnt = ["Abracadabra abracadabra", "the cat sat on the mat", "a cat\u00e9 the CAT", "", "zzzzzzzzzz"]
    asked = [*learnt, None, "the mat sat", "\u4e2d\u6587 text", "abracadabra zzz", "quite other words 0123", "zzzzz"]
    held = {}
    for text in learnt:
        for path, context, decision in brute_decisions(text):
            held.setdefault(path, []).append((context, decision))
    whole = {path: brute_weight(items, 0) for path, items in held.items()}
    table = documents(list(enumerate(asked)))
    got = {r.doc_id: r.score for r in context_tree.score_texts(table, documents(list(enumerate(learnt)))).collect()}
    for doc_id, text in enumerate(asked):
        expected = 0.0
        for path, context, decision in brute_decisions(text):
            items = held.get(path, [])
            expected += brute_weight([*items, (context, decision)], 0) - whole.get(path, 0.0)
        assert math.isclose(got[doc_id], expected / math.log(10), rel_tol=1e-5), text


def test_rare_grams_have_the_same_scores(documents, monkeypatch):
    """Grams that are not broadcast meet their log probability in the join."""
    table = documents([(k, f"word {k % 3} and word {k % 5} of {k}") for k in range(12)] + [(3, "word 0 and")] * 2)
    plain = sorted((r.doc_id, round(r.score, 4)) for r in context_tree.score_texts(table, table).collect())
    monkeypatch.setattr(context_tree, "COMMON_GRAMS", 20)
    assert sorted((r.doc_id, round(r.score, 4)) for r in context_tree.score_texts(table, table).collect()) == plain


def test_components_read_each_edge_by_one_task(spark):
    """A union of both directions would have twice the tasks of the edges."""
    rng = np.random.default_rng(5)
    pairs = [*((k, k + 1) for k in range(100, 140)), *((500, k) for k in range(501, 560)), *rng.integers(600, 700, (60, 2)).tolist(), (1, None), (2, 2)]
    links = spark.createDataFrame([tuple(pair) for pair in pairs], "a long, b long")
    expected = {k: k for pair in pairs if None not in pair and pair[0] != pair[1] for k in pair}
    for _ in expected:
        for x, y in pairs:
            if x in expected and y in expected:
                expected[x] = expected[y] = min(expected[x], expected[y])
    assert sorted(map(tuple, components.components(links, "a", "b").collect())) == sorted(expected.items())
    edges = spark.range(9).selectExpr("id + 1 as u", "id as v")
    for large in (True, False):
        assert "Union" not in components._star(edges, large)._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_counts_are_small(spark):
    """The driver gets 8 bytes a bucket and broadcasts 4."""
    sets = spark.createDataFrame([(np.array([3, 3 + 16, 5], np.uint64).tobytes(),), (np.array([3], np.uint64).tobytes(),)], "members binary")
    counts = near_dedup._bucket_counts(sets, 4)
    assert counts.itemsize == 4 and counts.tolist() == [0, 0, 0, 3, 0, 1] + [0] * 10


def test_bucket_counts_of_many_batches(spark):
    """Counts leave a task in batches of ``COUNTS_SENT`` buckets; each comes once and in its place."""
    values = np.arange(0, 5 * near_dedup.COUNTS_SENT, 3, dtype=np.uint64)
    sets = spark.createDataFrame([(values.tobytes(),), (values[:9].tobytes(),)], "members binary")
    counts = near_dedup._bucket_counts(sets, 20)
    expected = np.zeros(1 << 20)
    np.add.at(expected, values.astype(np.int64), 1)
    np.add.at(expected, values[:9].astype(np.int64), 1)
    assert counts.tolist() == expected.tolist()


def test_grams_are_never_broadcast(spark):
    """However small Spark takes them for: it does not see that each byte of a text is a gram."""
    small = spark.range(20)
    levels = [small.select(F.col("id").alias("at"), F.lit(0.5).alias("chance"))] * (context_tree.DEPTH + 1)
    grams = small.select(F.col("id").alias("gram"), F.lit(1).alias("held"))
    for made in (context_tree.learnt_logs(grams, levels), context_tree.other_logs(grams, levels)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 7.9, 8.0, 100.5, 1e9]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in table.select(context_tree.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in values], rtol=1e-10, atol=1e-10)


def test_gram_table_finds_every_gram():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000))
    table = context_tree.GramTable(grams, np.arange(len(grams)).astype(np.float32))
    logs, other = table.find(np.concatenate([grams, grams + 1, grams[::-1]]))
    n = len(grams)
    assert (logs[:n] == np.arange(n)).all() and (logs[2 * n :] == np.arange(n)[::-1]).all()
    assert set(other.tolist()) == {n + k for k in range(n) if grams[k] + 1 not in set(grams.tolist())}


def test_scores(spark, sf_dir, rows):
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*words(r["text"]), "end"])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in QUERIES["op9_lm_score"](spark, sf_dir).collect()}
    for r in rows:
        tokens, row = [*words(r["text"]), "end"], got[r["doc_id"]]
        assert (row.n_tokens, row.train_tokens) == (len(tokens), n)
        assert row.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(row.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert row.score < 0
    assert np.mean([r.bits_per_byte for r in got.values() if r.held_out]) < 2.5


def test_top_k_brute_force(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids = np.array(table["vec_id"].to_pylist())
    whole = np.floor(np.array(table["embedding"].to_pylist(), np.float32).astype(float) * 64).astype(np.int64)
    expected = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        best = [x for x in np.lexsort((ids, -scores)) if ids[x] != ids[q]][:20]
        expected += [(int(ids[q]), rank, int(ids[x]), int(scores[x])) for rank, x in enumerate(best, 1)]
    assert sorted(map(tuple, QUERIES["op8_exact_topk"](spark, sf_dir).collect())) == sorted(expected)


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(4)
    vectors = np.vstack([rng.integers(-40, 40, (600, 6)) + 200 * rng.integers(-3, 4, (1, 6)) for _ in range(5)] + [np.zeros((300, 6), int)])
    norm = float(np.sqrt((vectors * vectors).sum(axis=1).max()))
    points = np.hstack([vectors.astype(float), np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))[:, None]])
    rows = np.arange(len(points), dtype=np.int64)
    route = points.mean(axis=0)
    root, radius = exact_topk.build(points, rows, route)
    import pickle

    queries = vectors[::50].astype(np.int64)
    at, owner, score = exact_topk.search(pickle.dumps((root, route, radius, norm)), queries, rows[::50], 7, np.full(len(queries), -(1 << 62)))
    for q in range(len(queries)):
        every = vectors @ queries[q]
        best = [x for x in np.lexsort((rows, -every)) if x != rows[::50][q]][:7]
        assert sorted(owner[at == q].tolist()) == sorted(best)


def test_license_templates(documents):
    got = {
        r.doc_id: r
        for r in license_scan.scan(
            documents(
                [
                    (1, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
                    (2, "All Rights\nreserved. CC-BY"),
                    (3, "person software permission"),
                ]
            )
        ).collect()
    }
    assert (got[1].labels, got[1].base_labels, got[1].n_base) == ("mit", "", 0)
    assert 0.75 <= got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 3, "cc-by,reserved")
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)


def test_license_lines_of_the_tables(documents):
    """Each form of license line that the documents hold, and lines of other licenses."""
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl"),
        "All rights reserved.": ("reserved", "reserved"),
        "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by"),
        "Released under the MIT License.": ("mit", ""),
        "Licensed under the Apache License, Version 2.0.": ("apache", ""),
        "Released under the BSD License.": ("", ""),
        "Licensed under the Mozilla Public License, Version 2.0.": ("", ""),
        "Er kam mit der License nach Hause.": ("", ""),
        "license of the Apache people": ("", ""),
        "Under the license, mit und ohne.": ("", ""),
        "Released under the\n * MIT License": ("mit", ""),
    }
    table = [(i, f"Und des mit.\n{line}") for i, line in enumerate(lines)]
    got = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan(documents(table)).collect()}
    assert got == dict(enumerate(lines.values()))


def brute_labels(text):
    """Labels of the templates that a window of whole-text words holds, by comparing sets."""
    words = re.findall("[0-9a-z\\x80-\U0010ffff]+", text.lower())
    found = set()
    for label, template in ((label, text) for label, texts in license_scan.TEMPLATES.items() for text in texts):
        n, tokens = len(template.split()), set(template.split())
        for k in range(0, max(len(words) - n, 1), max(n // 2, 1)):
            if 100 * len(tokens & set(words[k : k + 2 * n])) >= license_scan.CONTAINMENT * len(tokens):
                found.add(label)
    for label, forms in license_scan.SHORT_FORMS.items():
        found |= {label for form in forms if f" {form} " in f" {' '.join(words)} "}
    return found | {label for phrase, label in license_scan.BASE_PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}


def test_license_notices_over_lines(documents):
    """Wrapped notices are found wherever they stand; words far apart in one line are not."""
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation\n# files"
    bsd = "* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    far = " ".join(f"{word} {'x ' * 30}" for word in license_scan.TEMPLATES["gpl"][1].split())
    table = [(1, mit), (2, bsd), (3, far)]
    table += [(10 + k, f"{'x ' * k}\n{text}\n{'y ' * 50}") for k in range(25) for text in (mit if k % 2 else bsd,)]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan.scan(documents(table)).collect()}
    assert got == {i: brute_labels(text) for i, text in table}
    assert (got[1], got[2], got[3]) == ({"mit"}, {"bsd"}, set())
    assert all(got[10 + k] == {"mit" if k % 2 else "bsd"} for k in range(25))


def test_license_positional_filter(spark):
    """Places in template and text both count: (left in template, left in text, needed)."""
    table = spark.createDataFrame([(5, 5, 4), (4, 3, 4), (3, 9, 4), (4, 4, 4)], "a int, b int, n int")
    kept = table.where(license_scan._enough_follow(table.a, table.b, table.n)).collect()
    assert sorted(map(tuple, kept)) == [(4, 4, 4), (5, 5, 4)]


def test_pipeline(spark, sf_dir, rows):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {i for i, (_, _, first) in brute_components([(r["doc_id"], r["text"]) for r in rows]).items() if first}
    assert out and {r.doc_id for r in out} <= kept
    assert all(r.decoded_equal for r in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mix", "byte_bpe"]
