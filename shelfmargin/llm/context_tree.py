"""Code length of texts by context-tree weighting, and a unigram base.

Each byte is eight binary decisions. The decisions that start from the same bits of a byte share
a context tree over the bytes before it, the nearest first, ``DEPTH`` bytes deep. Every node holds
counts of zeros and ones; its Krichevsky-Trofimov estimate is mixed half and half with the product
of its children, over all depths. A child that was never seen has probability one and predicts
either decision with a half.

All that is needed are the counts of the grams, a byte with its ``DEPTH`` predecessors, so the model
grows with the corpus. One grouping per depth weights the nodes from the longest contexts up, one
join per depth mixes the chances on the way down. The log probabilities of the most frequent grams
are broadcast, at most ``COMMON_GRAMS``; texts meet those of other grams, and of grams that were
never learnt, in a join.

A text is its bytes with A-Z folded and one end mark; it starts after ``DEPTH`` end marks.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import LOWER, cut, map_batches, ready, slices, utf8
from shelfmargin.session import checkpointed, new_folder, removed

DEPTH = 5  # bytes; a gram fits 48 bits
END = 0xFF  # never occurs in UTF-8
COMMON_WORDS = 200_000
HELD_WORDS = 300_000
COMMON_GRAMS = 2_000_000
HELD_GRAMS = 1 << 20
END_TOKEN = b"\n"  # stands for the end of a text; no word holds white space
_BUFFER = 1 << 20
_LOG_HALF = float(np.log(0.5))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: eight steps of the recurrence and Stirling's series."""
    steps = F.lit(1.0)
    for k in range(8):
        steps = steps * (x + F.lit(float(k)))
    y = x + F.lit(8.0)
    square = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square / 1680))) / y
    return series + (y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) - F.log(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    both = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
    return both - F.lit(float(np.log(np.pi)))


def _log_sum(a: Column, b: Column) -> Column:
    """ln(e**a + e**b)."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every coded byte as one number, and its row.

    The coded byte is the lowest byte, the nearest byte before it the highest of ``DEPTH`` others.
    """
    lengths = np.diff(offsets)
    rows = np.arange(len(lengths))
    line = np.full(len(data) + (DEPTH + 1) * len(lengths), END, np.uint8)
    line[np.arange(len(data)) + np.repeat(rows * (DEPTH + 1) + DEPTH, lengths)] = LOWER[data]
    coded = np.ones(len(line), bool)
    coded[((offsets[:-1] + (DEPTH + 1) * rows)[:, None] + np.arange(DEPTH)).ravel()] = False
    grams = np.zeros(max(len(line) - DEPTH, 0), np.int64)
    for back in range(1, DEPTH + 1):
        grams |= line[DEPTH - back : len(line) - back]
        grams <<= 8
    grams |= line[DEPTH:]
    return grams[coded[DEPTH:]], np.repeat(rows, lengths + 1)


def _distinct(keys: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of what they hold (1 each by default)."""
    if held is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], held[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys)) if held is None else np.add.reduceat(held, starts)


class GramTable:
    """Log probabilities by gram: an open hash table with at most half its places taken.

    Of several grams with one place the last keeps it, so frequent grams, found most often, come last.
    """

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        bits = max(4, (2 * len(grams)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.grams, self.logs = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        at, rest = self._place(grams), np.arange(len(grams))
        while len(rest):
            free = self.grams[at] == -1
            self.grams[at[free]] = grams[rest[free]]
            mine = self.grams[at] == grams[rest]
            self.logs[at[mine]] = logs[rest[mine]]
            at, rest = (at[~mine] + 1) & self.mask, rest[~mine]

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs (0 where there are none), and where there are none."""
        at = self._place(grams)
        there = self.grams[at]
        hit = there == grams
        logs = np.where(hit, self.logs[at], np.float32(0))
        rest = np.flatnonzero(~hit & (there != -1))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            there = self.grams[at]
            found = there == grams[rest]
            logs[rest[found]], hit[rest[found]] = self.logs[at[found]], True
            on = ~found & (there != -1)
            at, rest = at[on], rest[on]
        return logs, np.flatnonzero(~hit)


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """``kind, word, key, held``: partial counts of words and grams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out(kind: str, names: list | None, keys: np.ndarray | None, held) -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * n, pa.string()),
                    pa.array(names, pa.binary()) if names is not None else pa.nulls(n, pa.binary()),
                    pa.array(keys, pa.int64()) if keys is not None else pa.nulls(n, pa.int64()),
                    pa.array(held, pa.int64()),
                ],
                ["kind", "word", "key", "held"],
            )

        def listed(keys: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                yield out("gram", None, keys[k : k + 100_000], held[k : k + 100_000])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, last in slices(offsets, _BUFFER):
                part, places = cut(data, offsets, first, last)
                waiting.append(_distinct(text_grams(part, places)[0]))
                if sum(len(keys) for keys, _ in waiting) > HELD_GRAMS:
                    grams, waiting = _distinct(*map(np.concatenate, zip(grams, *waiting))), []
                    if len(grams[0]) > HELD_GRAMS:
                        yield from listed(*grams)
                        grams = (grams[0][:0], grams[1][:0])
                joined = part.tobytes().lower()
                for x, y in zip(places[:-1].tolist(), places[1:].tolist()):
                    words.update(joined[x:y].split())
                words[END_TOKEN] += last - first
                if len(words) > HELD_WORDS:
                    yield out("word", list(words), None, list(words.values()))
                    words.clear()
        if words:
            yield out("word", list(words), None, list(words.values()))
        yield from listed(*_distinct(*map(np.concatenate, zip(grams, *waiting))))

    return ready(docs.select(text)).mapInArrow(count, "kind string, word binary, key long, held long")


def _decisions(grams: DataFrame) -> DataFrame:
    """Eight rows per gram: ``at`` (context, then the bits so far after a leading 1) and ``bit``."""
    return grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr(
        "gram", "held",
        "shiftleft(shiftright(gram, 8), 8) | shiftright(256 | (gram & 255), 8 - k) as at",
        "cast(shiftright(gram, 7 - k) & 1 as int) as bit",
    )


def weighted_levels(grams: DataFrame, folder: str) -> list[DataFrame]:
    """``at, chance`` for each depth from 0: the chance of a one where no longer context was seen.

    ``at`` is the context of that many bytes followed by the bits of the byte so far. ``grams`` has
    ``gram, held``. Tables are written to ``folder``.
    """
    spark = grams.sparkSession
    a, b, chance = F.col("a"), F.col("b"), (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    parent = "shiftleft(shiftright(at, 16), 8) | (at & 255)"

    def written(level: DataFrame, name: str) -> DataFrame:
        level.write.parquet(f"{folder}/{name}")
        return spark.read.schema(level.schema).parquet(f"{folder}/{name}")

    deepest = _decisions(grams).groupBy("at").agg(
        F.sum(F.expr("held * (1 - bit)")).cast("double").alias("a"), F.sum(F.expr("held * bit")).cast("double").alias("b")
    )
    counted = [written(deepest, f"counts-{DEPTH}").withColumn("total", log_kt(a, b))]
    for depth in range(DEPTH - 1, -1, -1):
        merged = counted[0].groupBy(F.expr(parent).alias("at")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("total").alias("below")
        )
        own = merged.withColumn("kt", log_kt(a, b)).withColumn("total", _log_sum(F.col("kt"), F.col("below")) + _LOG_HALF)
        own = own.withColumn("own", F.exp(F.col("kt") + _LOG_HALF - F.col("total")))
        counted.insert(0, written(own.select("at", "a", "b", "total", "own"), f"counts-{depth}"))
    # what the contexts so far add to the chance, and the weight left for longer ones
    mixed = written(counted[0].select("at", (F.col("own") * chance).alias("sure"), (1 - F.col("own")).alias("rest")), "mixed-0")
    levels = [mixed]
    for depth in range(1, DEPTH + 1):
        above = levels[-1].select(F.col("at").alias("up"), F.col("sure").alias("held_sure"), F.col("rest").alias("held_rest"))
        joined = counted[depth].withColumn("up", F.expr(parent)).join(above, "up")
        own = F.lit(1.0) if depth == DEPTH else F.col("own")
        mixed = joined.select(
            "at", (F.col("held_sure") + F.col("held_rest") * own * chance).alias("sure"), (F.col("held_rest") * (1 - own)).alias("rest")
        )
        levels.append(written(mixed, f"mixed-{depth}"))
    return [level.select("at", (F.col("sure") + F.col("rest") * 0.5).alias("chance")) for level in levels]


def _many(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by sorting: Spark takes grams for as few bytes as the texts they come from
    (a text has one per byte, a gram eight decisions) and would broadcast them through the driver."""
    return rows.hint("merge")


def _log_chance(chance: Column) -> Column:
    return F.log10(F.when(F.col("bit") == 1, chance).otherwise(1 - chance))


def learnt_logs(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``gram, held, log``: log10 probability of the coded byte of every gram of the training texts."""
    joined = _many(_decisions(grams)).join(levels[DEPTH], "at")
    return joined.groupBy("gram").agg(F.max("held").alias("held"), F.sum(_log_chance(F.col("chance"))).alias("log"))


def other_logs(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``gram, log`` of any distinct grams: each decision by the longest context that was seen."""
    every = reduce(DataFrame.unionAll, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels)])
    asked = (
        _decisions(grams.select("gram", F.lit(1).alias("held")))
        .withColumn("node", F.expr("at & 255"))
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
        .withColumn("at", F.expr(f"shiftleft(shiftright(gram, 8 + 8 * ({DEPTH} - depth)), 8) | node"))
    )
    best = _many(asked).join(_many(every), ["depth", "at"], "left").groupBy("gram", "node", "bit").agg(
        F.max_by("chance", F.when(F.col("chance").isNotNull(), F.col("depth"))).alias("chance")
    )
    return best.groupBy("gram").agg(F.sum(_log_chance(F.coalesce("chance", F.lit(0.5)))).alias("log"))


_TABLES: dict[str, GramTable] = {}


def _shared_table(token: str, shared: Broadcast) -> GramTable:
    """The table of common grams, made once per worker process and model."""
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = GramTable(*shared.value)
    return _TABLES[token]


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``held``, at most ``most`` of them.

    The bound is the least power of two that few enough rows reach; about 64 rows decide it.
    """
    sizes = counts.groupBy(F.length(F.bin("held")).alias("bits")).agg(F.count("*").alias("rows"))
    total, bits = 0, 64
    for row in sorted(sizes.collect(), key=lambda row: -row.bits):
        total += row.rows
        if total > most:
            break
        bits = row.bits
    return counts.where(F.length(F.bin("held")) >= bits)


def _common(counts: DataFrame) -> dict[bytes, int]:
    """Counts of the most frequent words, at most ``COMMON_WORDS`` of them, for the broadcast."""
    common = _frequent(counts, COMMON_WORDS).where(F.octet_length("word") <= 64)
    return {bytes(row.word): row.held for row in common.toLocalIterator(prefetchPartitions=True)}


def _common_grams(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, at most ``COMMON_GRAMS``, rising by count, and their log probabilities."""
    table = _frequent(logs, COMMON_GRAMS).select("gram", F.col("log").cast("float").alias("log"), "held").toArrow()
    order = np.argsort(table.column("held").to_numpy(), kind="stable")
    return table.column("gram").to_numpy()[order], table.column("log").to_numpy()[order]


def trained(doc_id: str = "doc_id") -> Column:
    """Whether a document is learnt from: crc32 of its id as text is not 2 modulo 7 (null: yes)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def score_texts(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    Rows keep their own scores even if ids repeat or are null; null text is empty and has its
    end token alone. Without training texts every count is 0. Counts of frequent words and log
    probabilities of frequent grams are broadcast, at most ``COMMON_WORDS`` and ``COMMON_GRAMS``;
    all others meet theirs in a join.
    """
    folder = new_folder(docs.sparkSession, "context-tree")
    partial = checkpointed(_counts(training, text))
    counts = checkpointed(partial.where("kind = 'word'").groupBy("word").agg(F.sum("held").alias("held")))
    grams = checkpointed(partial.where("kind = 'gram'").groupBy(F.col("key").alias("gram")).agg(F.sum("held").alias("held")))
    levels = weighted_levels(grams, folder)
    logs = checkpointed(learnt_logs(grams, levels))
    size = counts.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    context = docs.sparkSession.sparkContext
    common, common_grams = context.broadcast(_common(counts)), context.broadcast(_common_grams(logs))
    token, tokens, words = uuid.uuid4().hex, size.tokens, size.words
    base = float(np.log10(tokens + words + 1))

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        held, table = common.value, _shared_table(token, common_grams)
        data, offsets = utf8(batch.column(2))
        for first, last in slices(offsets):
            part, places = cut(data, offsets, first, last)
            grams, owner = text_grams(part, places)
            logs, other = table.find(grams)
            scores = np.bincount(owner, logs, last - first)
            order = np.lexsort((grams[other], owner[other]))
            grams, owner = grams[other][order], owner[other][order]
            starts = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])[: len(grams)])
            joined = part.tobytes().lower()
            n_tokens, n_known, sums, rare, rare_rows, rare_n = [], [], [], [], [], []
            for row, (x, y) in enumerate(zip(places[:-1].tolist(), places[1:].tolist())):
                found = Counter(joined[x:y].split())
                found[END_TOKEN] = 1
                ns = np.fromiter(found.values(), np.int64, len(found))
                cs = np.array([held.get(word, -1) for word in found], np.int64)
                known = cs >= 0
                n_tokens.append(int(ns.sum()))
                n_known.append(int(ns[known].sum()))
                sums.append(float((ns[known] * np.log10(cs[known] + 1.0)).sum()))
                for word, n, ok in zip(found, ns.tolist(), known.tolist()):
                    if not ok:
                        rare.append(word)
                        rare_rows.append(row)
                        rare_n.append(n)
            n = last - first
            keys = [batch.column(k).slice(first, n) for k in (0, 1)]
            yield [*keys, pa.array(n_tokens), pa.array(n_known), pa.array(sums), pa.array(scores),
                   pa.array(np.diff(places)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int64())]
            for index, names, codes, ns in (
                (rare_rows, rare, None, rare_n),
                (owner[starts], None, grams[starts], np.diff(starts, append=len(grams))),
            ):
                m, index = len(index), pa.array(index, pa.int64())
                zero, none = pa.array([0] * m, pa.int64()), pa.array([0.0] * m, pa.float64())
                yield [*[key.take(index) for key in keys], zero, zero, none, none, zero,
                       pa.nulls(m, pa.binary()) if names is None else pa.array(names, pa.binary()),
                       pa.nulls(m, pa.int64()) if codes is None else pa.array(codes, pa.int64()),
                       pa.array(ns, pa.int64())]

    # rows equal in id and text have equal scores: one of them is scored, all of them are listed
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, text_hash long, n_tokens long, n_known long, total double, score double, n_bytes long, word binary, gram long, n long"
    made = checkpointed(map_batches(source, rows, schema))
    heads = made.where("word is null and gram is null")
    rare_words = made.where("word is not null").select("doc_id", "text_hash", "word", "n").join(counts, "word").select(
        "doc_id", "text_hash", F.col("n").alias("known"), (F.col("n") * F.log10(F.col("held") + F.lit(1.0))).alias("total"), F.lit(0.0).alias("log")
    )
    rare_grams = made.where("gram is not null").select("doc_id", "text_hash", "gram", "n")
    asked = checkpointed(rare_grams.select("gram").distinct())
    found, missing = (_many(asked).join(_many(logs), "gram", how) for how in ("inner", "left_anti"))
    answers = found.select("gram", "log").unionAll(other_logs(missing, levels))
    rare_grams = _many(rare_grams).join(_many(answers), "gram").select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("total"), (F.col("n") * F.col("log")).alias("log")
    )
    rare = checkpointed(
        rare_words.unionAll(rare_grams)
        .groupBy("doc_id", "text_hash")
        .agg(F.sum("known").alias("rare_known"), F.sum("total").alias("rare_total"), F.sum("log").alias("rare_log"))
        .select(F.col("doc_id").alias("rare_id"), F.col("text_hash").alias("rare_hash"), "rare_known", "rare_total", "rare_log")
    )
    removed(docs.sparkSession, folder)
    # equal rows added their rare words and grams together: share them out again
    copies = heads.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")).where("copies > 1").select(
        F.col("doc_id").alias("copied_id"), F.col("text_hash").alias("copied_hash"), "copies"
    )
    rare = rare.join(
        copies, F.col("rare_id").eqNullSafe(F.col("copied_id")) & (F.col("rare_hash") == F.col("copied_hash")), "left"
    ).select(
        "rare_id",
        "rare_hash",
        F.expr("rare_known div coalesce(copies, 1)").alias("rare_known"),
        *[(F.col(name) / F.coalesce("copies", F.lit(1))).alias(name) for name in ("rare_total", "rare_log")],
    )
    joined = heads.join(
        rare, F.col("doc_id").eqNullSafe(F.col("rare_id")) & (F.col("text_hash") == F.col("rare_hash")), "left"
    )
    none = F.lit(0).cast("long")
    score = F.col("score") + F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("rare_total", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        score.alias("score"),
        (-score / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Base and context-tree score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, docs.where(trained()))
    return scored.select("doc_id", (~trained()).alias("held_out"), *scored.columns[1:])
