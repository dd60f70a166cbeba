"""Near-duplicate documents from bottom-k sketches made with one hash function.

A sketch holds the ``SKETCH`` smallest shingle hashes of a document. Documents with equal
shingle sets are folded into one class first. Inverted lists over the retained values, rare
values first, bring classes together; the sketch of the union estimates their Jaccard
similarity; pairs that may pass are confirmed on full sets of 64-bit shingle hashes.

Which values a sketch enters into lists follows from the least overlap ``m`` of two sketches
of documents at the threshold: among any ``size - m + 1`` of its values at least one is
shared. Up to 3/4 of ``SKETCH`` shingles the sketches are whole sets and ``m`` is exact. Above,
the number of shared values is hypergeometric and ``m`` lies ``MARGIN`` standard deviations
below its mean: a pair exactly at the threshold is missed with a chance below 1e-6, a closer
one with far less.

Lists do not emit all pairs. First every member is compared with a leader of its list, one of
``LEADERS`` that a group of copies shares, which joins near copies of any number at linear cost.
Where members of a list are then still in different components, they enter exact lists: by the
rarest quarter of their whole shingle sets, of which two near duplicates share one. A document
with a quarter of shingles of its own meets nobody there, however common the rest of its text.
Only members of different components are then compared, and of those only pairs whose parity
maps (512 bits, each the parity of the shingles that fall on it) differ in no more bits than two
near duplicates can: shingles that only one of the two has flip at most one bit each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmargin.llm.arrays import column, cut, fresh, giving_back, map_batches, ready, shingle_sets, slices, utf8
from shelfmargin.llm.components import components
from shelfmargin.session import checkpointed, new_folder, removed, shuffles_removed

WORDS = 5
SIMILARITY = 75  # percent
SKETCH = 64
MARGIN = 6.0
LEADERS = 8
BUCKET_BITS = 16
EXACT_BITS = 20
COUNTS_SENT = 1 << 16  # buckets in an Arrow batch, 1 MB; all at once are 16 MB in the worker and again in its executor
PARITY = tuple(f"parity_{k}" for k in range(8))


def least_overlap(shingles: int, size: int = SKETCH, percent: int = SIMILARITY) -> int:
    """Values that the sketch of a set of ``shingles`` shares with any near duplicate's."""
    share = percent / 100
    least = math.ceil(share * min(shingles, size) - 1e-9)
    union = shingles / share
    if union > size:
        spread = math.sqrt(share * (1 - share) / size * (union - size) / (union - 1))
        least = min(least, math.floor(size * (share - MARGIN * spread)))
    return max(least, 1)


def exact_overlap(shingles: int) -> int:
    """Shingles that a whole set shares with any near duplicate's."""
    return max(-(-SIMILARITY * shingles // 100), 1)


def may_be_near(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether the union sketch of two documents allows their similarity to reach the threshold."""
    if 100 * min(na, nb) < SIMILARITY * max(na, nb):
        return False
    union = np.union1d(a, b)[:SKETCH]
    shared = np.isin(union, a, True) & np.isin(union, b, True)
    return int(shared.sum()) >= least_overlap(max(na, nb))


def sketches(docs: DataFrame, text: str, keep: tuple[str, ...], width: int = WORDS) -> DataFrame:
    """Columns ``keep`` plus ``n_shingles``, ``class`` (digest of the set; null if empty) and
    ``sketch`` (little-endian 64-bit hashes in ascending order)."""
    kept = [docs.schema[name] for name in keep]
    made = T.StructType.fromDDL("n_shingles long, class binary, sketch binary")

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        data, offsets = utf8(batch.column(len(keep)))
        for first, last in slices(offsets):
            sets = list(shingle_sets(*cut(data, offsets, first, last), width))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield [
                *[batch.column(k).slice(first, last - first) for k in range(len(keep))],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()),
            ]

    return map_batches(docs.select(*keep, text), rows, T.StructType([*kept, *made.fields]))


def _buckets(values: np.ndarray, bits: int) -> np.ndarray:
    return (values & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bucket_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many values fall into each of 2**bits buckets: an array of fixed size.

    As floats of 32 bits, exact up to 2**24: the driver gets 8 bytes a bucket and sends 4. Rounding only
    makes some more buckets equal in order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                np.add.at(total, _buckets(np.frombuffer(row, np.uint64), bits), 1)
        for first in range(0, len(total), COUNTS_SENT):
            found = first + np.flatnonzero(total[first : first + COUNTS_SENT])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "held"])

    held = ready(sets).mapInArrow(giving_back(count), "bucket long, held long")
    summed = held.groupBy("bucket").agg(F.sum("held").alias("held"))
    found = summed.select(F.col("bucket").cast("int"), F.col("held").cast("float")).toArrow()
    counts = np.zeros(1 << bits, np.float32)
    counts[found["bucket"].to_numpy()] = found["held"].to_numpy()
    return counts


def parity_map(members: np.ndarray) -> np.ndarray:
    """Eight longs of 512 bits: how many members, by their highest nine bits, fall on each, modulo 2."""
    odd = np.bincount((members >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def list_entries(
    sets: DataFrame, counted: DataFrame, values: str, overlap: Callable[[int], int], keep: tuple[str, ...] = (), bits: int = BUCKET_BITS
) -> DataFrame:
    """``value, left, class`` and the longs ``keep``: the rarest values of each row's binary ``values``.

    ``left`` is how many values of the row are not before this one in the common order.

    ``overlap(n_shingles)`` is the number of values shared with any near duplicate; the rarest
    ``size - overlap + 1`` are listed. Values are ordered by how full their bucket is among the
    values of ``counted``. Any common order gives the same links; this one keeps frequent values
    out of the lists.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_bucket_counts(counted.select(values), bits))

    def entries(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        held = counts.value
        picked, owners, left = [], [], []
        for row, (size, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            found = np.frombuffer(packed, np.uint64)
            order = np.lexsort((found, held[_buckets(found, bits)]))
            chosen = found[order[: len(found) - overlap(size) + 1]]
            picked.append(chosen.view(np.int64))
            owners.append(np.full(len(chosen), row, np.int32))
            left.append(np.arange(len(found), len(found) - len(chosen), -1))
        index = pa.array(np.concatenate(owners))
        yield [pa.array(np.concatenate(picked)), pa.array(np.concatenate(left)), *[batch.column(k).take(index) for k in range(2, 3 + len(keep))]]

    schema = ", ".join(["value long, left long, class long", *[f"{name} long" for name in keep]])
    return map_batches(sets.select("n_shingles", values, "class", *keep), entries, schema)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that the union sketches let pass."""

    def passing(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        sa, sb = (batch.column(k).to_pylist() for k in (2, 3))
        na, nb = (batch.column(k).to_pylist() for k in (4, 5))
        fits = pa.array(
            [
                may_be_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m, n)
                for x, y, m, n in zip(sa, sb, na, nb)
            ]
        )
        yield [batch.column(0).filter(fits), batch.column(1).filter(fits)]

    side = [
        classes.select(F.col("class").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
        for x in ("a", "b")
    ]
    joined = pairs.join(side[0], "a").join(side[1], "b")
    fitting = joined.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY)
    return map_batches(fitting.select("a", "b", "sa", "sb", "na", "nb"), passing, "a long, b long")


def _laid_down(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table of the folder; compressed, other than a checkpoint."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _whole_sets(
    needed: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``class, members`` (sorted shingle hashes), the parity map and the longs ``keep`` of the classes in ``needed``."""

    def sets(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            kept = [batch.column(k).slice(first, last - first) for k in range(2, 2 + len(keep))]
            found = list(shingle_sets(*cut(data, offsets, first, last), width))
            maps = np.array([parity_map(s) for s in found], np.int64)
            yield [
                batch.column(0).slice(first, last - first),
                pa.array([s.tobytes() for s in found], pa.binary()),
                *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(len(PARITY))],
                *kept,
            ]

    wanted = classes.join(needed, "class").select("class", "text_hash", *keep)
    texts = (
        docs.select(F.xxhash64(text).alias("text_hash"), text)
        .join(wanted.select("text_hash").distinct(), "text_hash", "left_semi")
        .groupBy("text_hash")
        .agg(F.any_value(text).alias("whole"))
    )
    return map_batches(
        texts.join(wanted, "text_hash").select("class", "whole", *keep),
        sets,
        ", ".join(["class long, members binary", *[f"{name} long" for name in (*PARITY, *keep)]]),
    )


def _confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def near(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        fits = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            fits.append(100 * shared >= SIMILARITY * (len(a) + len(b) - shared))
        fits = pa.array(fits, pa.bool_())
        yield [batch.column(0).filter(fits), batch.column(1).filter(fits)]

    side = [whole.select(F.col("class").alias(x), F.col("members").alias(f"m{x}")) for x in ("a", "b")]
    joined = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "ma", "mb")
    return checkpointed(map_batches(joined, near, "a long, b long"))


def _mixed(entries: DataFrame) -> DataFrame:
    """Rows of the lists whose members are in different components."""
    lists = entries.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return entries.join(lists.where(F.col("low") < F.col("high")).select("value"), "value", "left_semi")


def _grouped(source: DataFrame, folder: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n_shingles, component`` of each row of ``source``, and the links of the classes.

    The steps in between are tables of ``folder``; what is returned stands in checkpoints.
    """
    # rows are cheap to make again from their texts; only the classes are laid down
    rows = sketches(source, "text", ("doc_id", "text_hash"), width).withColumnRenamed("class", "digest")
    classes = _laid_down(
        rows.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("sketch").alias("sketch"),
            F.min("text_hash").alias("text_hash"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        folder,
        "classes",
    )
    entries = list_entries(classes, classes, "sketch", least_overlap).drop("left")
    leader = F.min(F.struct(F.xxhash64("class", F.pmod("value", F.lit(LEADERS))).alias("order"), "class"))
    lists = entries.groupBy("value").agg(leader.alias("first"), F.count("*").alias("members"))
    several = lists.where(F.col("members") > 1).select("value", F.col("first.class").alias("leader"), "members")
    shared = _laid_down(entries.join(several, "value"), folder, "shared")
    stars = shared.where(F.col("class") != F.col("leader")).select(
        F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b")
    ).distinct()
    near_stars = checkpointed(_estimated(stars, classes))
    # sets are larger than their texts: only those of classes to compare are made, and go when that is done
    compared = near_stars.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    first = _confirmed(near_stars, _laid_down(_whole_sets(compared, classes, source, "text", width), folder, "compared"))
    removed(source.sparkSession, f"{folder}/compared")
    grouped = checkpointed(components(first, "a", "b").withColumnRenamed("node", "class"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(grouped, "class", "left").withColumn("component", F.coalesce("component", "class"))

    unsettled = _mixed(placed(shared.where(F.col("members") > 2).select("value", "class")))
    parts = checkpointed(unsettled.select("class", "component").distinct())
    whole = _laid_down(_whole_sets(parts, classes, source, "text", width, ("component",)), folder, "whole")
    size = (F.octet_length("members") / 8).cast("long").alias("n_shingles")
    exact = _laid_down(
        list_entries(
            whole.select("class", "members", size, "component"), whole, "members", exact_overlap,
            ("component",), EXACT_BITS,
        ),
        folder,
        "exact",
    )
    # sets of these sizes must share 3/7 of their sum; a pair's first shared value shows whether they still can
    fits = F.least("la", "lb") * (100 + SIMILARITY) >= (F.col("na") + F.col("nb")) * SIMILARITY
    # and at most 1/7 of their sum may stand in one of them alone
    differing = sum(F.bit_count(F.col(f"{name}a").bitwiseXOR(F.col(f"{name}b"))) for name in PARITY)
    alike = differing * (100 + SIMILARITY) <= (F.col("na") + F.col("nb")) * (100 - SIMILARITY)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def side(rows: DataFrame, x: str) -> DataFrame:
        names = {"class": x, "component": f"c{x}", "n_shingles": f"n{x}", "left": f"l{x}"}
        names |= {name: f"{name}{x}" for name in PARITY}
        return rows.select("value", *[F.col(name).alias(other) for name, other in names.items()])

    # sizes and maps join the few rows of mixed lists, not all rows of the lists
    listed = _mixed(exact).join(whole.select("class", size, *PARITY), "class")
    rest = side(listed, "a").join(side(listed, "b"), "value").where(F.col("ca") < F.col("cb")).where(fits & alike)
    # laid down, so that the lists' shuffles are gone when the sets are shuffled
    rest = checkpointed(rest.select(*pair).distinct().join(stars, ["a", "b"], "left_anti"))
    links = checkpointed(first.unionAll(_confirmed(rest, whole)).distinct())

    joined = components(links, "a", "b").withColumnRenamed("node", "class")
    placed_classes = (
        classes.select("digest", "class")
        .join(joined, "class", "left")
        .select("digest", F.coalesce("component", "class").alias("component"))
    )
    placed_rows = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(placed_classes, "digest", "left")
    return checkpointed(placed_rows.drop("digest")), links


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS
) -> tuple[DataFrame, DataFrame]:
    """Group near duplicates: ``(rows, links)``.

    ``rows`` has one row per row of ``docs``: ``doc_id, n_shingles, text_hash, group`` (null
    without words), ``component_id`` (smallest non-null id of the group) and ``kept``. ``links`` has the
    confirmed pairs ``a, b`` of classes. A row whose text is null or has no word is its own
    component and kept. A row with null id keeps null only if no row it reaches has an id.
    Repeated ids are grouped by text like any other rows; other columns are ignored.
    """
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    folder = new_folder(docs.sparkSession, "near_dedup")
    with shuffles_removed(docs.sparkSession):
        placed_rows, links = _grouped(source, folder, width)
    removed(docs.sparkSession, folder)
    ids = placed_rows.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("doc_id").alias("component_id")
    )
    found = placed_rows.join(ids, "component", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.col("component").alias("group"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), links


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Component of each of the documents and whether it is the one kept."""
    rows, _ = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group of near duplicates.

    Kept is the row with the group's smallest id; of several rows with that id the one with
    the smallest text hash, and one of those with equal text. Rows without words all stay.
    """
    rows, _ = near_duplicates(docs)
    text_hash, kept_id, kept_hash = (fresh(docs, name) for name in ("text_hash", "kept_id", "kept_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    keeper = (
        rows.where(F.col("group").isNotNull())
        .groupBy("group")
        .agg(first.alias("first"))
        .select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash))
    )
    marked = docs.withColumn(text_hash, F.xxhash64("text"))
    wordless = F.coalesce(~F.col("text").rlike("[^ \\t-\\r]"), F.lit(True))
    copies = (
        marked.where(~wordless)
        .join(keeper, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash)))
        .dropDuplicates(["doc_id", text_hash])
    )
    columns = [column(c) for c in docs.columns]
    return copies.select(*columns).unionAll(marked.where(wordless).select(*columns))
