"""Text columns as byte arrays, and hashing of whole slices of documents at once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def splitmix(values: np.ndarray) -> np.ndarray:
    """A 64-bit mixing bijection, so that every bit of a hash depends on every bit of its input."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE_KEYS = splitmix(np.arange(256, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, extended on demand."""
    global _POWERS
    if len(_POWERS) < count:
        steps = np.full(2 * count, 0xD6E8FEB86659FD93, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:count]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each row starts and ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, which bounds the arrays made from them.

    One longer row is a range of its own.
    """
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1)
        yield first, min(last, rows)
        first = last


def cut(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``first`` to ``last`` (exclusive) alone."""
    return data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z folded, and the word range of each row."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    ranges = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), ranges
    letters = np.flatnonzero(inside)
    firsts = np.searchsorted(letters, starts)
    lengths = np.diff(firsts, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    keys = BYTE_KEYS[LOWER[data[letters]]] * powers(int(lengths.max()))[place]
    return splitmix(np.add.reduceat(keys, firsts) + lengths.astype(np.uint64)), ranges


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, ranges = hashed_words(data, offsets)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(rolled) + k] * powers(2 * width + 1)[k + 1]
        rolled = splitmix(rolled)
    for first, last in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
        if last - first >= width:
            yield np.unique(rolled[first : last - width + 1])
        elif last > first:
            few = (words[first:last] * powers(2 * width + 1)[width + 1 : width + 1 + last - first]).sum()
            yield splitmix(np.array([few + np.uint64(last - first)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def ready(df: DataFrame) -> DataFrame:
    """``df``, after making its session fit for Arrow operators.

    Batches are bounded in bytes, since rows may hold whole texts, unless the session has its
    own bound; Python workers started in another folder find this package.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df


def giving_back(
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``; after each task the worker returns the memory that Arrow no longer uses.

    Workers live on between tasks, several to an executor, whose memory theirs counts with.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return over


def map_batches(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[Sequence[pa.Array]]],
    schema: str | StructType,
) -> DataFrame:
    """Apply ``function`` to the Arrow batches of ``df``; it yields the columns of ``schema``.

    A schema with columns of the caller's table is a ``StructType``, since their names and types
    may be anything.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    # Spark resolves the names on their way in and out, so they travel as plain ones
    plain = StructType([StructField(f"c{k}", field.dataType) for k, field in enumerate(schema.fields)])
    names = plain.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays(list(columns), names)

    sent = ready(df).toDF(*[f"c{k}" for k in range(len(df.columns))])
    return sent.mapInArrow(giving_back(over), plain).toDF(*schema.names)


def column(name: str) -> Column:
    """The column of that name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
