"""JSON documents read in slices, whether a file holds one array, one object a line, or objects in a row.

A file is cut at fixed byte positions, so one large array is read by many tasks. What a slice
means depends on the text before it, in two ways only: whether it starts inside a string, and
how deep. The first pass counts, for each slice, its quotes and its brackets for both cases;
running totals over the few numbers of each file settle the case; the second pass gives each
record to the slice that holds its opening brace and reads on to its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 8 << 20  # bytes
MOST_TASKS = 10_000  # partitions, each of one slice or several
_BATCH = 4 << 20
_QUOTE, _ESCAPE = ord('"'), ord("\\")
_BETWEEN = b" \t\r\n,[]"  # what may stand outside records
_MARK = b"\xef\xbb\xbf"  # byte order mark


def _files(path: str) -> list[tuple[str, int]]:
    """Full names and sizes of a file, or of the files below a folder that are not hidden."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == arrow_fs.FileType.NotFound:
        raise ValueError(f"no such path: {path}")
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    if info.type == arrow_fs.FileType.File:
        found = [info]
    else:
        inside = system.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        hidden = [part.path for part in inside if part.base_name.startswith(("_", "."))]
        found = [
            part
            for part in inside
            if part.type == arrow_fs.FileType.File
            and not any(part.path == name or part.path.startswith(name + "/") for name in hidden)
        ]
    packed = [part.path for part in found if part.extension in ("gz", "bz2", "zst", "lz4", "snappy")]
    if packed:
        raise ValueError(f"compressed files cannot be cut into slices: {packed[0]}")
    return [(prefix + part.path, part.size) for part in found if part.size]


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and name in it, of a URI or an absolute local path (``file:/x`` too)."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path.rstrip("/"))


def _escaped_start(file, start: int) -> bool:
    """Whether an odd run of backslashes ends before ``start``."""
    run, at = 0, start
    while at:
        step = min(4096, at)
        file.seek(at - step)
        before = file.read(step)
        kept = len(before.rstrip(b"\\"))
        run += step - kept
        if kept:
            break
        at -= step
    return run % 2 == 1


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Brackets (positions, +1 or -1), the number of quotes before each, and all quotes' positions.

    Escaped quotes do not count. ``escaped`` tells whether the first byte is.
    """
    flat = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(flat == _QUOTE)
    slashes = np.flatnonzero(flat == _ESCAPE)
    if escaped and len(slashes) and slashes[0] == 0:
        slashes = slashes[1:]  # the escaped one opens no pair
    if len(slashes) and len(quotes):
        opens = np.r_[True, np.diff(slashes) != 1]
        first = np.maximum.accumulate(np.where(opens, slashes, 0))
        last = np.searchsorted(slashes, quotes) - 1
        odd = (last >= 0) & (slashes[last] == quotes - 1) & ((quotes - first[last]) % 2 == 1)
        quotes = quotes[~odd]
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    opening = (flat == ord("{")) | (flat == ord("["))
    places = np.flatnonzero(opening | (flat == ord("}")) | (flat == ord("]")))
    return places, np.where(opening[places], 1, -1), np.searchsorted(quotes, places), len(quotes) % 2 == 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: per slice the parity of its quotes, and its depth change from outside and inside a string."""
    for batch in batches:
        for row in batch.to_pylist():
            system, name = _opened(row["path"])
            with system.open_input_file(name) as file:
                escaped = _escaped_start(file, row["start"])
                file.seek(row["start"])
                data = file.read(row["stop"] - row["start"])
            _, signs, before, odd = _marks(data, escaped)
            outside = before % 2 == 0
            yield pa.RecordBatch.from_pylist(
                [{**row, "odd": int(odd), "rise": int(signs[outside].sum()), "rise_in": int(signs[~outside].sum())}],
                _MEASURED,
            )


_MEASURED = pa.schema(
    [("path", pa.string()), *((name, pa.int64()) for name in ("start", "stop", "size", "odd", "rise", "rise_in"))]
)


def _first_byte(file, size: int) -> bytes:
    """The first byte of a file that is no white space and no byte order mark."""
    at = 0
    while at < size:
        file.seek(at)
        part = file.read(4096)
        rest = (part.removeprefix(_MARK) if at == 0 else part).lstrip()
        if rest:
            return rest[:1]
        at += len(part)
    return b""


def _records(path: str, start: int, stop: int, size: int, inside: int, depth: int) -> Iterator[bytes]:
    """The records that open in one slice, which starts at a known depth, in or outside a string."""

    def wrong(what: str) -> ValueError:
        return ValueError(f"{path}, bytes {start} to {stop}: {what}")

    system, name = _opened(path)
    with system.open_input_file(name) as file:
        base = 1 if _first_byte(file, size) == b"[" else 0
        escaped = _escaped_start(file, start)
        at, held, between = start, None, []  # held: parts of an open record
        skip = depth > base or inside  # the record open at the start belongs to an earlier slice
        while at < stop or (held is not None and at < size):
            file.seek(at)
            data = file.read(min(SLICE, (stop if at < stop else size) - at))
            places, signs, before, odd = _marks(data, escaped)
            outside = (before + inside) % 2 == 0
            places, signs = places[outside], signs[outside]
            depths = depth + np.cumsum(signs)
            edges = np.flatnonzero(((signs > 0) & (depths == base + 1)) | ((signs < 0) & (depths == base)))
            done, own = 0, at < stop
            for edge in edges.tolist():
                place = int(places[edge])
                if signs[edge] > 0:
                    if base and data[place] == ord("["):
                        raise wrong("an element is no object")
                    if not own:
                        raise wrong("a record does not end before the next")
                    if not skip:
                        between.append(data[done:place])
                    held, done, skip = [], place, False
                else:
                    if held is not None:
                        held.append(data[done : place + 1])
                        yield b"".join(held)
                    held, done, skip = None, place + 1, False
                    if not own:
                        break
            if held is not None:
                held.append(data[done:])
            elif own and not skip:
                between.append(data[done:])
            if b"".join(between).removeprefix(_MARK if at == 0 else b"").translate(None, _BETWEEN):
                raise wrong("text outside of objects")
            between = []
            if len(data):
                run = len(data) - len(data.rstrip(b"\\"))
                escaped = (run + (escaped and run == len(data))) % 2 == 1
            depth, inside, at = int(depths[-1]) if len(depths) else depth, (inside + odd) % 2, at + len(data)
        if held is not None or (stop == size and at == size and (depth or inside)):
            raise wrong("the file ends inside a document")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: the records of each slice as texts."""

    def packed(rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.decode() for row in rows], pa.string())], ["record"])

    for batch in batches:
        for row in batch.to_pylist():
            rows, held = [], 0
            for record in _records(*(row[name] for name in ("path", "start", "stop", "size", "inside", "depth"))):
                rows.append(record)
                held += len(record)
                if held >= _BATCH:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_json_array(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    options: Mapping[str, str] | None = None,
    slice_bytes: int = SLICE,
) -> DataFrame:
    """The objects of a file or folder of UTF-8 JSON, as columns of ``schema``.

    A file is an array of objects, or objects one after another. An element that is no object, text
    between objects and a file that ends inside one stop the job; empty files and arrays give no
    rows. ``options`` are those of ``from_json``. A task holds one slice and one record at a time.
    """
    files = _files(path)
    slices = sum(-(-size // slice_bytes) for _, size in files)
    tasks = max(1, min(slices, MOST_TASKS))
    cut = (
        spark.createDataFrame(files, "path string, size long")
        .select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(slice_bytes))).alias("start"))
        .select("path", "start", F.least(F.col("start") + slice_bytes, "size").alias("stop"), "size")
        .repartition(tasks, "path", "start")
    )
    kinds = "path string, start long, stop long, size long"
    measured = cut.mapInArrow(_measured, f"{kinds}, odd long, rise long, rise_in long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = measured.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("inside") == 0, F.col("rise")).otherwise(F.col("rise_in"))
    placed = inside.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    records = (
        placed.select("path", "start", "stop", "size", "inside", "depth")
        .repartition(tasks, "path", "start")  # a window leaves all slices of a file in one task
        .mapInArrow(_texts, "record string")
    )
    return records.select(F.from_json("record", schema, dict(options or {})).alias("document")).select("document.*")


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a partition as the lines of one array."""
    yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
    first = True
    for batch in batches:
        if batch.num_rows:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row if first and k == 0 else "," + row for k, row in enumerate(rows)], pa.string())], ["value"]
            )
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of files, each one JSON array; null fields are written."""
    records = df.select(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]), {"ignoreNullFields": "false"}).alias("record"))
    records.mapInArrow(_bracketed, "value string").write.mode(mode).text(path)
