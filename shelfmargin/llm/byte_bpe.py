"""Byte-level BPE: a segment tree over byte positions holds the least pair rank.

Each leaf holds the rank of the pair that starts at its position, or a number above all ranks.
Every inner node holds the least of its 32 children, the left one on a tie, so the root names
the leftmost pair of least rank. A merge removes one position and renews the pairs of the two
live neighbours: three point updates of logarithmic cost. A match of n bytes takes
O(n log n), so a megabyte without white space is no special case.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmargin.llm.arrays import column, fresh, map_batches

CACHED_PIECES = 200_000  # of each cache; about 130 bytes an entry
CACHED_CHARS = 64
FANOUT = 32
_NO_RANK = 1 << 30
_NO_PAIR = _NO_RANK << 32
_GAP = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match, merged in the order of ranks, leftmost first."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # a key is rank * 2**32 + position: the least key is the leftmost pair of least rank
    pairs = [(get(piece[k : k + 2], _NO_RANK) << 32) | k for k in range(n - 1)]
    levels = [pairs]
    while len(levels[-1]) > FANOUT:
        below = levels[-1]
        levels.append([min(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
    top, upper = levels[-1], levels[1:]
    stop = list(range(1, n + 1))  # where the token that starts here ends
    back = list(range(-1, n))  # start of the token before
    while (least := min(top)) < _NO_PAIR:
        at = least & 0xFFFFFFFF
        gone = stop[at]
        end = stop[at] = stop[gone]
        pairs[gone if gone < n - 1 else at] = _NO_PAIR
        if end < n:
            back[end] = at
            pairs[at] = (get(piece[at : stop[end]], _NO_RANK) << 32) | at
        else:
            pairs[at] = _NO_PAIR
        before = back[at]
        if before >= 0:
            pairs[before] = (get(piece[before:end], _NO_RANK) << 32) | before
        if upper:
            for k in (gone, at, before):
                below = pairs
                for level in upper:
                    k = max(k, 0) // FANOUT
                    if k >= len(level):
                        break
                    low = min(below[k * FANOUT : k * FANOUT + FANOUT])
                    if level[k] == low:
                        break
                    level[k], below = low, level
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k : stop[k]]])
        k = stop[k]
    return ids


class Codec:
    """Encodes and decodes by a table of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _packed(self, part: str) -> bytes:
        pieces = self.pattern.findall(part)
        if len(pieces) == 1:  # the part alone goes into the cache of parts
            packed = array("I", merge(part.encode(), self.ranks)).tobytes()
        else:
            packed = b"".join([self.pieces.get(piece) or self._piece(piece) for piece in pieces])
        if len(part) <= CACHED_CHARS:
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            self.cache[part] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        packed = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two other characters always opens a match, so the text is cut
        there and equal parts are encoded once as long as they stay in a bounded cache.
        """
        parts = _GAP.split(text) if "  " in text or _odd(text) else text.split(" ")
        get, packed = self.cache.get, self._packed
        first = parts[0]
        out = [get(first) or (packed(first) if first else b"")]
        out += [get(part) or packed(part) for part in [" " + part for part in parts[1:]]]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens; an unknown id raises ``KeyError``."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ODD = regex.compile(r" \s|\s |^ | $")


def _odd(text: str) -> bool:
    """Whether some space stands beside white space or at an end of the text."""
    return _ODD.search(text) is not None


@lru_cache(maxsize=4)
def _codec(name: str) -> Codec:
    """The codec of a public rank file; each worker reads its installed copy once."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return Codec(read_ranks(lines), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian 32-bit) in place of same-named columns.

    Null text counts as empty and has no ids. Every row is encoded whole; rows are streamed,
    nothing is shuffled.
    """
    return _apply(docs, text, lambda value: _codec(ranks).encode(value or ""), "ids")


def decoded(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes of ``ids`` (null: empty)."""
    return _apply(docs, ids, lambda value: _codec(ranks).decode(value or b""), "decoded")


def _apply(docs: DataFrame, source: str, function: Callable, name: str) -> DataFrame:
    others = [column(c) for c in docs.columns if c.lower() != name.lower()]
    count = len(others)

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        step = 500
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            made = pa.array([function(v) for v in part.column(count).to_pylist()], pa.large_binary()).cast(pa.binary())
            yield [*[part.column(k) for k in range(count)], made]

    taken = docs.select(*others, column(source).alias(fresh(docs, "value")))
    return map_batches(taken, rows, T.StructType([*taken.schema.fields[:-1], T.StructField(name, T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of their decoding."""
    ids = encoded(docs.select("doc_id", "text"), ranks).select("doc_id", "ids")
    return decoded(ids, ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
