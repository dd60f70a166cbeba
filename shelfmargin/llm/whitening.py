"""Embedding whitening from a bit-sliced scatter matrix.

Each entry becomes a whole number x. Every distinct x vector is fitted once. A block of rows is
shifted by the least value of each dimension, and bit b of a dimension, over 64 rows, becomes one
word. The sum of products of two dimensions is then the sum over pairs of their bit planes of
2**(a + b) times the number of bits that both planes have: AND and count, no multiplication, no
rounding. Blocks are turned back into sums of x and added in Spark as pairs of decimals; n times the
cross-product less the product of the sums is the centred matrix, still whole. Only that matrix,
whose size depends on the vector length and not on the rows, reaches the driver and ``eigh``.

Vectors of different lengths have no common covariance, so each length is fitted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import map_batches, ready
from shelfmargin.session import new_folder, removed

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 1 << 13
_LIMB = 60
_SAFE = 1 << 62
# |floor(64 c)| + 1000000 fits a long below this; both are doubles
_LEAST, _MOST = -(2.0**63), 2.0**63 - 2.0**20


def whole(vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry c as a long; null for a vector that takes no part.

    Those are null vectors, vectors with a null, infinite or not-a-number entry, and vectors with an
    entry whose number does not fit a long.
    """
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    fits = F.forall(scaled, lambda c: F.coalesce((c >= _LEAST) & (c < _MOST), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda c: F.floor(c) + F.lit(offset).cast("long")))


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the columns of a matrix of unsigned numbers, 64 rows to a word.

    Returns the words, one row per plane, and the (column, bit) of each plane.
    """
    rows, width = shifted.shape
    bits = [int(most).bit_length() for most in shifted.max(axis=0, initial=0).tolist()]
    owners = np.array([(k, b) for k in range(width) for b in range(bits[k])], np.int64).reshape(-1, 2)
    words = -(-rows // 64)
    packed = np.zeros((len(owners), words * 8), np.uint8)
    for p, (k, b) in enumerate(owners.tolist()):
        row = np.packbits((shifted[:, k] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
        packed[p, : len(row)] = row
    return packed.view(np.uint64), owners


def bit_products(shifted: np.ndarray) -> np.ndarray:
    """Sums of products of every two columns, as Python integers, by weighted AND-popcounts."""
    words, owners = planes(shifted)
    width = shifted.shape[1]
    out = np.zeros((width, width), object)
    firsts = np.searchsorted(owners[:, 0], np.arange(width + 1))
    weights = [1 << int(b) for b in owners[:, 1]]
    # whole sums fit a long if rows times the largest product of two weights does
    small = 2 * owners[:, 1].max(initial=0) + 2 + len(shifted).bit_length() < 62
    factors = np.array(weights, np.int64 if small else object)
    for k in range(width):
        later = words[firsts[k] :]
        if not len(later):
            continue
        row = np.zeros(width, object)
        for p in range(firsts[k], firsts[k + 1]):
            counts = np.bitwise_count(words[p] & later).sum(axis=1, dtype=np.int64)
            weighted = counts.astype(factors.dtype) * factors[firsts[k] :]
            # planes of a column stand together, so its sum is one stretch
            ends = np.concatenate([[0], np.cumsum(weighted)])
            sums = ends[firsts[k + 1 :] - firsts[k]] - ends[firsts[k:-1] - firsts[k]]
            row[k:] += sums.astype(object) * weights[p]
        out[k, k:] += row[k:]
    return out


class Scatter:
    """n, sums and the upper triangle of the cross-products of whole-number rows, exact."""

    def __init__(self, width: int):
        self.n, self.sums, self.products = 0, np.zeros(width, object), np.zeros((width, width), object)

    def add(self, rows: np.ndarray) -> None:
        for first in range(0, len(rows), BLOCK_ROWS):
            block = rows[first : first + BLOCK_ROWS]
            low = block.min(axis=0)
            shifted = block.view(np.uint64) - low.view(np.uint64)  # modulo 2**64: never negative
            n, base = len(block), low.astype(object)
            halves = [(shifted >> np.uint64(32)).sum(axis=0, dtype=np.uint64), (shifted & np.uint64(0xFFFFFFFF)).sum(axis=0, dtype=np.uint64)]
            over = halves[0].astype(object) * (1 << 32) + halves[1].astype(object)
            self.n += n
            self.sums += over + n * base
            self.products += np.triu(
                bit_products(shifted) + np.outer(base, over) + np.outer(over, base) + n * np.outer(base, base)
            )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(-1, width), dtype=np.int64)


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each vector length of a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    for width in np.unique(lengths).tolist():
        yield width, np.flatnonzero(lengths == width)


def _limbs(value: int) -> tuple[Decimal, Decimal]:
    return Decimal(value >> _LIMB), Decimal(value & ((1 << _LIMB) - 1))


def scatter(fit: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """For each vector length of ``whole``: n, the sums and the centred cross-products
    n * sum(x_i * x_j) - sum(x_i) * sum(x_j), whole."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            if batch.num_rows:
                for width, rows in by_width(batch.column(0)):
                    held.setdefault(width, Scatter(width)).add(matrix(batch.column(0).take(pa.array(rows)), width))
        for width, part in held.items():
            # place -1 holds the sums, place (-1, -1) the rows
            cells = [(-1, -1, part.n), *((-1, k, v) for k, v in enumerate(part.sums.tolist()))]
            for k in range(width):
                cells += [(k, j, part.products[k, j]) for j in range(k, width)]
                yield _cells(width, cells)
                cells = []

    kinds = "width int, i int, j int, high decimal(38,0), low decimal(38,0)"
    summed = (
        ready(fit)
        .mapInArrow(partial, kinds)
        .groupBy("width", "i", "j")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    )
    out: dict[int, tuple[int, list[int], np.ndarray]] = {}
    cells: dict[int, dict[tuple[int, int], int]] = {}
    for row in summed.toLocalIterator():  # length**2 / 2 cells, whatever the rows
        cells.setdefault(row.width, {})[row.i, row.j] = (int(row.high) << _LIMB) + int(row.low)
    for width, found in cells.items():
        n, sums = found[-1, -1], [found[-1, k] for k in range(width)]
        centred = np.zeros((width, width), object)
        for i in range(width):
            for j in range(i, width):
                centred[i, j] = centred[j, i] = n * found[i, j] - sums[i] * sums[j]
        out[width] = n, sums, centred
    return out


def _cells(width: int, cells: list[tuple[int, int, int]]) -> pa.RecordBatch:
    limbs = [_limbs(value) for _, _, value in cells]
    wide = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([width] * len(cells), pa.int32()),
            pa.array([c[0] for c in cells], pa.int32()),
            pa.array([c[1] for c in cells], pa.int32()),
            pa.array([high for high, _ in limbs], wide),
            pa.array([low for _, low in limbs], wide),
        ],
        ["width", "i", "j", "high", "low"],
    )


class Model:
    """The whitening of one vector length: n, sums, eigenvalues and scaled eigenvectors."""

    def __init__(self, n: int, sums: list[int], centred: np.ndarray, components: int):
        width, square = len(sums), n * n
        covariance = np.array([[value / square for value in row] for row in centred.tolist()], float)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(components, width)]
        trace = sum(centred[k, k] for k in range(width)) / square
        self.n, self.sums = n, sums
        self.values, self.vectors = values[order], vectors[:, order]
        # an eigenvalue within the rounding of eigh is that of a direction without spread
        self.spread = self.values > width * np.finfo(float).eps * max(trace, 0.0)
        self.explained = [float(v / trace) if trace > 0 else None for v in self.values]
        scale = np.sqrt(np.where(self.spread, self.values, 1.0))
        self.projection = np.where(self.spread, self.vectors / scale, 0.0)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, as longs where they and sums of their squares fit, else as Python integers."""
        top = max((abs(int(v)) for v in (rows.min(initial=0), rows.max(initial=0))), default=0)
        if self.n * top + max(map(abs, self.sums), default=0) < _SAFE:
            parts = rows * self.n - np.array(self.sums, np.int64)
            most = int(np.abs(parts).max(initial=0))
            if most * most * max(rows.shape[1], 1) < _SAFE:
                return parts
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """(x - S/n) on each component over the root of its eigenvalue."""
        return (centred / self.n).astype(float) @ self.projection


def identity_errors(fit: DataFrame, models) -> dict[int, float]:
    """For each vector length the largest absolute entry of the covariance of the whitened fit list
    less the identity, over the components that have spread.

    Each batch gives its n, means and centred products; these merge without loss of precision.
    """

    def partial(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for width, rows in by_width(batch.column(0)):
            model = models.value[width]
            points = model.whitened(model.centred(matrix(batch.column(0).take(pa.array(rows)), width)))
            means = points.mean(axis=0)
            products = (points - means).T @ (points - means)
            k = len(means)
            i, j = (index.ravel() for index in np.indices((k, k)))
            yield [
                pa.array(np.full(k * k, width), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                pa.array(np.full(k * k, len(rows)), pa.int64()), pa.array(means[i]), pa.array(means[j]), pa.array(products.ravel()),
            ]

    kinds = "width int, i int, j int, n long, mean_i double, mean_j double, product double"
    n = F.sum("n")
    merged = F.sum(F.col("product") + F.col("n") * F.col("mean_i") * F.col("mean_j")) / n - (
        F.sum(F.col("n") * F.col("mean_i")) / n
    ) * (F.sum(F.col("n") * F.col("mean_j")) / n)
    cells = map_batches(fit, partial, kinds).groupBy("width", "i", "j").agg(merged.alias("value")).collect()
    out: dict[int, float] = {}
    for row in cells:  # at most components**2 for each length
        spread = models.value[row.width].spread
        if spread[row.i] and spread[row.j]:
            out[row.width] = max(out.get(row.width, 0.0), abs(row.value - (row.i == row.j)))
    return out


def whiten(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``:
    one row for each vector that takes part and each of its first ``components`` components.

    ``deviation_exact`` is a decimal; ``deviation`` is the same as a long, null where it does not fit
    one. Rows that repeat a vector or an id are rows of their own, the fit list has each vector
    once, and null ids stay. Each vector length has its own fit; empty vectors have no component. A
    component without spread (an eigenvalue within rounding) has a null ``whitened``, and
    ``explained`` is null if no dimension varies. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), whole(vector, scale, offset).alias("whole")).where(
        F.size("whole") > 0
    )
    folder = new_folder(spark, "whitening")
    rows.select("whole").distinct().write.parquet(folder)
    fit = spark.read.schema("whole array<bigint>").parquet(folder)
    fitted = {
        width: Model(n, sums, centred, components) for width, (n, sums, centred) in scatter(fit).items()
    }
    models = spark.sparkContext.broadcast(fitted)  # length * components numbers each
    errors = identity_errors(fit, models)
    removed(spark, folder)
    schema = (
        f"vec_id {embeddings.select(vec_id).dtypes[0][1]}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double, deviation_exact decimal(38,0)"
    )

    def project(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for width, places in by_width(batch.column(1)):
            model = models.value[width]
            k = len(model.values)
            ids = batch.column(0).take(pa.array(np.repeat(places, k)))
            centred = model.centred(matrix(batch.column(1).take(pa.array(places)), width))
            deviation = (centred * centred).sum(axis=1)
            points = model.whitened(centred)
            points[:, ~model.spread] = np.nan
            exact = [int(v) for v in deviation.tolist()]
            longs = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            decimals = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            repeat = pa.array(np.repeat(np.arange(len(places)), k))
            count = len(places) * k
            yield [
                ids,
                pa.array(np.tile(np.arange(1, k + 1), len(places)), pa.int32()),
                pa.array(np.full(count, model.n), pa.int64()),
                longs.take(repeat),
                pa.array(points.ravel(), from_pandas=True),
                pa.array(model.explained * len(places), pa.float64()),
                pa.array([errors.get(width)] * count, pa.float64()),
                decimals.take(repeat),
            ]

    return map_batches(rows, project, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The whitened vectors of the whole table."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
