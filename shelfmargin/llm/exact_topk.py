"""Exact top-k by inner product: M-trees of paged metric nodes, searched best first.

Vectors get one more component that gives all of them the greatest norm, so a larger inner
product is a smaller Euclidean distance. Vectors go to the nearest of a few pivots, and a
pivot with many vectors to several blocks; each block is one M-tree. A page holds up to
``PAGE`` entries; an inner entry has a covering radius, and every entry its distance to the
routing vector of its page. Pages are visited by least lower bound over a block of queries;
|d(q, p) - d(p, x)| - r leaves out entries without computing their distance.

Every query first searches its own block, which gives it a score to beat. The routing vectors and
covering radii of all blocks, in pages, then tell which other blocks can hold a score at least as
good; a block of queries is sent on only with the queries that still have a use for a tree. Bounds
have a slack above rounding error, and scores are whole numbers, so results are exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmargin.llm.arrays import ready
from shelfmargin.session import checkpointed

PAGE = 64
BLOCK = 4_096
PIVOTS = 64
ROUTES = 512  # blocks in one page of routes
SLACK = 1e-6
_NO_BAR = -(1 << 62)
_MOST_SQUARE = 2.0**62  # of a norm: then every inner product, and every part of its sum, fits a long


class Page:
    """A node: entries with their distance to the routing vector, a leaf's rows or child pages."""

    __slots__ = ("vectors", "to_parent", "radii", "children", "rows")

    def __init__(self, vectors, to_parent, radii=None, children=None, rows=None):
        self.vectors, self.to_parent, self.radii, self.children, self.rows = vectors, to_parent, radii, children, rows


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def build(vectors: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> tuple[Page, float]:
    """An M-tree over ``vectors`` under the routing vector ``parent``, and its covering radius."""
    to_parent = _distances(vectors, parent[None])[:, 0]
    radius = float(to_parent.max(initial=0.0))
    if len(vectors) <= PAGE:
        return Page(vectors, to_parent, rows=rows), radius
    parts = min(16, -(-len(vectors) // (PAGE // 2)))
    routes = vectors[np.linspace(0, len(vectors) - 1, parts).astype(int)]
    nearest = _distances(vectors, routes).argmin(axis=1)
    if np.bincount(nearest, minlength=parts).max() > 0.9 * len(vectors):  # equal vectors: split evenly
        nearest = np.arange(len(vectors)) * parts // len(vectors)
    routing, radii, children = [], [], []
    for k in range(parts):
        inside = nearest == k
        if inside.any():
            page, own = build(vectors[inside], rows[inside], routes[k])
            routing.append(routes[k])
            radii.append(own)
            children.append(page)
    routing = np.array(routing)
    return Page(routing, _distances(routing, parent[None])[:, 0], np.array(radii), children), radius


def search(tree: bytes, queries: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray):
    """Best ``k`` scores and row ids for each query among one tree, none below ``least``.

    Returns arrays of query position, row id and score.
    """
    root, route, radius, norm = pickle.loads(tree)
    n = len(queries)
    scores = np.full((n, k), np.iinfo(np.int64).min, np.int64)
    found = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    bar = least.copy()  # a candidate below it is of no use
    points = np.hstack([queries.astype(float), np.zeros((n, 1))])
    lengths = (points * points).sum(axis=1)
    exact = np.sqrt(lengths.max(initial=0.0)) * norm < 2.0**53  # no part of a product's sum is rounded
    slack = SLACK * (np.sqrt(lengths) + norm + 1)

    def reach(which: np.ndarray) -> np.ndarray:
        """The largest distance at which a vector can still score enough."""
        return np.sqrt(np.maximum(lengths[which] + norm * norm - 2 * bar[which].astype(float), 0)) + slack[which]

    everyone = np.arange(n)
    to_root = _distances(points, route[None])[:, 0]
    heap, order = [(float((to_root - radius).min(initial=0.0)), 0, root, everyone, to_root, np.maximum(to_root - radius, 0))], 0
    while heap:
        _, _, page, which, to_page, bound = heapq.heappop(heap)
        alive = bound <= reach(which)
        which, to_page = which[alive], to_page[alive]
        if not len(which):
            continue
        limit = reach(which)
        radii = page.radii if page.rows is None else 0.0
        maybe = np.abs(to_page[:, None] - page.to_parent[None]) - radii <= limit[:, None]
        if page.rows is not None:
            asked, held = maybe.any(axis=1), maybe.any(axis=0)
            if not asked.any():
                continue
            which, vectors, rows = which[asked], page.vectors[held][:, :-1], page.rows[held]
            if exact:
                got = np.rint(queries[which].astype(float) @ vectors.T).astype(np.int64)
            else:
                got = queries[which] @ np.rint(vectors).astype(np.int64).T
            useful = (got >= bar[which][:, None]) & (rows[None] != ids[which][:, None])
            asked = useful.any(axis=1)
            which, got, useful = which[asked], got[asked], useful[asked]
            if not len(which):
                continue
            lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            pool = np.hstack([scores[which], np.where(useful, got, lowest)])
            owners = np.hstack([found[which], np.where(useful, rows[None], highest)])
            best = np.lexsort((owners, -np.maximum(pool, lowest + 1)), axis=-1)[:, :k]
            scores[which] = np.take_along_axis(pool, best, 1)
            found[which] = np.take_along_axis(owners, best, 1)
            bar[which] = np.maximum(bar[which], scores[which, -1])
        else:
            for e, child in enumerate(page.children):
                asked = maybe[:, e]
                if asked.any():
                    near = _distances(points[which[asked]], page.vectors[e][None])[:, 0]
                    low = np.maximum(near - page.radii[e], 0)
                    order += 1
                    heapq.heappush(heap, (float(low.min()), order, child, which[asked], near, low))
    have = found != np.iinfo(np.int64).max
    return np.nonzero(have)[0], found[have], scores[have]


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key, ids, matrix``: rows of (key, id, vector) as one binary per key value."""

    def pack(groups: pa.Table) -> pa.Table:
        ids = groups.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = groups.column("whole").combine_chunks()
        flat = lists.flatten().to_numpy().reshape(len(ids), -1)
        columns = [groups.column(name).slice(0, 1) for name in key]
        return pa.table(
            [*columns, pa.array([ids[order].tobytes()], pa.binary()), pa.array([flat[order].tobytes()], pa.binary())],
            [*key, "ids", "matrix"],
        )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{name} {kinds[name]}" for name in key] + ["ids binary, matrix binary"])
    return rows.groupBy(*key).applyInArrow(pack, schema)


def whole_vectors(embeddings: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``id, whole``: floor(scale * x) of the vectors that have only finite components.

    Null ids and vectors, null, infinite and not-a-number components, and empty vectors take no
    part. Nor do vectors whose squares add up to 2**62 or more, because their scores need not fit a
    long; below that no inner product exceeds the product of the norms.
    """
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    square = F.aggregate(
        F.transform(vector, lambda x: x.cast("double") * scale),
        F.lit(0.0),
        lambda total, x: total + F.greatest(F.abs(x), F.abs(F.floor(x).cast("double"))) ** 2,
    )
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < 2.0**32, F.lit(False)))
    sound = finite & (square < _MOST_SQUARE)
    return embeddings.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(
        sound
    ).select(F.col(vec_id).cast("long").alias("id"), parts.alias("whole"))


_TREE = pa.schema(
    [
        ("block", pa.int32()),
        *((name, pa.binary()) for name in ("tree", "tree_ids", "tree_rows", "route")),
        ("radius", pa.float64()),
    ]
)


def top_k(
    embeddings: DataFrame,
    is_query,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other vectors.

    ``is_query`` is a condition on ``id``. Score is the inner product of the whole-number
    vectors, ties go to the smaller id; vectors meet those of their own length. Rows are told
    apart by their place and not by id: rows that repeat an id, or a whole row, are candidates
    of each other, and each of them that is a query has its own list. Pivots are at most
    ``PIVOTS`` vectors of a length; any choice gives the same result.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, vec_id, vector, scale).withColumn("width", F.size("whole"))
    square = F.aggregate("whole", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = rows.groupBy("width").agg(F.count("*").alias("rows"), F.max(square).alias("square")).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norms = {shape.width: float(np.sqrt(shape.square)) for shape in shapes}
    blocks = {shape.width: -(-shape.rows // BLOCK) for shape in shapes}
    by_hash = Window.partitionBy("width").orderBy(F.xxhash64("id"), "id")
    several = [width for width, count in blocks.items() if count > 1]
    chosen = rows.where(F.col("width").isin(several)).withColumn("place", F.row_number().over(by_hash))
    pivots, first = {}, {}
    for row in chosen.where(F.col("place") <= PIVOTS).collect() if several else ():
        if row.place <= blocks[row.width]:
            pivots.setdefault(row.width, []).append(row.whole)
    for width in sorted(blocks):
        first[width] = sum(len(pivots.get(other, [0])) for other in first)
    shared = spark.sparkContext.broadcast({width: np.array(found, float) for width, found in pivots.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wholes, widths = batch.column(1), batch.column(2).to_numpy()
            near = np.zeros(batch.num_rows, np.int32)
            for width in np.unique(widths).tolist():
                which = np.flatnonzero(widths == width)
                near[which] = first[width]
                if width in shared.value:
                    flat = wholes.take(pa.array(which)).flatten().to_numpy().reshape(len(which), width).astype(float)
                    near[which] += _distances(flat, shared.value[width]).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), wholes, pa.array(near)], ["id", "whole", "pivot"])

    placed = ready(rows.select("id", "whole", "width")).mapInArrow(assign, "id long, whole array<bigint>, pivot int")
    placed = checkpointed(placed.withColumn("row", F.monotonically_increasing_id()))
    sizes = {row.pivot: -(-row.rows // BLOCK) for row in placed.groupBy("pivot").agg(F.count("*").alias("rows")).collect()}
    total, starts = 0, []
    for pivot, count in sorted(sizes.items()):
        starts.append((pivot, total, count))
        total += count
    spread = F.broadcast(spark.createDataFrame(starts, "pivot int, start int, count int"))  # PIVOTS rows a length
    block = (F.col("start") + F.pmod(F.xxhash64("row"), "count")).cast("int")
    in_block = placed.join(spread, "pivot").select(block.alias("block"), "id", "row", "whole")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, matrix in zip(*(batch.column(c).to_pylist() for c in range(3))):
                table = np.frombuffer(matrix, np.int64).reshape(len(ids) // 8, -1)
                whole = table[:, :-1].astype(float)
                norm = norms[whole.shape[1]]
                rest = np.sqrt(np.maximum(norm * norm - (whole * whole).sum(axis=1), 0))
                points = np.hstack([whole, rest[:, None]])
                route = points.mean(axis=0)
                root, radius = build(points, np.arange(len(points)), route)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": block,
                            "tree": pickle.dumps((root, route, radius, norm), protocol=5),
                            "tree_ids": ids,
                            "tree_rows": table[:, -1].tobytes(),
                            "route": route.tobytes(),
                            "radius": radius,
                        }
                    ],
                    _TREE,
                )

    kinds = "block int, tree binary, tree_ids binary, tree_rows binary, route binary, radius double"
    rowed = in_block.select("block", "id", F.concat("whole", F.array("row")).alias("whole"))
    trees = checkpointed(_packed(rowed, ["block"]).mapInArrow(grow, kinds))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, matrix, tree, tree_ids, tree_rows = (batch.column(c)[at].as_py() for c in range(5))
                ids, tree_ids, tree_rows = (np.frombuffer(part, np.int64) for part in (ids, tree_ids, tree_rows))
                table = np.frombuffer(matrix, np.int64).reshape(len(ids), -1)
                order = np.argsort(tree_rows)
                place = order[np.minimum(np.searchsorted(tree_rows, table[:, -2], sorter=order), len(order) - 1)]
                own = np.where(tree_rows[place] == table[:, -2], place, -1)
                which, found, score = search(tree, np.ascontiguousarray(table[:, :-2]), own, k, table[:, -1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table[which, -2]), pa.array(ids[which]), pa.array(tree_ids[found]), pa.array(score)],
                    ["query", "query_id", "vec_id", "score"],
                )

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a block that each other block of a page of routes can still serve."""
        for batch in batches:
            for at in range(batch.num_rows):
                home, ids, matrix, routes = (batch.column(c)[at].as_py() for c in range(4))
                ids = np.frombuffer(ids, np.int64)
                table = np.frombuffer(matrix, np.int64).reshape(len(ids), -1)
                width = table.shape[1] - 2
                others = [r for r in routes if r["block"] != home and len(r["route"]) == 8 * (width + 1)]
                if not others:
                    continue
                points = np.hstack([table[:, :width].astype(float), np.zeros((len(ids), 1))])
                lengths = (points * points).sum(axis=1)
                slack = SLACK * (np.sqrt(lengths) + norms[width] + 1)
                limit = np.sqrt(np.maximum(lengths + norms[width] ** 2 - 2 * table[:, -1].astype(float), 0)) + slack
                ways = np.array([np.frombuffer(r["route"], float) for r in others])
                useful = _distances(points, ways) - np.array([r["radius"] for r in others]) <= limit[:, None]
                for k_th in np.flatnonzero(useful.any(axis=0)).tolist():
                    kept = useful[:, k_th]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([others[k_th]["block"]], pa.int32()),
                            pa.array([ids[kept].tobytes()], pa.binary()),
                            pa.array([table[kept].tobytes()], pa.binary()),
                        ],
                        ["block", "ids", "matrix"],
                    )

    def answers(sent: DataFrame) -> DataFrame:
        asked = sent.join(trees, "block").select("ids", "matrix", "tree", "tree_ids", "tree_rows")
        return asked.mapInArrow(ask, "query long, query_id long, vec_id long, score long")

    queries = in_block.where(is_query)
    unbarred = F.concat("whole", F.array(F.col("row"), F.lit(_NO_BAR)))
    home = answers(_packed(queries.select("block", "id", unbarred.alias("whole")), ["block"]))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = checkpointed(home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    bars = ranked.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bar"))
    barred = F.concat("whole", F.array(F.col("row"), F.coalesce("bar", F.lit(_NO_BAR))))
    known = _packed(queries.join(bars, "row", "left").select("block", "id", barred.alias("whole")), ["block"])
    pages = (
        trees.groupBy(F.expr(f"block div {ROUTES}").cast("int").alias("page"))
        .agg(F.collect_list(F.struct("block", "route", "radius")).alias("routes"))
    )
    far = answers(
        known.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // ROUTES))))
        .join(pages, "page")
        .select("block", "ids", "matrix", "routes")
        .mapInArrow(reachable, "block int, ids binary, matrix binary")
    )
    every = ranked.drop("rank").unionByName(far)
    return every.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every 20th vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
