"""Exact top-k by inner product: an M-tree of paged metric nodes for each shard, searched best first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored

SCALE, TOP = 1024, 10
#: Vectors of one tree, entries of one page, children of one node, and queries that meet a tree at once.
SHARD, PAGE, FANOUT, QUERIES = 16_384, 128, 16, 1_024


class Page:
    """Leaf: rows of the shard.  Inner node: child pages with routing objects and covering radii.

    ``near`` has each entry's distance to the routing object of this page.
    """

    __slots__ = ("children", "near", "radii", "routes", "rows")

    def __init__(self, rows, near, routes=None, radii=None, children=None):
        self.rows, self.near, self.routes, self.radii, self.children = rows, near, routes, radii, children


class MTree:
    """Euclidean M-tree over vectors lengthened by sqrt(M^2 - |x|^2), M the largest norm of the shard.

    There |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are those of the highest inner product.
    Bounds are floats with slack; scores are sums of 64-bit integers, of the rows that the bounds leave.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        wide = self.vectors.astype(np.float64)
        norms = (wide**2).sum(axis=1)
        self.top = float(norms.max())
        self.points = np.hstack([wide, np.sqrt(self.top - norms)[:, None]])
        self.root_route = self.points.mean(axis=0)
        self.root = self._build(np.arange(len(ids)), self.root_route)

    def _far(self, rows: np.ndarray, route: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - route) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, route: np.ndarray) -> Page:
        near = self._far(rows, route)
        if len(rows) <= PAGE:
            order = np.argsort(self.ids[rows], kind="stable")
            return Page(rows[order], near[order])
        pivots, least = [int(rows[near.argmax()])], np.full(len(rows), np.inf)
        for _ in range(min(FANOUT, -(-len(rows) // PAGE)) - 1):
            least = np.minimum(least, self._far(rows, self.points[pivots[-1]]))
            pivots.append(int(rows[least.argmax()]))
        far = np.stack([self._far(rows, self.points[p]) for p in pivots])
        own = far.argmin(axis=0)
        if np.bincount(own).max() > 0.9 * len(rows):  # copies, or nearly: any even split is as good
            own = np.arange(len(rows)) * len(pivots) // len(rows)
        kept = [k for k in range(len(pivots)) if (own == k).any()]
        routes = self.points[[pivots[k] for k in kept]]
        radii = np.array([far[k][own == k].max() for k in kept])
        children = [self._build(rows[own == k], self.points[pivots[k]]) for k in kept]
        return Page(None, np.sqrt(((routes - route) ** 2).sum(axis=1)), routes, radii, children)

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The ``k`` best (score, id), ids smaller first at ties, among scores of ``floor`` or more; rows of ``own_id`` are none."""
        query = np.asarray(query, np.int64)
        q = np.append(query.astype(np.float64), 0.0)
        squared = float(q @ q)
        bound = lambda least: (squared + self.top - np.maximum(least, 0.0) ** 2) / 2  # noqa: E731  best score at that distance or beyond
        best: list[tuple[int, int]] = []  # heap of (score, -id): its head is the worst
        self.scored = 0
        slack = 1e-6 * (squared + self.top + 1.0)
        d = float(np.sqrt(((self.root_route - q) ** 2).sum()))
        queue, count = [(-np.inf, 0, self.root, d)], 0
        while queue:
            upper, _, page, d = heapq.heappop(queue)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -upper + slack < kth:
                break
            if page.children is None:
                # the stored distance to the routing object bounds each entry before its own is computed
                rows = page.rows[bound(np.abs(page.near - d)) + slack >= kth]
                rows = rows[self.ids[rows] != own_id]
                scores = self.vectors[rows] @ query
                self.scored += len(rows)
                order = np.lexsort((self.ids[rows], -scores))[:k]
                for score, vec in zip(scores[order].tolist(), self.ids[rows[order]].tolist(), strict=True):
                    if len(best) < k:
                        if score >= floor:
                            heapq.heappush(best, (score, -vec))
                    elif (score, -vec) > best[0]:
                        heapq.heapreplace(best, (score, -vec))
                continue
            # |d(q, page) - d(child, page)| - radius bounds a child without computing its distance
            for i in np.flatnonzero(bound(np.abs(page.near - d) - page.radii) + slack >= kth).tolist():
                own = float(np.sqrt(((page.routes[i] - q) ** 2).sum()))
                high = float(bound(own - page.radii[i]))
                if high + slack >= kth:
                    count += 1
                    heapq.heappush(queue, (-high, count, page.children[i], own))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x), x as double; vectors with null or non-finite parts left out."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return df.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def trees(vectors: DataFrame, shards: int) -> DataFrame:
    """(shard int, dim long, tree binary): the vectors dealt evenly over ``shards`` tasks, an M-tree for each dimension there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for batch in batches:
            lists, own = batch.column(2), batch.column(0).to_pylist()
            edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for shard, i, s, e in zip(own, batch.column(1).to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                held.setdefault((shard, e - s), []).append((i, flat[s:e].tobytes()))
        for (shard, dim), rows in held.items():
            vectors = np.frombuffer(b"".join(v for _, v in rows), np.int64).reshape(len(rows), dim)
            made = MTree(np.array([i for i, _ in rows], np.int64), vectors)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([dim], pa.int64()), pa.array([pickle.dumps(made, 5)], pa.binary())], ["shard", "dim", "tree"])

    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return in_arrow(dealt.repartition(shards, "shard"), run, "shard int, dim long, tree binary")


def _blocks(queries: DataFrame, size: int) -> DataFrame:
    """(home int, dim long, block binary): queries (home, row, vec_id, floor, v) of one home and dimension, ``size`` at most together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([pickle.dumps(held.pop(key), 5)], pa.binary())], ["home", "dim", "block"])

        for batch in batches:
            for home, row, i, floor, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault((home, len(v)), [])
                own.append((row, i, floor, np.array(v, np.int64)))
                if len(own) == size:
                    yield block((home, len(v)))
        for key in list(held):
            yield block(key)

    return in_arrow(queries.select("home", "row", "vec_id", "floor", "v"), run, "home int, dim long, block binary")


def _answers(forest: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): what each shard's trees answer to the blocks (shard, dim, block) sent to it.

    A task reads a shard's trees and then its blocks, one after another, so it holds one shard and one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}
        for batch in batches:
            for own, kind, dim, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if own != shard:
                    shard, held = own, {}
                if kind == 0:
                    held[dim] = pickle.loads(raw.as_buffer())
                elif dim in held:
                    out = []
                    for row, i, floor, v in pickle.loads(raw.as_buffer()):
                        out += [(row, i, vec, s) for s, vec in held[dim].search(v, i, k, -np.inf if floor is None else floor)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["row", "query_id", "vec_id", "score"])

    both = forest.select("shard", F.lit(0).alias("kind"), "dim", F.col("tree").alias("raw")).union(asked.select("shard", F.lit(1).alias("kind"), "dim", F.col("block").alias("raw")))
    return in_arrow(both.repartition(shards, "shard").sortWithinPartitions("shard", "kind"), run, "row long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, smaller ids first at ties.

    ``queries`` is a part of the rows of ``df`` (vec_id, embedding).  Each row of it is a query of its own,
    also where ids or whole rows repeat; a query never finds rows of its own id.  Vectors that are null or
    hold a null or non-finite part take no part, nor do null ids; vectors of another length than the
    query's are no candidates; fewer candidates than ``k`` give fewer rows; a repeated row is one
    candidate for each time it stands.  Scores are sums of 64-bit integers.

    Vectors are dealt evenly over shards of about ``shard`` rows, a tree each.  A query first asks one
    shard, its home; the k-th best score there is the floor below which the other shards need not look.
    Queries go to the shards in blocks, through the shuffle; nothing but counts comes to the driver.
    """
    spark = df.sparkSession
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = stored(integer_vectors(df, scale).withColumn("row", F.monotonically_increasing_id()))
    shards = max(least, -(-vectors.count() // shard))
    forest = stored(trees(vectors, shards))
    home = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int").alias("home")
    asking = stored(integer_vectors(queries, scale).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v", home))
    parts = max(1, min(least, -(-asking.count() // block)))
    first = _blocks(asking.withColumn("floor", F.lit(None).cast("long")).repartition(parts, "home"), block)
    near = stored(_answers(forest, first.withColumnRenamed("home", "shard"), shards, k))
    floors = near.groupBy(F.col("row").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    known = asking.join(floors, F.col("row") == F.col("of"), "left")
    # blocks of one home, so that a block skips that shard whole
    blocks = stored(_blocks(known.repartition(parts, "home"), block))
    asked = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where("shard <> home")
    found = near.union(_answers(forest, asked, shards, k))
    # k rows of each shard for a query: ranked with a limit per task before the shuffle
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
