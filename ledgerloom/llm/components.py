"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, in_arrow, stored

#: Distinct edges (4 MB) at which one task finishes what the rounds have left.
LOCAL_EDGES = 250_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) by union-find in memory."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    root = np.array(parent, np.int64)
    while (root[root] != root).any():
        root = root[root]
    return nodes, nodes[root] if len(nodes) else nodes


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    node, component = local_components(*(np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``, one row per node on an edge.

    ``component`` is the smallest node reachable.  Rows with a null end, loops and repeated edges
    are ignored; no edges give no rows.  Each round only moves (node, smallest neighbour) pairs, so
    a hub of any degree needs no list of its neighbours; rounds are logarithmic in the diameter.
    Every round is written to the shared folder and the one before it deleted.  As soon as no more than
    ``local_edges`` distinct edges are left, a count that is checked, one task finishes them.
    """
    a, b = F.col("a"), F.col("b")
    cur = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    seen = _mark(cur)
    while seen[0]:
        if seen[0] <= local_edges:
            return in_arrow(cur.repartition(1), _finish, "node long, component long")
        both = cur.union(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = stored(small.where("a <> b").distinct())
        drop_stored(cur)
        cur, before, seen = new, seen, _mark(new)
        if seen == before:
            break
    stars = cur.select(a.alias("node"), b.alias("component"))
    return stars.union(cur.select(b.alias("node"), b.alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first())
