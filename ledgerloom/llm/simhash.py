"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_column, in_arrow, stored, wrapped
from .components import connected_components

WIDTH, MAX_BITS, SEED = 4, 4, 42
#: Positional bytes that two fingerprints within MAX_BITS share at least.
MIN_SHARED = 8 - MAX_BITS
#: A posting list longer than this is dealt out again, and at last cut into blocks.
BLOCK = 2048
#: Groups of at most so many rows are tallied together, without an index each.
TINY = 6


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64-bit SimHash over ``width``-word shingles (repeats count); 0 where there are no words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - width + 1)
    last = np.arange(n) + min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        spans = zip(start[at : at + 65536][: n - at].tolist(), (start[last] + size[last])[at : at + 65536].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, doc_id, fp long[, rest]) of every document over its whole text; ``rest`` is the row as it came.

    ``row`` is new in each scan, so what this returns is to be stored before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for _, part in byte_column(batch, "text") for t in part]
            own = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), *([batch.column(3)] if whole else [])]
            yield pa.RecordBatch.from_arrays(own, ["row", "doc_id", "fp", "rest"][: len(own)])

    rows = wrapped(docs if whole else docs.select("doc_id", "text"))
    rows = rows.select("row", F.col("rest.doc_id").cast("long").alias("doc_id"), F.col("rest.text").cast("string").alias("text"), *["rest"] * whole)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "doc_id", "fp")] + ([rows.schema["rest"]] if whole else []))
    return in_arrow(rows, run, schema)


def covering_triples(size: int = 8, parts: int = 3) -> list[tuple[int, int, int]]:
    """Byte triples such that any four of the eight positions hold one of them (Turan's construction).

    The positions are dealt round into three classes; triples inside a class, and those with two
    positions in one class and one in the next, are taken: 20 of them for eight positions.
    """
    out = []
    for a in range(size):
        for b in range(a + 1, size):
            for c in range(b + 1, size):
                k = sorted((a % parts, b % parts, c % parts))
                if k[0] == k[2] or (k[0] == k[1] and (k[0] + 1) % parts == k[2]) or (k[1] == k[2] and (k[1] + 1) % parts == k[0]):
                    out.append((a, b, c))
    return out


#: For each position, the triples that hold it.
_TAKEN = [[i for i, t in enumerate(covering_triples()) if p in t] for p in range(8)]


class Postings:
    """Inverted index of a group of fingerprints: for each byte position, the rows by their byte there."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.verified = fps, 0
        self.full, self.lists = 0, []
        part = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
        for p in range(8):
            column = part[:, p]
            if (column == column[0]).all():  # one list that holds every row, as at the positions of the group's key
                self.full += 1
            else:
                order = np.argsort(column, kind="stable")
                self.lists.append((column, order, np.searchsorted(column[order], np.arange(257))))

    def partners(self, row: int, left: np.ndarray) -> np.ndarray:
        """Rows of ``left`` within MAX_BITS of a row: tallied over its lists, cut at MIN_SHARED, the survivors verified."""
        tally = np.full(len(self.fps), self.full, np.int8)
        for column, order, edge in self.lists:
            b = int(column[row])
            tally[order[edge[b] : edge[b + 1]]] += 1
        kept = np.flatnonzero((tally >= MIN_SHARED) & left)
        self.verified += len(kept)
        return kept[np.bitwise_count(self.fps[kept] ^ self.fps[row]) <= MAX_BITS]

    def spanning(self) -> list[tuple[int, int]]:
        """Links (by row) that join the group as all its links would; each row is reached once."""
        out, left = [], np.ones(len(self.fps), bool)
        for root in range(len(self.fps)):
            todo = [root] if left[root] else []
            left[root] = False
            while todo:
                row = todo.pop()
                near = self.partners(row, left)
                left[near] = False
                todo += near.tolist()
                out += [(row, int(x)) for x in near]
        return out


def small_links(key: np.ndarray, fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the groups of at most ``size`` rows, all groups at once: each row beside those up to ``size`` - 1 behind it."""
    us, vs = [], []
    part = fp.view(np.uint8).reshape(-1, 8)
    for d in range(1, size):
        at = np.flatnonzero((key[d:] == key[:-d]).all(axis=1))
        at = at[(part[at] == part[at + d]).sum(axis=1) >= MIN_SHARED]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= MAX_BITS]
        us.append(fp[at])
        vs.append(fp[at + d])
    return np.concatenate(us), np.concatenate(vs)


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, pair, fp) sorted by group: the links of each group; a group may cross batches."""

    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
        size = np.diff(np.append(start, len(fp)))
        tiny = np.repeat(size <= TINY, size)
        us, vs = small_links(key[tiny], fp[tiny], TINY)
        us, vs = [us], [vs]
        for s, n in zip(start[size > TINY].tolist(), size[size > TINY].tolist(), strict=True):
            own = fp[s : s + n]
            links = np.array(Postings(own).spanning(), np.int64).reshape(-1, 2)
            us.append(own[links[:, 0]])
            vs.append(own[links[:, 1]])
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
        fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if len(change):
            done = int(change[-1]) + 1
            yield emit(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
    if len(fp):
        yield emit(key, fp)


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))


def _hot(posted: DataFrame, block: int) -> DataFrame:
    """(hot, blocks): keys of more than ``block`` postings."""
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    return counts.select(F.col("key").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` -> links (u, v) with the same connected components as all pairs within MAX_BITS.

    Two fingerprints within four bits share at least four of their eight positional bytes.  A list per
    single byte would hold 1/256 of all rows, so lists are routed by three positional bytes at once: a
    covering design holds one of its triples in any four positions.  A list longer than ``block`` is
    dealt out again by each fourth byte, since its pairs share one more; what is still longer there is
    cut into blocks, a group for each pair of blocks.  Inside a group the inverted index by single
    positions is tallied, cut and verified (:class:`Postings`).
    """
    triples = covering_triples()

    def first(i: int, t: tuple[int, int, int]) -> Column:
        return F.lit(i << 24).cast("long") + F.shiftleft(_byte(t[0]), 16) + F.shiftleft(_byte(t[1]), 8) + _byte(t[2])

    posted = fps.select("fp", F.explode(F.array(*[first(i, t) for i, t in enumerate(triples)])).alias("key"))
    marked = posted.join(_hot(posted, block), F.col("key") == F.col("hot"), "left")
    cool = marked.where("hot is null").select("key", F.lit(0).cast("long").alias("pair"), "fp")
    # (triple, three bytes, fourth position, its byte): 5 + 24 + 3 + 8 bits above the keys of three
    fourth = [F.when(~F.array_contains(F.lit([*_TAKEN[p]]), F.shiftright("key", 24).cast("int")), F.shiftleft(F.col("key"), 11) + F.lit(p << 8) + _byte(p) + F.lit(1 << 41)) for p in range(8)]
    again = marked.where("hot is not null").select("fp", F.explode(F.filter(F.array(*fourth), lambda k: k.isNotNull())).alias("key"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    split = again.join(_hot(again, block), F.col("key") == F.col("hot"), "left").select("key", "fp", own.alias("own"), other.alias("other"))
    split = split.select("key", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("pair"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(cool.union(split).repartition(parts, "key", "pair").sortWithinPartitions("key", "pair"), group_links, "u long, v long")


def components_of(marks: DataFrame) -> DataFrame:
    """Stored ``(row, doc_id, fp)`` -> ``(row, doc_id, fp, component_id, keeper)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = stored(marks.groupBy("fp").agg(first.alias("first")))
    part = connected_components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(part, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    named = named.join(lowest, "component").select("fp", "lowest")
    return marks.join(named, "fp").select("row", "doc_id", "fp", F.col("lowest.doc_id").alias("component_id"), (F.col("row") == F.col("lowest.row")).alias("keeper"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(row, doc_id, fp, component_id, keeper)``, one row per document.

    Texts are lower-cased (A-Z), split at ASCII blanks, shingled by four words (fewer words: the whole
    sequence; none, empty or null: fingerprint zero, linked like any other).  Documents link at four
    or fewer differing bits; ``component_id`` is the smallest doc_id reachable (null only if the whole
    component has null ids).  ``keeper`` is true for one row of each component: the smallest doc_id,
    null ids last, ties by position.  Very long texts are read whole, one after another.  Repeated rows
    stay rows; copies share one fingerprint and are never expanded to pairs.  Other columns are not
    read.  ``row`` is written once with its fingerprint, so ``docs`` may be any plan.
    """
    return components_of(stored(fingerprints(docs)))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The documents, one of each component, with the columns they came with; ``docs`` may be any plan."""
    rows = stored(fingerprints(docs, whole=True))
    extra = components_of(rows.drop("rest")).where("not keeper").select(F.col("row").alias("gone"))
    return rows.select("row", "rest").join(extra, F.col("row") == F.col("gone"), "left_anti").select("rest.*")
