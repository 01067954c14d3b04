"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, byte_column, in_arrow, wrapped

WINDOW = 10
#: Benchmark words broadcast at once; a larger benchmark is handled in as many passes as it needs.
BLOCK_WORDS = 500_000
#: Training bytes of one suffix array.
SHARD_BYTES = 8_000_000
STATE = "n_words long, spans array<long>, items array<string>, longest long, longest_at array<long>"
REPORT = "_contamination"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class TestSide:
    """A block of benchmark items as one text of word ids, and its distinct windows.

    Ids start at 1; a 0 ends each item.  A window is a suffix cut to ``window`` words, or a whole item
    that is shorter; windows with the same words are one, owned by all their items.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window, self.names = window, [name for name, _ in items]
        size = np.array([len(words) for _, words in items], np.int64)
        ids = [i for _, words in items for i in [*(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), 0]]
        self.ids = np.array(ids, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        item = np.repeat(np.arange(len(items)), size + 1)
        self.left = (begin + size)[item] - np.arange(len(ids)) if items else np.zeros(0, np.int64)
        whole = (np.arange(len(ids)) == begin[item]) & (self.left > 0) if items else np.zeros(0, bool)
        at = np.flatnonzero((self.left >= window) | whole)
        sizes = np.minimum(self.left[at], window)
        rows = np.where(np.arange(window) < sizes[:, None], suffix_rows(self.ids, at, window), 0)
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.starts, self.sizes = at[first], sizes[first]
        order = np.argsort(which.ravel(), kind="stable")
        #: Every place of each window, and the start of the item that holds a place.
        self.places = np.split(at[order], np.cumsum(np.bincount(which.ravel(), minlength=len(first)))[:-1]) if len(first) else []
        self.begin = begin[item] if items else begin
        owners = np.unique(np.stack([which.ravel(), item[at]], axis=1), axis=0)
        self.owners = np.split(owners[:, 1], np.flatnonzero(np.diff(owners[:, 0])) + 1)
        self.shortest = int(self.sizes.min()) if len(self.starts) else 0


def suffix_rows(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` words of the suffixes at ``at``, zero behind the end of the text."""
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])
    return padded[at[:, None] + np.arange(width)]


class ShardIndex:
    """Sparse suffix array of one training shard.

    Words outside the benchmark's vocabulary and text ends are 0 and match nothing, so only suffixes
    that open with ``shortest`` known words are kept: no other can hold a window.
    """

    def __init__(self, ids: np.ndarray, test: TestSide):
        self.ids, self.test, self.width = ids, test, test.window
        known = ids > 0
        run = np.concatenate([[0], np.cumsum(known)])
        n = len(ids) - test.shortest + 1
        at = np.flatnonzero(run[test.shortest :] - run[:n] == test.shortest) if n > 0 and test.shortest else np.zeros(0, np.int64)
        rows = suffix_rows(ids, at, self.width)
        order = np.lexsort(rows.T[::-1]) if len(at) else at
        self.at, self.keys = at[order], self._packed(rows[order])

    @staticmethod
    def _packed(rows: np.ndarray) -> np.ndarray:
        """Rows as big-endian byte strings, which compare as the rows do."""
        wide = np.ascontiguousarray(rows.astype(">u4"))
        return wide.view(f"S{4 * wide.shape[1]}").ravel() if len(wide) else np.zeros(0, "S4")

    def ranges(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of each test suffix cut to ``sizes``: its interval in the suffix array."""
        rows = suffix_rows(self.test.ids, starts, self.width)
        column = np.arange(self.width)
        low = np.where(column < sizes[:, None], rows, 0)
        high = np.where(column < sizes[:, None], rows, 2**32 - 1)
        return np.searchsorted(self.keys, self._packed(low), "left"), np.searchsorted(self.keys, self._packed(high), "right")


def _hits(texts: list[bytes | None], test: TestSide) -> list[tuple[int, list[int], list[str], int, list[int]]]:
    """Per text: words, merged hit spans (start, end, ...), items, longest match and its place."""
    lookup, sizes, parts = test.vocab.get, [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        parts.append(np.fromiter(map(lookup, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.cumsum([0, *[n + 1 for n in sizes]])
    out = [(n, [], [], 0, []) for n in sizes]
    if not len(test.starts) or not len(ids):
        return out
    index = ShardIndex(ids, test)
    if not len(index.at):
        return out
    low, high = index.ranges(test.starts, test.sizes)
    found = np.flatnonzero(high > low)
    if not len(found):
        return out
    count = (high - low)[found]
    which = np.repeat(found, count)
    place = index.at[np.repeat(low[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    doc = np.searchsorted(begin, place, "right") - 1
    order = np.lexsort((place, doc))
    which, place, doc = which[order], place[order], doc[order]
    cut = np.flatnonzero(np.diff(doc)) + 1
    for group in np.split(np.arange(len(doc)), cut):
        d = int(doc[group[0]])
        spans: list[int] = []
        starts, stops = place[group] - begin[d], place[group] - begin[d] + test.sizes[which[group]]
        best, at, last, before, now = 0, [], -2, set(), set()
        for s, e, w in zip(starts.tolist(), stops.tolist(), which[group].tolist(), strict=True):
            if spans and s <= spans[-1]:
                spans[-1] = max(spans[-1], e)
            else:
                spans += [s, e]
            if s != last:
                before, now, last = (now if s == last + 1 else set()), set(), s
            for t in test.places[w].tolist():
                now.add(t)
                if t - 1 not in before:  # else it lies in the match met one word before
                    n = min(int(test.left[t]), sizes[d] - s)
                    differ = np.flatnonzero(test.ids[t : t + n] != ids[begin[d] + s : begin[d] + s + n])
                    n = int(differ[0]) if len(differ) else n
                    if n > best:
                        best, at = n, [s, t - int(test.begin[t])]
        names = {test.names[i] for w in set(which[group].tolist()) for i in test.owners[w].tolist()}
        out[d] = (sizes[d], spans, sorted(names), best, at)
    return out


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip([*a[::2], *b[::2]], [*a[1::2], *b[1::2]], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items in blocks of bounded size, streamed; items without words are left out."""
    block, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct().toLocalIterator():
        words = words_of(text.encode() if text is not None else None)
        if words and name is not None:
            block.append((name, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def _probed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(rest, state): each document whole, and what was found in it; a pass for each block of the benchmark."""
    sc = docs.sparkSession.sparkContext
    out = wrapped(docs.withColumn("text", F.col("text").cast("string"))).select("rest")
    state = T.StructField("state", T.StructType.fromDDL(STATE))
    for k, items in enumerate(_blocks(benchmark, block_words)):
        shared = sc.broadcast(TestSide(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                rows, pending, size = [], [], 0
                for _, part in byte_column(batch, "rest.text", 64):
                    pending += part
                    size += sum(len(t) for t in part if t)
                    if size >= SHARD_BYTES:
                        rows += _hits(pending, test)
                        pending, size = [], 0
                rows += _hits(pending, test)
                if not first:
                    before = batch.column(1).to_pylist()
                    rows = [(r[0], _merged(b["spans"], r[1]), sorted({*b["items"], *r[2]}), *((r[3], r[4]) if r[3] > b["longest"] else (b["longest"], b["longest_at"]))) for b, r in zip(before, rows, strict=True)]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()))
                found = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["n_words", "spans", "items", "longest", "longest_at"])
                yield pa.RecordBatch.from_arrays([batch.column(0), found], ["rest", "state"])

        out = in_arrow(out, run, T.StructType([out.schema["rest"], state]))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and a struct ``_contamination``, one row per document, without a shuffle.

    Its fields: n_words; spans, a flat list of [start, end) word spans inside an occurrence of a
    ``window``-word window of an item (the whole item if it is shorter); n_hit; items, the sorted ids of
    items with an occurring window; longest, the words of the longest verbatim match with any item that is
    a window or more, and longest_at, its place in the document and in the item (of several, the first).  A-Z is lower-cased and words are
    runs of digits, a-z and non-ASCII characters.  Null or empty texts have no words; items with no
    words, a null id or a null text match nothing; repeated rows are judged alike; an empty benchmark
    hits nothing.
    """
    spans = F.col("state.spans")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.shiftright(F.size(spans), 1) - 1), F.lit(0).cast("long"), lambda s, i: s + spans[2 * i + 1] - spans[2 * i])
    n_hit = F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return _probed(docs, benchmark, window, block_words).select("rest.*", F.struct("state.*", n_hit.alias("n_hit")).alias(REPORT))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    c = REPORT
    return contamination(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col(f"{c}.n_hit") > 0).alias("contaminated"), f"{c}.longest",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with the columns they came with."""
    return _probed(docs, benchmark, **options).where(F.size("state.spans") == 0).select("rest.*")
