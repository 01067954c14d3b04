"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bitmap, byte_column, in_arrow, numbered, stored
from .components import connected_components, local_components

SHINGLE, THRESHOLD = 8, 0.8
#: 10 bands of 4 minima: a pair at similarity 0.8 shares a band with probability 0.995.
BANDS, ROWS = 10, 4
#: Lines and characters that are compared in one task; larger groups are cut into blocks.
GROUP_LINES, GROUP_CHARS = 128, 1 << 20
#: So many times the lines of a group are held of either side when lines outside a class meet the others.
WIDE = 8
#: (band key, line) pairs that a task holds before it sends them on, and rows that it sends at once.
HELD, SENT = 500_000, 65_536
#: Ranges of band keys at least; a task holds the postings of one range at a time.
RANGES = 4096
#: Characters whose shingles are hashed at once, so that all arrays stay in the cache.
HASHED = 1 << 15
NONE = np.uint64(2**64 - 1)


_BLANKS = LOWER.translate(bytes(32 if b in b"\t\r\x0b\x0c" else b for b in range(256)))


def normal_lines(text: bytes | None) -> list[bytes]:
    """Lines cut at newlines; A-Z lower-cased, runs of ASCII blanks one blank, none at the ends."""
    if text is None:
        return []
    text = text.translate(_BLANKS)
    if b"  " in text or b" \n" in text or b"\n " in text or text[:1] == b" " or text[-1:] == b" ":
        return [b" ".join(line.split()) for line in text.split(b"\n")]
    return text.split(b"\n")


def line_id(line: bytes) -> int:
    """64-bit id of a normalised line, signed; 0 is a blank line's."""
    return int.from_bytes(xxhash.xxh3_64_digest(line), "big", signed=True) or 1 if line else 0


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _shingle_hashes(chars: np.ndarray) -> np.ndarray:
    """Of the SHINGLE characters from each place on, by doubling; behind the end counts as blank."""
    h = np.zeros(len(chars) + SHINGLE, np.uint64)
    np.add(chars, np.uint64(1), out=h[: len(chars)])
    for k, step in enumerate((1, 2, 4)):
        before, h = h, h[:-step] * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[k])
        h += before[step:]
    return _mixed(h[: len(chars)])


def _chars(lines: list[bytes]) -> np.ndarray:
    """Code points of the lines, a newline behind each."""
    text = b"\n".join([*lines, b""])
    return np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def shingles(line: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a normalised line; a shorter line is one shingle, a blank one none."""
    chars = np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    h = _shingle_hashes(chars)
    return np.unique(h[: max(1, len(chars) - SHINGLE + 1)]) if len(chars) else np.zeros(0, np.uint64)


def _line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all lines, end to end, shingles of each line); those of shorter lines also hash what follows."""
    chars = _chars(lines)
    end = np.flatnonzero(chars == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    n = np.maximum(end - begin - SHINGLE + 1, 1)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
    return _shingle_hashes(chars)[at], n


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """:func:`shingles` of many lines at once; none may hold a newline."""
    if not lines:
        return []
    h, n = _line_hashes(lines)
    edge = np.cumsum(n)
    for a, b in zip((edge - n).tolist(), edge.tolist(), strict=True):
        h[a:b].sort()
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new[edge[:-1]] = True
    kept = np.cumsum(np.add.reduceat(new.view(np.int8), edge - n, dtype=np.int64))
    sets = np.split(h[new], kept[:-1])
    for i in np.flatnonzero(n == 1).tolist():
        sets[i] = shingles(lines[i])
    return sets


def _minima(lines: list[bytes], out: np.ndarray) -> None:
    """Into ``out`` (lines, bins): the smallest hash of the shingles in each bin, else NONE."""
    chars, bins = _chars(lines), np.uint64(out.shape[1])
    end = np.flatnonzero(chars == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    h = _shingle_hashes(chars)
    at = h >> np.uint64(40)
    at *= bins
    at >>= np.uint64(24)
    at += np.repeat(np.arange(len(lines), dtype=np.uint64) * bins, end - begin + 1)
    h &= np.uint64((1 << 40) - 1)
    beyond = end[:, None] - np.arange(SHINGLE)  # no shingle of the line starts there
    h[beyond[beyond > begin[:, None]]] = NONE
    np.minimum.at(out.reshape(-1), at.view(np.int64), h)


@cache
def _bin_order(attempt: int) -> np.ndarray:
    return np.random.default_rng(attempt).permutation(BANDS * ROWS)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys from one-permutation MinHash with ROWS * BANDS bins, empty ones densified."""
    sig = np.full((len(lines), BANDS * ROWS), NONE)
    upto, at = np.cumsum([len(x) for x in lines]), 0
    while at < len(lines):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HASHED, "right")))
        _minima(lines[at:stop], sig[at:stop])
        at = stop
    rows = np.flatnonzero((sig == NONE).any(axis=1))
    source, attempt = sig[rows].copy(), 0
    while len(rows):
        order, part = _bin_order(attempt), sig[rows]
        sig[rows] = np.where(part == NONE, source[:, order], part)
        left = (sig[rows] == NONE).any(axis=1)
        rows, source, attempt = rows[left], source[left], attempt + 1
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for r in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(-1, BANDS, ROWS)[:, :, r])
    return key.view(np.int64)


def _ends(a: np.ndarray, b: np.ndarray) -> bytes:
    return np.concatenate([a, b]).astype("<i8", copy=False).tobytes()


def _postings(docs: DataFrame) -> DataFrame:
    """(range, links, ends): band keys of one range and the lines posted under them, or links met inside the task.

    ``ends`` holds two arrays of 64-bit integers end to end, so that the JVM deals out few rows.  Of lines
    that share a band key inside a task, one is posted and the others are linked to it, so even the hottest
    key has few postings for each task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = parts * -(-RANGES // parts)

    def combined(key: np.ndarray, lid: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
        order = np.argsort(key.view(np.uint64))
        key, lid = key[order], lid[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = lid[np.maximum.accumulate(np.where(new, np.arange(len(lid)), 0))]
        u, v = first[~new], lid[~new]
        key, lid = key[new], lid[new]
        place = (((key.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        edge = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for at, stop in zip(edge, edge[1:], strict=False):
            yield int(place[at]), False, _ends(key[at:stop], lid[at:stop])
        for at in range(0, len(u), 1024):
            yield int(v[at] % ranges), True, _ends(u[at : at + 1024], v[at : at + 1024])

    def sent(keys: list[np.ndarray], lids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = list(combined(np.concatenate(keys), np.concatenate(lids)))
        for at in range(0, len(rows), 1024):
            part = [pa.array(x, kind) for x, kind in zip(zip(*rows[at : at + 1024], strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(part, ["range", "links", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, lids, held = set(), [], [], 0
        for batch in batches:
            for _, part in byte_column(batch, "text"):
                new = {}
                for t in part:
                    for line in normal_lines(t):
                        if len(line) >= SHINGLE and (lid := line_id(line)) not in seen:
                            new[lid] = line
                            seen.add(lid)
                if new:
                    keys.append(band_keys(list(new.values())).ravel())
                    lids.append(np.repeat(np.fromiter(new, np.int64, len(new)), BANDS))
                    held += len(lids[-1])
                if held >= HELD:
                    yield from sent(keys, lids)
                    seen, keys, lids, held = set(), [], [], 0
        if held:
            yield from sent(keys, lids)

    return in_arrow(docs.select("text"), run, "range int, links boolean, ends binary").repartition(parts, "range").sortWithinPartitions("range")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by range -> (u, v): each line of a key beside the first to come, and the links as they came."""
    last, keys, lids = None, [], []

    def sent(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(u), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + SENT]) for x in (u, v)], ["u", "v"])

    def close() -> Iterator[pa.RecordBatch]:
        key, lid = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (keys, lids))
        order = np.argsort(key, kind="stable")
        key, lid = key[order], lid[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        first = lid[np.maximum.accumulate(np.where(new, np.arange(len(lid)), 0))]
        other = first != lid
        yield from sent(first[other], lid[other])

    for batch in batches:
        for place, links, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.frombuffer(ends, "<i8").reshape(2, -1)
            if links:
                yield from sent(a, b)
                continue
            if place != last:
                yield from close()
                last, keys, lids = place, [], []
            keys.append(a)
            lids.append(b)
    yield from close()


def _jaccard_links(lids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join a group's lines as all its links would; a line is compared until it is reached."""
    sizes = np.array([len(x) for x in sets])
    if len(lids) == 2:
        a, b = sorted(sets, key=len)
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return [(lids[0], lids[1])] if shared >= threshold * (len(a) + len(b) - shared) - 1e-9 else []
    kinds, dense = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(len(kinds), bool)
    out, rest, todo, held, built = [], np.arange(1, len(lids)), [0], None, 0
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        if held is None or 2 * len(rest) < built:  # the lines not reached, end to end
            at = np.concatenate([np.arange(begin[i], begin[i] + sizes[i]) for i in rest])
            held, lines, built = dense[at], rest, len(rest)
            edge = np.cumsum(sizes[lines]) - sizes[lines]
        p = todo.pop()
        own = dense[begin[p] : begin[p] + sizes[p]]
        mark[own] = True
        shared = np.add.reduceat(mark[held].view(np.int8), edge, dtype=np.int64)
        mark[own] = False
        near = lines[shared >= threshold * (sizes[p] + sizes[lines] - shared) - 1e-9]
        near = near[np.isin(near, rest)]
        if len(near):
            out += [(lids[p], lids[i]) for i in near.tolist()]
            todo += near.tolist()
            rest = rest[~np.isin(rest, near)]
    return out


def _cross_links(lids: list[int], sets: list[np.ndarray], classes: list[int], probes: list[bool], threshold: float) -> list[tuple[int, int]]:
    """Links from the probes that join classes as all links would; classes once joined are one, so links are fewer than classes."""
    sizes, label = np.array([len(x) for x in sets]), np.array(classes)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.cumsum(sizes) - sizes
    mark, out = np.zeros(int(dense.max()) + 1, np.int8), []
    for p in np.flatnonzero(probes).tolist():
        own = dense[edge[p] : edge[p] + sizes[p]]
        mark[own] = 1
        shared = np.add.reduceat(mark[dense], edge, dtype=np.int64)
        mark[own] = 0
        near = np.flatnonzero((shared >= threshold * (sizes[p] + sizes - shared) - 1e-9) & (label != label[p]))
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            out += [(lids[p], lids[i]) for i in near[first].tolist()]
            label[np.isin(label, met)] = label[p]
    return out


def _verify(threshold: float, cross: bool = False):
    """Rows (group, pair, lid, class, probe, line) sorted by group -> (group, u, v) of each; a group may cross batches, and is bounded.

    Not ``cross``: u is the smallest line that v is joined to inside the group; a line joined to none or the
    smallest itself has no row.
    ``cross``: a link from the probe u to the line v of another class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lids, sets, classes, probes, out = None, [], [], [], [], []

        def close() -> list[tuple[int, int, int]]:
            if not lids:
                return []
            if cross:
                return [(group[0], u, v) for u, v in _cross_links(lids, sets, classes, probes, threshold)]
            links = np.array(_jaccard_links(lids, sets, threshold) if len(lids) > 1 else [], np.int64).reshape(-1, 2)
            node, root = local_components(links[:, 0], links[:, 1])
            return [(group[0], u, v) for v, u in zip(node.tolist(), root.tolist(), strict=True) if u != v]

        def sent(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["group", "u", "v"])

        for batch in batches:
            for at, part in byte_column(batch, "line"):
                rows = zip(*(batch.column(i).slice(at, len(part)).to_pylist() for i in range(5)), shingle_sets(part), strict=True)
                for key, pair, lid, label, probe, own in rows:
                    if (key, pair) != group:
                        out += close()
                        group, lids, sets, classes, probes = (key, pair), [], [], [], []
                    lids.append(lid)
                    sets.append(own)
                    classes.append(label)
                    probes.append(probe)
            yield sent(out)
            out = []
        yield sent(close())

    return run


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap over hashed line ids, its bits): a line it doesn't hold is no candidate; 32 MB at most."""
    pages, size = bitmap(ids, "node")
    out = np.zeros(size // 8, np.uint8)
    for r in pages.collect():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out, size


def _occurrences(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(row, doc_id, line, lid, text) of every line that isn't blank; each task gives the text of a candidate line once, or a few times."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, size), seen = shared.value, set()
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            for at, part in byte_column(batch, "text"):
                found = [normal_lines(t) for t in part]
                n = np.array([len(x) for x in found], np.int64)
                lines = [x for own in found for x in own]
                lid = np.fromiter(map(line_id, lines), np.int64, len(lines))
                which = np.repeat(np.arange(at, at + len(part)), n)
                line = np.arange(len(lid)) - np.repeat(np.cumsum(n) - n, n)
                bit = (xxh64_long(lid) % np.int64(size)).astype(np.int64)
                texts = [None] * len(lines)
                for i in np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool) & (lid != 0)).tolist():
                    if lid[i] not in seen:
                        seen.add(lid[i])
                        texts[i] = lines[i].decode("utf-8", "replace")
                if len(seen) > HELD // BANDS:
                    seen = set()
                out = pa.RecordBatch.from_arrays([pa.array(rows[which]), ids.take(pa.array(which)), pa.array(line.astype(np.int32)), pa.array(lid), pa.array(texts, pa.string())], ["row", "doc_id", "line", "lid", "text"])
                yield out.filter(pa.array(lid != 0))

    return in_arrow(docs, run, "row long, doc_id long, line int, lid long, text string")


def _candidate_texts(seen: DataFrame, marked: DataFrame) -> DataFrame:
    """(component, lid, line) of every candidate line, once."""
    # a common line comes from many tasks: one of its copies is taken before anything else is done with it
    found = seen.where("text is not null").groupBy("lid").agg(F.first("text").alias("line"))
    return found.join(marked, F.col("lid") == F.col("node")).select("component", "lid", "line")


def _rebanded(lines: DataFrame) -> DataFrame:
    """(group, lid, line): a row for each band key of each line, the key being the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in byte_column(batch, "line", 64, 1 << 16):
                which = pa.array(np.repeat(np.arange(at, at + len(part)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(part).ravel()), *[batch.column(i).take(which) for i in (0, 1)]], ["group", "lid", "line"])

    return in_arrow(lines.select("lid", "line"), run, "group long, lid long, line string")


def xxh64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, as Spark's ``xxhash64`` computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (rot(values.view(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _blocks(lines: DataFrame, key: str) -> DataFrame:
    """(of, blocks, wide): for each group, the blocks that hold its lines within GROUP_LINES (wide: WIDE times that) and GROUP_CHARS each, about."""
    size = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / n, F.sum(F.length("line")) / GROUP_CHARS))).cast("int")
    return lines.groupBy(F.col(key).alias("of")).agg(size(GROUP_LINES).alias("blocks"), size(WIDE * GROUP_LINES).alias("wide"))


def _compared(groups: DataFrame, threshold: float, cross: bool = False) -> DataFrame:
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.select("group", "pair", "lid", "class", "probe", "line")
    return in_arrow(rows.repartition(parts, "group", "pair").sortWithinPartitions("group", "pair", "lid"), _verify(threshold, cross), "group long, u long, v long")


def _plain_groups(rows: DataFrame, pair: Column) -> DataFrame:
    return rows.select("group", pair.alias("pair"), "lid", F.col("lid").alias("class"), F.lit(True).alias("probe"), "line")


def verified_links(texts: DataFrame, threshold: float) -> DataFrame:
    """Stored (component, lid, line) of all candidates -> links (u, v) that join the lines as all links of candidates do.

    A candidate component within GROUP_LINES and GROUP_CHARS is one group, all its lines compared.  The
    lines of a larger one are grouped by band key, which is what makes two lines candidates, and a group
    still larger is taken in three steps, none of which holds more than a block or two: the lines of each
    block are compared; then one line of each class found so; then every line outside the group's largest
    class, with the lines of other classes in each of fewer, wider blocks.  So no link between classes is
    lost, and only this step copies lines: those outside the largest class once for each WIDE * GROUP_LINES
    lines of the group, the others once for as many of the former.
    """
    sizes = stored(_blocks(texts, "component"))
    marked = texts.join(sizes, F.col("component") == F.col("of"))
    small = marked.where("blocks = 1").withColumnRenamed("component", "group")
    links = _compared(_plain_groups(small, F.lit(0).cast("long")), threshold).select("u", "v")
    if not sizes.where("blocks > 1").limit(1).count():
        return links
    rows = stored(_rebanded(marked.where("blocks > 1")))
    sizes = stored(_blocks(rows, "group"))
    block = F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("long")
    rows = stored(rows.join(sizes, F.col("group") == F.col("of")).select("group", "lid", "line", "blocks", "wide", block.alias("block")))
    within = stored(_compared(_plain_groups(rows, F.col("block")), threshold))
    links = links.union(within.select("u", "v"))
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        return links
    classed = _classed(large, within)
    heads = classed.where("lid = class").select("group", "lid", "line")
    heads = heads.join(_blocks(heads, "group"), F.col("group") == F.col("of")).select("group", "lid", "line", block.alias("block"))
    between = stored(_compared(_plain_groups(heads, F.col("block")), threshold))
    links = links.union(between.select("u", "v"))
    heads = between.select(F.col("group").alias("of"), F.col("v").alias("head"), F.col("u").alias("joined"))
    classed = classed.join(heads, (F.col("group") == F.col("of")) & (F.col("class") == F.col("head")), "left")
    classed = stored(classed.select(*large.columns, F.coalesce("joined", "class").alias("class")))
    counts = classed.groupBy("group", "class").agg(F.count("*").alias("n"))
    largest = counts.groupBy(F.col("group").alias("of")).agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    rest = stored(classed.join(largest, F.col("group") == F.col("of")).where("class <> largest").drop("of", "largest"))
    if not rest.limit(1).count():
        return links
    cuts = stored(_blocks(rest, "group").select("of", F.col("wide").alias("cuts")))
    at = F.pmod(F.xxhash64("lid"), F.col("wide")).cast("long")
    own = F.pmod(F.xxhash64("lid", F.lit(1)), F.col("cuts")).cast("long")
    place = lambda cut, at: (cut * F.lit(1 << 31) + at).alias("pair")
    probes = rest.join(cuts, F.col("group") == F.col("of")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide").cast("long") - 1)).alias("to"))
    probes = probes.select("group", place(own, F.col("to")), "lid", "class", F.lit(True).alias("probe"), "line")
    others = classed.join(cuts, F.col("group") == F.col("of")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)).alias("to"))
    others = others.select("group", place(F.col("to"), at), "lid", "class", F.lit(False).alias("probe"), "line")
    return links.union(_compared(probes.union(others), threshold, cross=True).select("u", "v"))


def _classed(rows: DataFrame, within: DataFrame) -> DataFrame:
    """``rows`` with the class that each line has inside its group."""
    own = within.select(F.col("group").alias("of"), F.col("v").alias("own"), F.col("u").alias("class"))
    return rows.join(own, (F.col("group") == F.col("of")) & (F.col("lid") == F.col("own")), "left").select(*rows.columns, F.coalesce("class", "lid").alias("class"))


def line_removals(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, removed): for each document that loses lines, their numbers and the doc_ids of the lines kept."""
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stored(connected_components(in_arrow(_postings(docs), _candidates, "u long, v long")))
    seen = stored(_occurrences(docs, marked))
    near = stored(connected_components(verified_links(stored(_candidate_texts(seen, marked)), threshold)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    # by line first, so that only lines with a near twin are dealt out by class
    lines = seen.groupBy("lid").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(near, F.col("lid") == F.col("node"), "left")
    lines = stored(lines.where("n > 1 or component is not null").select("lid", "component", "first"))
    classes = stored(lines.where("component is not null").groupBy(F.col("component").alias("class")).agg(F.min("first").alias("earliest")))
    kept = lines.join(classes, F.col("component") == F.col("class"), "left").select("lid", F.coalesce("earliest", "first").alias("kept"))
    kept = stored(kept)  # joined on its own, so that the rows of a hot line are split over tasks
    gone = seen.drop("text").join(kept, "lid").where(place != F.col("kept"))
    return gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", F.col("kept.doc_id").alias("kept_in")))).alias("removed"))


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with fuzzily repeated lines taken out of ``text``, and ``_lines``: one row per document.

    Lines are cut at newlines and compared with A-Z lower-cased and blanks squeezed.  Two lines are
    linked when the Jaccard similarity of their 8-character shingle sets is ``threshold`` or more (a
    shorter line only equals itself); one line of each connected component stays, the one with the
    smallest doc_id (null last), then table row, then line number.  Blank lines always stay.
    ``_lines`` has n_lines, n_kept and removed (line, kept_in: doc_id of the line kept).  A null text
    stays null with no lines; an empty one has one blank line; very long texts and lines are read whole;
    repeated rows count as documents of their own; other columns pass through.  Rows are written once
    with their ids, so ``docs`` may be any plan.
    """
    rows = numbered(docs.withColumn("text", F.col("text").cast("string")))
    gone = line_removals(rows.select("row", "rest.doc_id", "rest.text"), threshold).withColumnRenamed("row", "of_row")
    joined = rows.join(gone, F.col("row") == F.col("of_row"), "left").select("rest", F.coalesce("removed", F.array().cast("array<struct<line:int,kept_in:bigint>>")).alias("removed"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, removed = batch.column(0), batch.column(1)
            texts, n, kept = [], [], []
            for at, part in byte_column(batch, "rest.text"):
                for text, own in zip(part, removed.slice(at, len(part)).to_pylist(), strict=True):
                    lines = text.count(b"\n") + 1 if text is not None else 0
                    gone = {r["line"] for r in own}
                    texts.append(b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in gone]) if gone else text)
                    n.append(lines)
                    kept.append(lines - len(gone))
            names = [f.name for f in rest.type]
            parts = dict(zip(names, rest.flatten(), strict=True))
            parts["text"] = pa.array(texts, pa.binary()).cast(parts["text"].type)
            info = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(kept, pa.int64()), removed], ["n_lines", "n_kept", "removed"])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(parts.values()), names), info], ["rest", "lines"])

    info = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType()), joined.schema["removed"]])
    return in_arrow(joined, rebuilt, T.StructType([joined.schema["rest"], T.StructField("lines", info)])).select("rest.*", F.col("lines").alias("_lines"))
