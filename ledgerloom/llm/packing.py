"""Best-fit packing of tokenised documents by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, stored

CAPACITY, END_ID = 2048, 0
#: Fillings that branch-and-bound looks at, beside the dives, before the best incumbent is taken; None: until it is optimal.
NODES = 5_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the rest follow at 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Little-endian 32-bit ids of whole texts, those of ``tokenizers`` with add_special_tokens=False.

    Special tokens that stand in a text are their own ids.  A byte-level BPE file that says what tiktoken
    computes (no prefix blank, merges in the order of ids, special tokens taken as they stand) is run by
    tiktoken, three times as fast, at every length of text; any other file by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
        self.fast = self._same_by_ranks(path)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)

    def _same_by_ranks(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        if model.get("type") != "BPE" or not level or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            return None
        special = {t["content"]: t["id"] for t in added}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)) or min(merged) != len(model["vocab"]) - len(special.keys() & model["vocab"].keys()) - len(merged):
            return None
        import public_tokenizers
        import tiktoken

        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() if text else b""


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _at[, ids]) of every document, cut only where longer than ``capacity``.

    ``_at`` numbers the pieces of a length within the task.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "_at")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = _encoder(path), [0] * (capacity + 1)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                rows = []
                for doc_id, text in zip(doc_ids[at : at + 128], texts.slice(at, 128).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + int(end_id).to_bytes(4, "little")
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = ids[4 * s : 4 * e]
                        rows.append((doc_id, k, s, e - s, zlib.crc32(own), met[e - s], *([np.frombuffer(own, "<u4").astype(np.int32)] if keep_ids else [])))
                        met[e - s] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [f.name for f in fields])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, T.StructType(fields))


class Branch:
    """A bin around the largest piece left: what was there, and the fillings not tried yet, made only when they are asked for."""

    __slots__ = ("bins", "counts", "done", "others", "waste")

    def __init__(self, counts: np.ndarray, bins: int, waste: int, done: int):
        self.counts, self.bins, self.waste, self.done = counts, bins, waste, done
        self.others: Iterator[tuple[tuple[int, ...], int]] | None = None


class BinCompletion:
    """Packs a histogram {length: count}; equal bins taken together are one pattern with a multiplicity.

    The bin around the largest length left is completed by a filling; every choice after the largest
    piece is a branch.  The first dive takes the best fit at each branch and gives the first incumbent.
    Then the branches of that very dive are reopened, the deepest first: all undominated fillings, least
    waste first, each for every number of equal bins; behind each the best fit dives again.  A branch is
    cut where its waste proves that it can't beat the incumbent, and where the same pieces were left
    before with as few bins.  Without limit (``nodes`` None) the result is optimal; else, after ``nodes``
    fillings looked at, the incumbent stands, unless it has met the lower bound and is optimal anyway.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES):
        self.capacity, self.nodes, self.looked = capacity, nodes, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.counts[size] = n
        self.total = int((np.arange(capacity + 1) * self.counts).sum())
        self.bound = self.lower_bound()
        self.best: list[tuple[tuple[int, ...], int]] = []
        self.bins = sys.maxsize

    def lower_bound(self) -> int:
        """Bins that any packing has: by total length, and by pieces that can't share with pieces of k or more (Martello, Toth)."""
        size = np.arange(self.capacity + 1)
        n, length, half = np.cumsum(self.counts), np.cumsum(size * self.counts), self.capacity // 2
        k = np.arange(half + 1)
        alone, large = n[-1] - n[self.capacity - k], n[-1] - n[half]
        room = (n[self.capacity - k] - n[half]) * self.capacity - (length[self.capacity - k] - length[half])
        small = length[half] - length[k] + k * self.counts[k]
        return int(max(-(-self.total // self.capacity), (large + np.maximum(0, -(-(small - room) // self.capacity))).max(), alone.max()))

    def best_fit(self, counts: np.ndarray, room: int) -> tuple[int, ...]:
        """Of the fillings that open with any length and go on with the largest that fits: least waste, fewest pieces."""
        have = np.flatnonzero(counts[: room + 1])
        if not len(have):
            return ()
        fit = np.zeros(room + 1, np.int64)
        fit[have] = have
        fit = np.maximum.accumulate(fit)  # the largest length that fits
        left = room - have
        n = np.zeros(len(have), np.int64)
        while True:
            piece = fit[left]
            if not piece.any():
                break
            left = left - piece
            n += piece > 0
        rank = left * (room + 1) + n
        for _ in range(len(have)):
            i = int(rank.argmin())
            out = [int(have[i])]
            while piece := int(fit[room - sum(out)]):
                out.append(piece)
            if all(counts[x] >= out.count(x) for x in out):
                return tuple(sorted(out, reverse=True))
            rank[i] = np.iinfo(np.int64).max
        out = []
        for x in have[::-1].tolist():  # no such filling has enough of each length
            k = min(int(counts[x]), room // x)
            out += [x] * k
            room -= k * x
        return tuple(out)

    @staticmethod
    def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, tuple[int, ...], bool]]:
        """(waste, lengths, undominated) of all sets of pieces that fit ``room``, least waste first, made one by one."""
        have = np.flatnonzero(counts[: room + 1]).tolist()
        mask, reach = (1 << (room + 1)) - 1, [1]  # bit s of reach[k]: some pieces of the k smallest lengths add up to s
        for x in have:
            sums, n, step = reach[-1], int(counts[x]), 1
            while n:
                step = min(step, n)
                sums |= (sums << (x * step)) & mask
                n, step = n - step, 2 * step
            reach.append(sums)

        def made(upto: int, target: int) -> Iterator[list[int]]:
            if not target:
                yield []
                return
            for k in range(upto - 1, -1, -1):
                x = have[k]
                for n in range(min(int(counts[x]), target // x), 0, -1):
                    if reach[k] >> (target - n * x) & 1:
                        for rest in made(k, target - n * x):
                            yield [x] * n + rest

        for waste in range(room + 1):
            if reach[-1] >> (room - waste) & 1:
                for found in made(len(have), room - waste):
                    yield waste, tuple(found), not BinCompletion.dominated(counts, have, found, waste)

    @staticmethod
    def dominated(counts: np.ndarray, have: list[int], filling: list[int], waste: int) -> bool:
        """Some pieces of it, or none, can be swapped for one longer piece that fits, or several for one as long as they are together."""
        spare = 0
        for x in have:
            spare |= (int(counts[x]) > filling.count(x)) << x
        some, several = 0, 0
        for x in filling:
            several |= (some | several) << x
            some |= some << x | 1 << x
        upto, width, smeared = waste, 1, some | 1
        while upto:  # sums with 0 to waste added
            step = min(width, upto)
            smeared |= smeared << step
            upto, width = upto - step, 2 * width
        longer = smeared & spare & ~some
        if longer or several & spare:
            return True
        # a sum that is itself a spare length may still give way to a longer one
        smeared, upto, width = some << 1 if waste else 0, max(waste - 1, 0), 1
        while upto:
            step = min(width, upto)
            smeared |= smeared << step
            upto, width = upto - step, 2 * width
        return bool(smeared & spare)

    def _times(self, counts: np.ndarray, largest: int, filling: tuple[int, ...]) -> int:
        own = (largest, *filling)
        return min(int(counts[x]) // own.count(x) for x in {*own})

    def _others(self, branch: Branch) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(branch.counts)[-1])
        after = branch.counts.copy()
        after[largest] -= 1
        for waste, filling, good in self.fillings(after, self.capacity - largest):
            self.looked += 1
            if self.nodes is not None and self.looked >= self.nodes or waste > self._spare() - branch.waste:
                return
            if good:
                for n in range(self._times(branch.counts, largest, filling), 0, -1):
                    if n * waste <= self._spare() - branch.waste:
                        yield filling, n

    def _spare(self) -> int:
        """Waste that a packing better than the incumbent can have."""
        return (self.bins - 1) * self.capacity - self.total

    def solve(self) -> list[tuple[tuple[int, ...], int]]:
        """[(lengths, largest first; bins)]: the best packing found."""
        path: list[Branch] = []
        done: list[tuple[tuple[int, ...], int]] = []
        met: dict[bytes, int] = {}
        counts, bins, waste, chosen = self.counts.copy(), 0, 0, None
        while True:
            while True:
                have = np.flatnonzero(counts)
                if not len(have):
                    if bins < self.bins:
                        self.bins, self.best = bins, list(done)
                    break
                if self.best and waste > self._spare():
                    break
                largest = int(have[-1])
                if chosen is None:
                    state = xxhash.xxh3_128_digest(counts.tobytes())
                    if met.get(state, sys.maxsize) <= bins:
                        break
                    met[state] = bins
                    path.append(Branch(counts, bins, waste, len(done)))
                    after = counts.copy()
                    after[largest] -= 1
                    filling = self.best_fit(after, self.capacity - largest)
                    times = self._times(counts, largest, filling)
                else:
                    (filling, times), chosen = chosen, None
                counts = counts.copy()
                np.subtract.at(counts, [largest, *filling], times)
                bins, waste = bins + times, waste + times * (self.capacity - largest - sum(filling))
                done.append(((largest, *filling), times))
            if self.bins <= self.bound:
                return self.best
            while path and chosen is None and (self.nodes is None or self.looked < self.nodes):
                branch = path[-1]
                branch.others = branch.others or self._others(branch)
                chosen = next(branch.others, None)
                if chosen is None:
                    path.pop()
            if chosen is None:
                return self.best
            counts, bins, waste = branch.counts, branch.bins, branch.waste
            del done[branch.done :]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, first rank, ranks, first sequence, copies in a bin, their offsets) of each length of each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, bins in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            first = taken.get(x, 0)
            out.append((x, first, bins * len(places), sequence, len(places), places))
            taken[x] = first + bins * len(places)
        sequence += bins
    return out


class Places:
    """Where the pieces of each length go, by rank: the slots as flat arrays, found by binary search.

    At most ``capacity`` lengths and a pattern for each that a step uses up, so its size follows the
    histogram of lengths, not the documents.
    """

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        found = sorted(slots(patterns))
        self.key = np.array([(x << 44) + first for x, first, *_ in found], np.int64)
        self.first, self.sequence, self.copies = (np.array([f[k] for f in found], np.int64) for k in (1, 3, 4))
        self.offsets = np.array([o for f in found for o in f[5]], np.int64)
        self.at = np.cumsum(self.copies) - self.copies

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        bins, copy = np.divmod(rank - self.first[i], self.copies[i])
        return self.sequence[i] + bins, self.offsets[self.at[i] + copy]


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, nodes: int | None = NODES) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document is the ids of its text (null: empty) and ``end_id``; only documents longer than
    ``capacity`` are cut, into full pieces behind a first one that may be shorter.  The driver sees the
    histogram of lengths alone (at most ``capacity`` rows) and solves it by bin completion; executors
    number the pieces of each length and look their place up.  Empty tables give no rows; repeated
    rows are packed each; texts of any length are encoded whole; null doc_ids are kept; other columns are
    not read.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, path or tokenizer_path(), capacity, end_id, keep_ids).withColumn("_part", F.spark_partition_id()))
    by_part = stored(made.groupBy("length", "_part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(Places(BinCompletion(counts, capacity, nodes).solve()))
    before = by_part.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = made.join(before, ["length", "_part"]).select(*own, (F.col("_at") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            sequence, offset = places(batch.column(3).to_numpy(), batch.column(len(own)).to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    out = in_arrow(ranked, place, T.StructType([*ranked.schema.fields[: len(own)], *added]))
    return out.select(*own[:5], "sequence_id", "offset", *own[5:])
