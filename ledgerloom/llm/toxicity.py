"""Toxicity by class-conditional Kneser-Ney models over the bytes of words."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, byte_column, drop_stored, fold, in_arrow, likely, numbered, release, stored

ORDER, DISCOUNT, THRESHOLD = 6, 0.75, 0.5
#: Words of the passages that the models are compared on.
PASSAGE = 2
#: (word before, word) pairs that a task holds before it sends them on.
HELD = 200_000
#: Rows that the calibration is fitted on at most.
CALIBRATION = 8_000
#: Entries of the model (12 bytes each) that are broadcast at once; a larger model is summed up in several passes.
MODEL_ENTRIES = 4_000_000
#: Bytes of text that are scored at once.
CHUNK = 1 << 20
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(ORDER + 1)], np.uint64)
#: Marks the key of a context, above the bytes of any n-gram.
CONTEXT = 1 << 56


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed ORDER-grams, word starts, words of each text): one gram for each byte of a word and the blank behind it.

    A gram's lowest byte is the byte foretold; its context never reaches back beyond the blank before
    the word, and is zero there.
    """
    split = [t.translate(WORDS).split() if t else [] for t in texts]
    n = np.array([len(x) for x in split], np.int64)
    s = np.frombuffer(b" " * ORDER + b"".join(w + b" " for x in split for w in x), np.uint8)
    body = len(s) - ORDER
    if not body:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    size = np.fromiter((len(w) + 1 for x in split for w in x), np.int64, int(n.sum()))
    start = np.cumsum(size) - size
    g = np.zeros(body, np.uint64)
    for k in range(ORDER):
        g |= s[ORDER - k : ORDER - k + body].astype(np.uint64) << np.uint64(8 * k)
    depth = np.minimum(np.arange(body) - np.repeat(start, size) + 2, ORDER)
    return g & _MASKS[depth], start, n


class Table:
    """Value of each key, 0 for a key that isn't there; 12 bytes for each key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, label)`` -> (word, toxic, plain): the distinct words that each word follows, by class, over all rows.

    So a word counts for the places that it is used in, and a text that is copied a thousand times once.
    The word before is told by 32 bits of hash: of a million distinct ones about a hundred go uncounted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: tuple[set, set] = (set(), set())

        def sent() -> Iterator[pa.RecordBatch]:
            for label, own in enumerate(pairs):
                rows = sorted(own, key=itemgetter(1))  # a word beside itself in the shuffle's files, which are compressed
                own.clear()
                for at in range(0, len(rows), 65_536):
                    key = [word + xxhash.xxh32_digest(before) for before, word in rows[at : at + 65_536]]
                    kinds = np.full(len(key), 1 << label, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(kinds)], ["key", "kinds"])

        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, part in byte_column(batch, "text"):
                for text, label in zip(part, labels[at : at + len(part)], strict=True):
                    words = text.translate(WORDS).split() if text else []
                    pairs[label > 0].update(zip([b"", *words[:-1]], words))
                    if len(pairs[0]) + len(pairs[1]) >= HELD:
                        yield from sent()
        yield from sent()

    found = in_arrow(docs, run, "key binary, kinds int")  # the word and the hash in one value: fewer bytes to deal out
    once = found.groupBy("key").agg(F.bit_or("kinds").alias("kinds"))
    once = once.select(F.substring("key", F.lit(1), F.length("key") - 4).cast("string").alias("word"), "kinds")
    bit = lambda n: F.sum(F.shiftright("kinds", n).bitwiseAND(F.lit(1)).cast("long"))
    return once.groupBy("word").agg(bit(1).alias("toxic"), bit(0).alias("plain"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``words(word, toxic, plain)`` -> (gram, toxic, plain): n-gram counts by class, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [batch.column(i).to_numpy() for i in (1, 2)]
            for at in range(0, batch.num_rows, 16_384):
                g, start, _ = grams(batch.column(0).slice(at, 16_384).cast(pa.binary()).to_pylist())
                size = np.diff(np.append(start, len(g)))
                order = np.argsort(g, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]])) if len(g) else order
                toxic, plain = (np.add.reduceat(np.repeat(w[at : at + 16_384], size)[order], cut) if len(g) else order for w in weight)
                yield pa.RecordBatch.from_arrays([pa.array(g[order][cut].view(np.int64)), pa.array(toxic), pa.array(plain)], ["gram", "toxic", "plain"])

    parts = in_arrow(words, run, "gram long, toxic long, plain long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def shared_backoff(counts: DataFrame, discount: float = DISCOUNT, order: int = ORDER) -> DataFrame:
    """(of_tail, shared): the distribution that both classes back off to, for the last ``order`` - 1 bytes of every n-gram.

    Interpolated Kneser-Ney on the pooled corpus, order by order from single bytes up: an n-gram counts
    once for each byte that it follows, and each order backs off to the next shorter one, the shortest
    to a uniform floor.
    """
    d = F.lit(discount)
    kinds = {order: counts.select(F.col("gram").alias("tail"))}
    for n in range(order - 1, 0, -1):
        tail = F.col("tail").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("tail")
        kinds[n] = stored(kinds[n + 1].groupBy(tail).agg(F.count("*").alias("kinds")))
    lower = None
    for n in range(1, order):
        stems = kinds[n].groupBy(F.shiftright("tail", 8).alias("stem")).agg(F.sum("kinds").alias("stem_kinds"), F.count("*").alias("stem_tails"))
        own = kinds[n].join(stems, F.shiftright("tail", 8) == F.col("stem"))
        below = F.lit(1 / 256)
        if lower is not None:
            own = own.join(lower, F.col("tail").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)) == F.col("of_tail"))
            below = F.col("shared")
        value = (F.greatest(F.col("kinds") - d, F.lit(0.0)) + d * F.col("stem_tails") * below) / F.col("stem_kinds")
        lower = own.select(F.col("tail").alias("of_tail"), value.alias("shared"))
    out = stored(lower)
    drop_stored(*[kinds[n] for n in range(1, order)])
    return out


def ratios(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(key, value): what each n-gram adds to the log-likelihood ratio of a text.

    A byte's ratio is log p(byte | context, toxic) - log p(byte | context, ordinary).  Each class has
    interpolated Kneser-Ney counts at the full order and backs off to the shared distribution.  Where a
    context was seen and the n-gram not, only the two backoff weights differ: their ratio is the value
    under the context's key (CONTEXT added); the n-gram's own key holds what its ratio has beyond that.
    So a ratio is the sum of two values, each 0 where its key was never seen.
    """
    d = F.lit(discount)
    shared = shared_backoff(counts, discount)
    counts = counts.withColumns({"context": F.shiftright("gram", 8), "tail": F.col("gram").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1))})
    sums = [F.sum(c).alias(f"{c}_n") for c in ("toxic", "plain")] + [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "plain")]
    contexts = counts.groupBy(F.col("context").alias("of_context")).agg(*sums)
    back = {c: F.when(F.col(f"{c}_n") > 0, d * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0) for c in ("toxic", "plain")}
    seen = lambda c: F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0) + back[c] * F.col("shared")
    full = counts.join(contexts, F.col("context") == F.col("of_context")).join(shared, F.col("tail") == F.col("of_tail"))
    backed = F.log(back["toxic"] / back["plain"])
    own = full.select(F.col("gram").alias("key"), (F.log(seen("toxic") / seen("plain")) - backed).cast("float").alias("value"))
    return own.union(contexts.select(F.col("of_context") + F.lit(CONTEXT), backed.cast("float")))


def byte_ratios(g: np.ndarray, table: Table) -> np.ndarray:
    """The part of each byte's ratio that a table, the whole model or a part of it, has."""
    return table[g.astype(np.int64)] + table[(g >> np.uint64(8)).astype(np.int64) + CONTEXT]


def word_sums(texts: list[bytes | None], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the ratios of each word's bytes, words of each text)."""
    g, start, n = grams(texts)
    return (np.add.reduceat(byte_ratios(g, table), start, dtype=np.float64) if len(g) else np.zeros(0)), n


def evidence(sums: np.ndarray, n: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """Of each text the highest log-likelihood ratio per word of ``passage`` words in a row (fewer: of all; none: 0)."""
    out, last = np.zeros(len(n)), np.cumsum(n)
    if not len(sums):
        return out
    total, first = np.concatenate([[0.0], np.cumsum(sums)]), np.arange(len(sums))
    text = np.repeat(np.arange(len(n)), n)
    stop = np.minimum(first + passage, last[text])
    mean = (total[stop] - total[first]) / (stop - first)
    mean[(stop - first < passage) & (first > (last - n)[text])] = -np.inf  # the tail of a longer text
    some = np.flatnonzero(n)
    out[some] = np.maximum.reduceat(mean, (last - n)[some])
    return out


def _chunks(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes | None]]:
    pending, size = [], 0
    for _, part in byte_column(batch, name, 16):
        pending += part
        size += sum(len(t) for t in part if t)
        if size >= CHUNK:
            yield pending
            pending, size = [], 0
    yield pending


def _blocks(model: DataFrame, entries: int) -> Iterator[Table]:
    """The stored model in tables of about ``entries`` keys, one after another; the driver holds one at a time."""
    blocks = max(1, -(-model.count() // entries))
    for k in range(blocks):
        own = model.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k) if blocks > 1 else model
        arrow = own.toArrow()
        yield Table(arrow.column(0).to_numpy(), arrow.column(1).to_numpy()), blocks


def with_evidence(docs: DataFrame, model: DataFrame, entries: int = MODEL_ENTRIES, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, evidence) of every document ``(doc_id, text)``, over whole texts.

    A model within ``entries`` is broadcast and the documents are read once, without a shuffle.  A larger
    one is broadcast in parts in turn: ratios are sums over the model's entries, so each pass adds its
    part to the word sums of each document, and passages are compared when all parts are in.
    """
    spark = docs.sparkSession
    rows, sums = None, None
    for table, blocks in _blocks(model, entries):
        shared = spark.sparkContext.broadcast(table)
        if blocks == 1:

            def whole(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = [evidence(*word_sums(part, shared.value), passage) for part in _chunks(batch, "text")]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "evidence"])

            return in_arrow(docs, whole, "doc_id long, evidence double")

        def part_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in _chunks(batch, "rest.text"):
                    value, n = word_sums(part, shared.value)
                    edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    own = [batch.column(1), batch.column(0).field("doc_id")]
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in own], pa.ListArray.from_arrays(pa.array(edge), pa.array(value))], ["row", "doc_id", "sums"])
                    at += len(part)

        rows = numbered(docs) if rows is None else rows
        own = in_arrow(rows.select("rest", "row"), part_of, "row long, doc_id long, sums array<double>")
        if sums is not None:
            before = sums.select(F.col("row").alias("of"), F.col("sums").alias("before"))
            own = own.join(before, F.col("row") == F.col("of")).select("row", "doc_id", F.zip_with("sums", "before", lambda x, y: x + y).alias("sums"))
        old, sums = sums, stored(own)
        if old is not None:
            drop_stored(old)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(1)
            n = np.diff(value.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence(value.values.to_numpy(), n, passage))], ["doc_id", "evidence"])

    return in_arrow(sums.select("doc_id", "sums"), best, "doc_id long, evidence double")


def calibrated(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic map, rising in the evidence, fitted by Newton steps with a slight ridge."""
    spread = float(evidence.std()) + 1e-9
    z = np.stack([(evidence - evidence.mean()) / spread, np.ones(len(evidence))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - toxic) + 0.1 * np.array([w[0], 0]))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    slope = max(float(w[0]), 1e-6) / spread
    return slope, float(w[1]) - slope * float(evidence.mean())


def toxicity_scores(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD, calibration: int = CALIBRATION, entries: int = MODEL_ENTRIES) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted; one row per document.

    The score is a rising map of one number: the difference of the log-likelihoods under the toxic and the
    ordinary model per word, in the passage of PASSAGE words where it is highest.  The map comes from at most ``calibration`` ids of fold 1 (those that hash lowest), counts from every other
    labelled row of folds 1 to 4; fold 0 is held out.  Null ids and labels teach nothing; an id labelled
    more than once has its highest label; repeated documents count each time.  Null, empty and wordless
    texts have no evidence and get the score of none; texts of any length are read whole; with no labelled
    rows, or one class only, every score is the smoothed share of toxic rows.  Only ``text`` is an input.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(column)).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # labels grow with the documents, so both sides are dealt by id at every size
    chosen = F.broadcast(known.where(fold("_id") == 1).orderBy(F.xxhash64("_id"), "_id").limit(calibration))
    taught = known.join(chosen.select(F.col("_id").alias("_held")), F.col("_id") == F.col("_held"), "left_anti")
    taught = stored(taught)
    learnt = likely(texts.where(fold() != 0), "doc_id", taught, "_id").join(taught.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "label")
    learnt = stored(learnt)
    release(docs.sparkSession)  # the texts dealt out, before their words are
    words = stored(word_counts(learnt))
    drop_stored(learnt)
    release(docs.sparkSession)
    counts = stored(gram_counts(words))
    model = stored(ratios(counts))
    drop_stored(taught, words, counts)
    release(docs.sparkSession)
    found = stored(with_evidence(texts, model, entries))
    rows = found.join(chosen, F.col("doc_id") == F.col("_id")).select("evidence", "label").orderBy(F.xxhash64("doc_id"), "evidence").limit(calibration).collect()
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] > 0 for r in rows], bool)
    if y.all() or not y.any():
        score = F.lit((float(y.sum()) + 1) / (len(y) + 2))
    else:
        slope, offset = calibrated(x, y.astype(float))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("evidence") * slope + offset))))
    return found.select("doc_id", (fold() == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
