"""Quality classifier: naive Bayes support vectors over byte and word-shape n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_column, fold, in_arrow, wrapped

#: Hashed n-gram indicators.
DIMENSIONS = 1 << 18
#: Labelled rows that the classifier is fitted on at most: those whose ids hash lowest.
SAMPLE = 8_000
EPOCHS, COST, SMOOTHING, THRESHOLD = 8, 1.0, 1.0, 0.3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return (h >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def _flag(lut_of) -> np.ndarray:
    return np.array([lut_of(b) for b in range(256)], np.int64)


IS_BLANK = _flag(lambda b: b in b" \t\n\r\x0b\x0c")
IS_UPPER = _flag(lambda b: 65 <= b <= 90)
IS_LOWER = _flag(lambda b: 97 <= b <= 122 or b >= 0x80)
IS_DIGIT = _flag(lambda b: 48 <= b <= 57)
IS_MARK = _flag(lambda b: 33 <= b < 127 and not chr(b).isalnum())


def _some(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, 3)


def features(text: bytes | None, scratch: np.ndarray) -> np.ndarray:
    """Distinct hashed indicators of a whole text: byte trigrams, and 1- to 3-grams of word shapes.

    A word's shape counts its upper-case and lower-case letters, digits and marks up to three each and
    says whether it repeats the word before.  ``scratch`` has DIMENSIONS int64 cells of any content.
    """
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text, np.uint8)
    found = []
    if len(b) > 2:
        w = b.astype(np.uint64)
        found.append(_slots(w[:-2] | (w[1:-1] << np.uint64(8)) | (w[2:] << np.uint64(16)) | np.uint64(1 << 40)))
    blank = IS_BLANK[b]
    edge = np.diff(np.concatenate([[1], blank, [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        count = lambda lut: _some(np.add.reduceat(np.append(lut[b], 0), np.stack([start, end], axis=1).ravel())[::2])
        shape = count(IS_UPPER) | count(IS_LOWER) << 2 | count(IS_DIGIT) << 4 | count(IS_MARK) << 6
        size = end - start
        again = np.zeros(len(start), bool)
        for i in np.flatnonzero((size[1:] == size[:-1]) & (shape[1:] == shape[:-1]) & (b[start[1:]] == b[start[:-1]])).tolist():
            again[i + 1] = text[start[i] : end[i]] == text[start[i + 1] : end[i + 1]]
        s = (shape | again.astype(np.int64) << 8 | 1 << 9).astype(np.uint64)
        found.append(_slots(s | np.uint64(1 << 41)))
        if len(s) > 1:
            two = s[:-1] | (s[1:] << np.uint64(10))
            found.append(_slots(two | np.uint64(1 << 42)))
            if len(s) > 2:
                found.append(_slots(two[:-1] | (s[2:] << np.uint64(20)) | np.uint64(1 << 43)))
    f = np.concatenate(found) if found else np.zeros(0, np.int64)
    order = np.arange(len(f))
    scratch[f] = order
    return f[scratch[f] == order]  # one of each: the last write stands


class SupportVectors:
    """NBSVM: indicators scaled by class log-count ratios, unit length, hinge loss, dual coordinate descent."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST):
        y = np.where(labels > 0, 1.0, -1.0)
        counts = [np.full(DIMENSIONS, SMOOTHING), np.full(DIMENSIONS, SMOOTHING)]
        for f, label in zip(rows, labels, strict=True):
            counts[int(label > 0)][f] += 1
        n = np.bincount((labels > 0).astype(int), minlength=2) + 2 * SMOOTHING
        self.ratio = np.log((counts[1] / n[1]) / (counts[0] / n[0]))
        held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
        fit = np.flatnonzero(~held)
        self.weights = self._descend(rows, y, fit, epochs, cost)
        self.scaled = (self.weights * self.ratio).astype(np.float32)
        margins = np.array([self.margin(f) for f in rows]) if len(rows) else np.zeros(0)
        self.slope, self.offset = _platt(margins[held] if held.any() else margins, (labels > 0)[held] if held.any() else labels > 0)

    def _descend(self, rows, y, fit, epochs, cost) -> np.ndarray:
        w, alpha, rng = np.zeros(DIMENSIONS), np.zeros(len(rows)), np.random.default_rng(0)
        data = []
        for f in rows:
            x = self.ratio[f]
            data.append(x / (np.sqrt((x * x).sum()) or 1.0))
        for _ in range(epochs):
            for i in rng.permutation(fit):
                f, x = rows[i], data[i]
                if not len(f):
                    continue
                gradient = y[i] * float(x @ w[f]) - 1.0
                new = min(max(alpha[i] - gradient, 0.0), cost)  # each row has unit length
                if new != alpha[i]:
                    w[f] += (new - alpha[i]) * y[i] * x
                    alpha[i] = new
        return w

    def margin(self, f: np.ndarray) -> float:
        """The decision value: the scaled weights over the length of the scaled row."""
        if not len(f):
            return 0.0
        r = self.ratio[f]
        return float(self.scaled[f].sum() / (np.sqrt((r * r).sum()) or 1.0))

    def score(self, f: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -40, 40))))


def _platt(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton steps, with Platt's smoothed targets."""
    up, down = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, np.log((up + 1) / (down + 1))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(rounds if len(margins) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -40, 40)))
        grad = x.T @ (p - target) + np.array([1e-3 * a, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(c)


def training_rows(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """(doc_id, label) of at most ``sample`` labelled ids outside fold 0, those whose hash is lowest.

    Rows with a null id or label are left out; an id labelled more than once has its highest label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column)).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> SupportVectors | None:
    """The classifier, fitted in one task on the bounded sample; None where no labelled text is at hand.

    ``sample`` bounds the ids and the rows, so an id that stands on many rows brings no more of them.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch, rows, labels = np.zeros(DIMENSIONS, np.int64), [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            rows += [features(t, scratch).astype(np.int32) for _, part in byte_column(batch, "text") for t in part]
        if rows:
            model = SupportVectors(rows, np.array(labels))
            keep = [x.astype("<f4").tobytes() for x in (model.ratio, model.scaled)]
            yield pa.RecordBatch.from_arrays([pa.array([keep[0]], pa.binary()), pa.array([keep[1]], pa.binary()), pa.array([model.slope]), pa.array([model.offset])], ["ratio", "scaled", "slope", "offset"])

    chosen = F.broadcast(training_rows(labels, column, sample).withColumnRenamed("doc_id", "_id"))  # at most ``sample`` ids
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(chosen, F.col("_doc") == F.col("_id"))
    one = texts.select("_doc", "label", "text").orderBy(F.xxhash64("_doc"), "_doc", "text").limit(sample)
    rows = one.mapInArrow(train, "ratio binary, scaled binary, slope double, offset double").collect()
    if not rows:
        return None
    model = SupportVectors.__new__(SupportVectors)
    model.ratio, model.scaled = (np.frombuffer(rows[0][k], "<f4") for k in ("ratio", "scaled"))
    model.slope, model.offset = rows[0]["slope"], rows[0]["offset"]
    return model


def scored(docs: DataFrame, model: SupportVectors | None) -> DataFrame:
    """(rest, score) of every document: its row whole, and 0 to 1 (higher: better) of its whole text; no shuffle.

    Null and empty texts have no indicators and get the score of a zero margin, as every text does
    (0.5) where nothing was labelled.  Other columns pass through and are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scratch = shared.value, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            scores = [model.score(features(t, scratch)) if model else 0.5 for _, part in byte_column(batch, "rest.text") for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["rest", "score"])

    rows = wrapped(docs.withColumn("text", F.col("text").cast("string"))).select("rest")
    return in_arrow(rows, run, T.StructType([rows.schema["rest"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 0: its labels are never learnt), score, predicted (1: score >= ``threshold``)."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, sample=sample))
    return out.select("rest.doc_id", "score").select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with."""
    return scored(docs, fit(docs, labels, sample=sample)).where(F.col("score") >= threshold).select("rest.*")
