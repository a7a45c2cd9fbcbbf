"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed word unigrams and bigrams and byte trigrams of the whole text.
Over all labelled training rows, per-class counts give log-count ratios r = log((p/|p|)/(q/|q|)).
Indicators are scaled by r, each document to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent on a bounded sample of training rows: different (id, text) pairs in order of
their hashes, MAX_TRAIN rows at most and as many as have MAX_FEATURES feature ids together (64 MB).
Margins become probabilities by a sigmoid fitted on cross-fitted margins.

Texts meet their labels by one plan at every size: a sieve of fixed size, then a join by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, drop
from gristmill.llm.semi import perhaps_among
from gristmill.llm.words import SPACE, U, Words, buffers, chunks, mix, window_hashes

WORD_BITS, GRAM_BITS = 18, 16
SIZE = (1 << WORD_BITS) + (1 << GRAM_BITS)
MAX_TRAIN, MAX_FEATURES, EPOCHS, COST, THRESHOLD, FOLDS = 6000, 16_000_000, 12, 1.0, 0.3, 5
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[SPACE] = 32


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each document, flat, and where each document's begin."""
    n = len(offsets) - 1
    words = Words(offsets, data)
    h = words.hashes()
    wdoc = np.repeat(np.arange(n), words.counts)
    two = window_hashes(h, 2)
    same = np.flatnonzero(wdoc[1:] == wdoc[:-1]) if len(two) else np.zeros(0, np.int64)
    at = offsets - offsets[0]
    b = _BYTE[data].astype(np.uint64)
    keys = [wdoc << 20 | (h >> U(64 - WORD_BITS)).astype(np.int64), wdoc[same] << 20 | (two[same] >> U(64 - WORD_BITS)).astype(np.int64)]
    if len(b) > 2:
        bdoc = np.repeat(np.arange(n), np.diff(at))
        inside = np.flatnonzero(bdoc[2:] == bdoc[:-2])
        gram = mix((b[:-2] << U(16) | b[1:-1] << U(8) | b[2:])[inside])
        keys.append(bdoc[inside] << 20 | (gram >> U(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS))
    flat = np.sort(np.concatenate(keys))
    if len(flat):
        flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
    return (flat & (1 << 20) - 1).astype(np.int32), np.searchsorted(flat >> 20, np.arange(n + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    good, bad = np.zeros(SIZE + 1, np.int64), np.zeros(SIZE + 1, np.int64)
    for batch in batches:
        offsets, data = buffers(batch.column(0))
        y = batch.column(1).to_numpy()
        good[SIZE] += (y == 1).sum()
        bad[SIZE] += (y == 0).sum()
        for lo, hi in chunks(offsets):
            ids, first = features(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
            label = np.repeat(y[lo:hi], np.diff(first))
            good[:SIZE] += np.bincount(ids[label == 1], minlength=SIZE)
            bad[:SIZE] += np.bincount(ids[label == 0], minlength=SIZE)
    some = np.flatnonzero(good + bad)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(bad[some])], ["feature", "good", "bad"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(0))
        for lo, hi in chunks(offsets):
            ids, first = features(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
            blobs = pa.array([ids[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs, *(batch.column(i).slice(lo, hi - lo) for i in (1, 2, 3))], ["ids", "quality", "doc_id", "version"])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Hinge-loss weights by dual coordinate descent; the last weight is that of a constant 1."""
    w, alpha = np.zeros(SIZE + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            idx, v = rows[i], values[i]
            step = y[i] * (w[idx] @ v + w[SIZE]) - 1.0
            new = min(max(alpha[i] - step / norms[i], 0.0), cost)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[idx] += d * v
                w[SIZE] += d
                alpha[i] = new
    return w


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = g @ margin + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = s @ margin**2 + 1e-3, s @ margin, s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 1e-3), b


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


class Model:
    """``scale``: log-count ratios; ``weights``: weight times scale; margins go through a sigmoid."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float):
        self.scale2, self.weights, self.bias, self.a, self.b = (scale**2).astype(np.float32), weights.astype(np.float32), bias, a, b

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        top = np.bincount(doc, weights=self.weights[ids], minlength=n)
        norm = np.sqrt(np.bincount(doc, weights=self.scale2[ids], minlength=n))
        margin = top / np.maximum(norm, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, quality, doc_id`` of the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = cut(known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "labels")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return perhaps_among(source, "doc_id", known, "doc_id").join(known.hint("merge"), "doc_id").select("text", "quality", "doc_id")


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training rows of label 1 and of label 0 that have each feature; the last entry counts all rows."""
    counts = train.select("text", "quality").mapInArrow(_count, "feature int, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # at most SIZE + 1 rows
    good, bad = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    at = counts["feature"].to_numpy()
    good[at], bad[at] = counts["good"].to_numpy(), counts["bad"].to_numpy()
    return good, bad


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good[:SIZE] + 1, bad[:SIZE] + 1
    scale = np.log((p / p.sum()) / (q / q.sum()))
    scale[(good[:SIZE] + bad[:SIZE]) == 0] = 0
    return scale


def bounded_sample(train: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> pa.Table:
    """``ids, quality`` of at most ``max_train`` different rows with at most ``max_features`` ids in all."""
    keys = train.select("doc_id", F.xxhash64("text").alias("version")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(max_train)
    few = train.withColumn("version", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    coded = few.select("text", "quality", "doc_id", "version").mapInArrow(_encode, "ids binary, quality int, doc_id long, version long")
    coded = cut(coded, "sample")  # max_train rows at most, so one window may hold them
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "version")
    kept = coded.select("doc_id", "version", F.sum(F.octet_length("ids") / 4).over(order).alias("sum")).where(F.col("sum") <= max_features).select("doc_id", "version")
    return coded.join(F.broadcast(kept), ["doc_id", "version"]).orderBy(F.xxhash64("doc_id"), "doc_id", "version").select("ids", "quality").toArrow()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    train = cut(training_rows(docs, labels, id_col, text_col), "train")
    good, bad = class_counts(train)
    scale = log_ratios(good, bad)
    n1, n0 = good[SIZE], bad[SIZE]
    if not n1 or not n0:
        prior = (n1 + 1) / (n1 + n0 + 2)
        return Model(scale, np.zeros(SIZE), 0.0, 1.0, math.log(prior / (1 - prior)))
    sample = bounded_sample(train, max_train, max_features)
    drop(train)
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["ids"]]
    y = np.where(sample["quality"].to_numpy() == 1, 1.0, -1.0)
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(1e-12, float(np.sqrt(v @ v))))
    margin, fold = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for f in range(3):
        inside = np.flatnonzero(fold != f)
        w = descend([rows[i] for i in inside], [values[i] for i in inside], y[inside])
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]] @ values[i] + w[SIZE]
    a, b = _sigmoid_fit(margin, y)
    w = descend(rows, values, y)
    return Model(scale, w[:SIZE] * scale, float(w[SIZE]), a, b)


def _apply(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                score = model.score(*features(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null or empty text has no features and gets the score of the bias. Rows repeated with one id are
    scored each; a label repeated for one id counts as the smallest. A null id is never held out and
    has no label. With labels of one class or none the score is the smoothed share of label 1. Other
    columns are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_apply(model), "doc_id long, held_out boolean, score double, predicted int")
