"""Quality classifier: naive Bayes support vectors.

A text's n-gram indicators are its words, and one- to three-grams of token shapes (runs of
equal character kinds collapsed, with a mark on tokens that repeat the one before), which
carry over to words never seen. Each indicator is scaled by its class log-count ratio; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent on
the driver, from at most ``LIMIT`` labelled texts a class (as sets of feature hashes). Its
margins become probabilities by logistic calibration on out-of-fold margins, corrected to
the label shares of the whole training folds. Scoring is one map over all texts.

Defined results: null and empty texts have no indicators and score by the bias alone;
without labels of both classes every text scores 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import fold, give_back, labelled, mapped, table

#: Labelled texts a class at most; least texts with a feature; features at most; threshold.
LIMIT, MIN_TEXTS, MAX_FEATURES, THRESHOLD = 2000, 4, 1 << 17, 0.7

_U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = ord("9")
_SHAPE[0x41:0x5B] = ord("X")
_SHAPE[0x61:0x7B] = ord("x")
_SHAPE[0x80:] = ord("x")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every indicator; repeats of a text's own remain."""
    start, end, text = K.find_words(data, offsets, K.NON_SPACE)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = K.span_hashes(K.LOWER[data], start, end)
    kind = _SHAPE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    place = np.cumsum(keep) - keep
    shape = K.span_hashes(kind[keep], place[start], place[end - 1] + keep[end - 1])
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = shape + again.astype(np.uint64) * _U(0x632BE59BD9B4E019)
    parts, texts = [word], [text]
    for n in (1, 2, 3):
        grams = K.rolling(shape, n) + _U(n * 0x51ED270B)
        inside = text[: len(grams)] == text[n - 1 :] if len(grams) else np.empty(0, bool)
        parts.append(grams[inside])
        texts.append(text[: len(grams)][inside])
    return np.concatenate(texts), np.concatenate(parts)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            text, h = features(data, offsets)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.empty(0, bool)
            counts = np.bincount(text[new], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), K.list_array(h[new].view(np.int64), counts, pa.int64())], names=["_id", "y", "features"])


@dataclass
class Model:
    """Feature hashes with their weights times log-count ratios, the bias and the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum cost_i hinge_i over rows of unit-norm scaled indicators; (w, bias)."""
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    unit = [scale[r] / max(1e-9, float(np.linalg.norm(scale[r]))) for r in rows]
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], unit[i]
            q = 2.0 if len(r) else 1.0  # the squared norm with the bias's 1
            new = min(cost[i], max(0.0, alpha[i] + (1 - y[i] * (float(w[r] @ x) + b)) / q))
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _ratios(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, c in zip(rows, y, strict=True) if c == s] or [np.empty(0, np.int64)]), minlength=n) + 1.0 for s in (1, -1)]
    return np.log(counts[0] / (1 + (y == 1).sum())) - np.log(counts[1] / (1 + (y == -1).sum()))


def _margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([float(w[r] @ scale[r]) / max(1e-9, float(np.linalg.norm(scale[r]))) + b for r in rows])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on the margin (Newton's method)."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    t, beta = (y > 0).astype(float), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * beta * [1, 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(sets: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float], folds: int = 3) -> Model:
    """``sets``: each text's distinct feature hashes; ``shares``: of classes 0 and 1 in the corpus."""
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not (y == 1).any() or not (y == -1).any():
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, 0.0, 0.0)
    keys, counts = np.unique(np.concatenate(sets), return_counts=True)
    least = min(MIN_TEXTS, max(1, len(sets) // 20))
    floor = max(least, int(np.partition(counts, -MAX_FEATURES)[-MAX_FEATURES]) + 1 if len(counts) > MAX_FEATURES else 0)
    keys = keys[counts >= floor]
    index = K.HashIndex(keys)
    rows = [at[at >= 0] for at in map(index.find, sets)]
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == -1).sum()) * len(y)
    cost = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == -1).sum()))
    part = np.arange(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        ins, outs = np.flatnonzero(part != k), np.flatnonzero(part == k)
        scale = _ratios([rows[i] for i in ins], y[ins], len(keys))
        w, b = dual_coordinate_descent([rows[i] for i in ins], scale, y[ins], cost[ins])
        margin[outs] = _margins([rows[i] for i in outs], scale, w, b)
    slope, shift = calibrate(margin, y, weight)
    scale = _ratios(rows, y, len(keys))
    w, b = dual_coordinate_descent(rows, scale, y, cost)
    return Model(keys, np.stack([w * scale, scale * scale], 1), b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model from at most ``limit`` labelled texts a class, none of the held-out fold."""
    picked = labelled(docs, labels, label, limit, id_column, text_column).select("_id", "text", "y")
    kind = picked.schema["_id"].dataType.simpleString()
    rows = mapped(picked, _feature_sets, f"_id {kind}, y int, features array<long>").toArrow().sort_by("_id")
    sets = [np.asarray(x.values).view(np.uint64) for x in rows["features"]]
    share = labels.where(F.col(label).isin(0, 1) & (fold(id_column) != 2)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit(sets, rows["y"].to_numpy(), (1 - (share or 0.5), share or 0.5))


def _scorer(shared):
    """For a worker: probabilities of a text column, chunk by chunk, as (first row, end row, p)."""
    own = shared.value
    index, width = K.HashIndex(own.keys), max(1, len(own.keys))

    def run(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for lo, hi, data, offsets in K.chunks(column):
            text, h = features(data, offsets)
            at = index.find(h)
            hit = np.unique(text[at >= 0] * width + at[at >= 0])
            text, at = hit // width, hit % width
            total, norm = (np.bincount(text, own.weights[at, j] if len(at) else None, hi - lo) for j in (0, 1))
            yield lo, hi, own.probability(total / np.sqrt(np.maximum(norm, 1e-18)) + own.bias)

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES features
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for batch in batches:
            for lo, hi, p in scored(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared)
        for batch in batches:
            for lo, hi, p in scored(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(p >= threshold))

    return mapped(docs, run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted")
