"""Quality classifier: naive Bayes support vectors.

Indicators of the byte n-grams of a text (2 to 4 bytes, hashed to ``2**LOG2``), and of how often its
word pairs repeat a word, its words differ and how many they are (in steps), are scaled by the log
ratio of their smoothed frequencies in good and bad training texts; a linear hinge-loss model is
fitted to the scaled vectors, their byte n-gram part length-normalised, by dual coordinate descent; a
logistic curve fitted on training rows kept from it turns margins into probabilities.

It learns from ``max_rows`` labelled rows at most (those of least hash of ``doc_id``) and from
``max_features`` indicators in all; both bounds are parameters. Every document is scored, whole.

Defined results: null and empty texts have only the indicators of no words; with
no labels every score is 0.5, with one class the smoothed share of it; documents with contradicting
labels are not learned from; repeated rows are scored alike; a null ``doc_id`` is scored, never
learned from, and not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm import store

LOG2, ORDERS = 16, (2, 3, 4)
MAX_ROWS, MAX_FEATURES = 8000, 10_000_000


_STEPS = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.97])
N_WORD = 3 * 16  # indicators about words, after those of bytes
SIZE = (1 << LOG2) + N_WORD


def word_indicators(texts: pa.Array) -> np.ndarray:
    """Indices (text x 3): steps of repeated word pairs, of distinct words, and of length."""
    w = K.words(texts)
    n = np.diff(w.first)
    owner = w.owner()
    same = np.zeros(len(w.hashes), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    uniq = np.unique(K.mix(w.hashes ^ K.mix(owner.astype(np.uint64))), return_index=True)[1]
    some = np.maximum(n, 1)
    pairs = np.searchsorted(_STEPS, K.per_text(same, w.first) / some)
    distinct = np.searchsorted(_STEPS, np.bincount(owner[uniq], minlength=len(n)) / np.sqrt(some) / 10)
    length = np.minimum(15, np.ceil(np.log2(n + 1)).astype(np.int64))
    return (1 << LOG2) + np.stack([pairs, 16 + distinct, 32 + length], axis=1)


def values(scale: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Scaled vector of a row of indices: the byte part, all but the last three, divided by the root of its size."""
    v = scale[row]
    v[:-3] /= max(1.0, np.sqrt(len(row) - 3))
    return v


def indicators(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Indices of the n-grams of one text. ``flags`` is all false before and after."""
    v = data.astype(np.uint32)
    for n in ORDERS:
        if len(data) < n:
            break
        x = np.zeros(len(data) - n + 1, dtype=np.uint32)
        for j in range(n):
            x = (x << np.uint32(8)) | v[j : j + len(x)]
        x ^= x >> np.uint32(15)
        x = x * np.uint32(0x2C1B3C6D + 2 * n)
        x ^= x >> np.uint32(12)
        flags[(x * np.uint32(0x297A2D39)) >> np.uint32(32 - LOG2)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def held_out() -> Column:
    """Rows never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # n-gram weights, already scaled by the log-count ratios
    bias: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        data, offsets = K.buffers(texts)
        flags = np.zeros(1 << LOG2, dtype=bool)
        out = self.bias + self.weights[word_indicators(texts)].sum(axis=1)
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if e > s:
                x = indicators(data[s:e], flags)
                out[i] += self.weights[x].sum() / max(1.0, np.sqrt(len(x)))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.slope * self.margins(texts) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 40, tol: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators and bias of the L1-loss linear SVM, by dual coordinate descent.

    Row i is ``values(scale, rows[i])`` with a constant 1 for the bias.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    vectors = [values(scale, r) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in vectors])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], vectors[i]
            g = y[i] * (float(w[r] @ v) + bias) - 1
            if (alpha[i] == 0 and g > 0) or (alpha[i] == cost[i] and g < 0):
                continue
            most = max(most, abs(g))
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
        if most < tol:
            break
    return w * scale, bias


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve (Newton's method, smoothed targets)."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(rounds):
        p = _logistic(a * margins + b)
        grad = x @ (p - target) + np.array([1e-3 * a, 0.0])
        hess = (x * (p * (1 - p))) @ x.T + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, alpha: float = 1.0) -> Model:
    """The model for indicator sets and 0/1 labels. Every fifth row only calibrates."""
    zero = np.zeros(SIZE)
    pos = int(labels.sum())
    if not 0 < pos < len(labels):
        share = 0.5 if not len(labels) else (pos + 1) / (len(labels) + 2)
        return Model(zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    own = np.arange(len(labels)) % 5 != 4
    if len(np.unique(labels[own])) < 2 or len(np.unique(labels[~own])) < 2:
        own[:] = True
    counts = {}
    for k in (0, 1):
        at = np.flatnonzero(own & (labels == k))
        counts[k] = alpha + np.bincount(np.concatenate([rows[i] for i in at]), minlength=SIZE) if len(at) else np.full(SIZE, alpha)
        counts[k] = counts[k] / counts[k].sum()
    ratio = np.log(counts[1] / counts[0])
    at = np.flatnonzero(own)
    y = np.where(labels[at] == 1, 1.0, -1.0)
    cost = np.where(y > 0, c, c * min(10.0, max(1.0, (y > 0).sum() / (y < 0).sum())))
    w, bias = dual_descent([rows[i] for i in at], y, ratio, cost)
    rest = np.flatnonzero(~own) if not own.all() else at
    margins = np.array([bias + values(w, rows[i]).sum() for i in rest])
    return Model(w, bias, *platt(margins, np.where(labels[rest] == 1, 1.0, -1.0)))


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(1 << LOG2, dtype=bool)
    for b in K.pieces(batches):
        data, offsets = K.buffers(b.column("text"))
        own = word_indicators(b.column("text")).astype(np.int32)
        sets = [np.append(indicators(data[s:e], flags).astype(np.int32), own[i]) for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("doc_id"), b.column("quality"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["h", "doc_id", "quality", "n", "grams"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on labelled documents that aren't held out."""
    own = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    )
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id")  # max_rows rows
    sets = store.table(chosen.mapInArrow(_indicators, "h long, doc_id long, quality int, n long, grams binary"), "indicators")
    sizes = sets.select("h", "doc_id", "n").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    total = np.cumsum(sizes.column("n").to_numpy())
    if len(total) and total[-1] > max_features:
        last = sizes.column("h")[int(np.searchsorted(total, max_features))].as_py()
        sets = sets.filter(F.col("h") < last)
    got = sets.select("h", "doc_id", "quality", "grams").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    rows = [np.frombuffer(x, dtype=np.int32) for x in got.column("grams").to_pylist()]
    return fit(rows, got.column("quality").to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**LOG2 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("text")))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
