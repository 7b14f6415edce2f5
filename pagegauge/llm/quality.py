"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings make three grades: 0 toxic, 1 clean but poor, 2 clean and good. One weight vector over hashed text
features is shared by ordered thresholds: P(grade > k) = sigmoid(w.x - t_k), t_0 < t_1. A text's features are
its distinct words (letters and digits, A-Z folded) and its distinct runs of other signs, hashed to ``BUCKETS``.

It is fitted on at most ``MAX_TRAIN`` rated documents (those with the smallest hash of doc_id), by proximal
gradient steps with an L1 penalty, so that only words that tell the grades apart weigh anything. Every whole text
is scored where it is read; nothing but the sample is shuffled.

Nulls: a null text has no features and gets the grade of the thresholds alone; null ratings are not used. Without
ratings of at least two grades there is nothing to fit: scores are null and every document is kept.
A document rated twice counts by its lowest grade; of rows that repeat a doc_id the smallest text is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import long_rows
from .words import LETTERS_DIGITS, LOWER, NOT_BLANK, mix, pieces, words_of

MAX_TRAIN = 12_000
BUCKETS = 1 << 18
GRADES = 3
RESULT = "expected_grade double, p_clean double, p_good double, kept boolean"
_SIGNS = NOT_BLANK & ~LETTERS_DIGITS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs."""
    pairs = []
    for salt, kind in ((1, LETTERS_DIGITS), (2, _SIGNS)):
        w = words_of(texts, kind, LOWER)
        bucket = mix(w.hashes() + np.uint64(salt)) & np.uint64(BUCKETS - 1)
        pairs.append(w.doc.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
    x = np.unique(np.concatenate(pairs))
    return x // BUCKETS, x % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[bucket], n)

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _sigmoid(latent[None, :] - self.thresholds[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_slope(v: np.ndarray, base: float, gap: float, doc: np.ndarray, column: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """Mean negative log-likelihood and its slopes in the weights, the first threshold and the log gap to the second."""
    n = len(grade)
    weight = 1 / n
    z = np.bincount(doc, v[column], n)
    cut = np.array([base, base + np.exp(gap)])
    # P(grade) = F(z - t_{g-1}) - F(z - t_g), with F(z - t_{-1}) = 1 and F(z - t_last) = 0
    low = np.where(grade > 0, _sigmoid(z - cut[np.maximum(grade - 1, 0)]), 1.0)
    high = np.where(grade < GRADES - 1, _sigmoid(z - cut[np.minimum(grade, GRADES - 2)]), 0.0)
    p = np.maximum(low - high, 1e-12)
    d_low, d_high = low * (1 - low), high * (1 - high)
    slope_z = -weight * (d_low - d_high) / p
    on = [weight * (((grade - 1 == k) * d_low - (grade == k) * d_high) / p).sum() for k in range(GRADES - 1)]
    return float(-weight * np.log(p).sum()), np.bincount(column, slope_z[doc], len(v)), float(on[0] + on[1]), float(on[1] * np.exp(gap))


def fit(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, l1: float = 2e-4, rounds: int = 300) -> Model:
    """Accelerated proximal gradient on the mean negative log-likelihood; thresholds kept in order by their gaps."""
    used, column = np.unique(bucket, return_inverse=True)
    w, momentum = np.zeros(len(used)), np.zeros(len(used))
    base, gap = -1.0, 0.5  # thresholds: base, base + exp(gap)
    step, t = 1.0, 1.0
    for _ in range(rounds):
        value, slope, s_base, s_gap = loss_and_slope(momentum, base, gap, doc, column, grade)
        while True:
            moved = momentum - step * slope
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            diff = new - momentum
            rate = min(step, 1.0)
            new_base, new_gap = base - rate * s_base, float(np.clip(gap - rate * s_gap, -3, 3))
            if loss_and_slope(new, new_base, new_gap, doc, column, grade)[0] <= value + slope @ diff + diff @ diff / (2 * step) + 1e-9 or step < 1e-4:
                break
            step /= 2
        t, old_t = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        momentum = new + (old_t - 1) / t * (new - w)
        w, base, gap = new, new_base, new_gap
        step *= 1.1
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, np.array([base, base + np.exp(gap)]))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of ``labels(doc_id, quality, toxic)``."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """A model from at most ``max_train`` rated documents (``ratings``: doc_id, grade); None if there is too little."""
    chosen = ratings.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    # at most max_train ids: a proven bound; one text for each, however many rows have the id
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            doc, bucket = features(b.column(1))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["grade", "buckets"])

    t = rows.mapInArrow(run, "grade int, buckets array<int>").toArrow()
    grade = t.column("grade").to_numpy().astype(np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    lists = t.column("buckets").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(grade)), size), lists.flatten().to_numpy().astype(np.int64), grade)


def score(docs: DataFrame, model: Model | None, least_good: float = 0.5) -> DataFrame:
    """``doc_id`` and RESULT: expected grade, P(grade >= 1), P(grade >= 2), and whether the document is selected."""
    long_rows(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            n = b.num_rows
            if known.value is None:
                out = [pa.nulls(n, pa.float64())] * 3 + [pa.array(np.ones(n, bool))]
            else:
                p = known.value.above(known.value.latent(*features(b.column(1)), n))
                out = [pa.array(p.sum(0)), pa.array(p[0]), pa.array(p[1]), pa.array(p[1] >= least_good)]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {RESULT}")
