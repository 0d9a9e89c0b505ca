"""Toxicity by cumulative-link ordinal regression.

``P(grade <= k | x) = sigmoid(theta_k - w.x)`` with one weight vector ``w``
shared by all ordered thresholds ``theta_0 < theta_1 < ...``.  ``x`` marks
which lower-cased words (letter runs) and word beginnings of ``STEMS`` bytes a
text holds, hashed to ``2 ** BITS`` places; only those whose share differs between toxic and other training texts
by more than ``LEAST_Z`` standard errors are kept.  The expected severity is
``sum_k P(grade > k | x)``.

The labels say toxic or not.  Grades above 0 are drawn from them: toxic
training texts are graded 1 to ``GRADES - 1`` by thirds of the number of
different features they hold that speak for toxicity.

Training reads the whole texts of about ``SAMPLE`` documents a label (by a
hash of the id, so the same ones each time); the fit runs on their kept
features, each label weighed as it is among all labels.  Scoring reads every text.

Results: null and empty texts have no words and the severity of a text without
kept words; with no labels, or one label only, severity is 0, or the highest
grade if all are toxic; repeated rows are scored each; labels that are null or
neither 0 nor 1 are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import held_out, sample
from .op5_quality import usable

BITS, GRADES, SAMPLE, LEAST_Z, LEAST_DOCS = 20, 4, 3000, 5.0, 4
STEMS = (4, 5, 6, 7, 8)
RIDGE, STEPS = 0.03, 400

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_NOT_LETTER = ~_LETTER


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature)`` of every word and word beginning, and words a row."""
    w = T.Words(raw, off, _NOT_LETTER)
    row, shift = w.row(), np.uint64(64 - BITS)
    if not len(row):
        return row, row, w.n
    pre = T.prefix(T.BYTE_VALUE[T.LOWER[raw]])
    rows, found = [row], [T.ranges(pre, w.start, w.end) >> shift]
    for k in STEMS:
        long = np.flatnonzero(w.end - w.start > k)
        rows.append(row[long])
        found.append(T.mix(T.ranges(pre, w.start[long], w.start[long] + k) + np.uint64(k)) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), w.n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta

    @classmethod
    def constant(cls, toxic: bool) -> Ordinal:
        return cls(np.zeros(1 << BITS, np.float32), np.linspace(-40, -39, GRADES - 1) if toxic else np.linspace(39, 40, GRADES - 1))

    def above(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` of each text, a column for each threshold."""
        row, word, n = features(raw, off)
        has = self.weights[word] != 0
        pair = np.unique(row[has] * (1 << BITS) + word[has])
        s = np.bincount(pair >> BITS, weights=self.weights[pair & (1 << BITS) - 1], minlength=len(n))
        return _sigmoid(s[:, None] - self.theta[None, :])


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES, ridge: float = RIDGE, steps: int = STEPS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood; (row, col) are the features that are 1.

    Thresholds are a first value and logarithms of gaps, so they stay ordered.
    Steps are Adam's on the full gradient.  A text with ``weight`` counts as so many.
    """
    n = len(grade)
    weight = np.ones(n) if weight is None else weight
    share = np.clip(np.array([weight[grade <= k].sum() / weight.sum() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    p = np.r_[np.zeros(width), start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gap = p[:width], np.exp(p[width + 1 :])
        theta = p[width] + np.r_[0, np.cumsum(gap)]
        s = np.bincount(row, weights=w[col], minlength=n)
        up = np.where(grade < grades - 1, _sigmoid(np.r_[theta, 50][grade] - s), 1.0)
        low = np.where(grade > 0, _sigmoid(np.r_[-50, theta][grade] - s), 0.0)
        like = np.maximum(up - low, 1e-9)
        d_up, d_low = weight * up * (1 - up) / like, weight * low * (1 - low) / like
        g_s = d_up - d_low  # of the negative log likelihood by s
        g_theta = np.array([-(d_up[grade == k].sum()) + d_low[grade == k + 1].sum() for k in range(grades - 1)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.r_[np.bincount(col, weights=g_s[row], minlength=width) + ridge * w, tail[0], tail[1:] * gap]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], p[width] + np.r_[0, np.cumsum(np.exp(p[width + 1 :]))]


def learned(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Ordinal:
    have = usable(labels, "toxic")
    ids = sample(have, "y", per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            row, word, _ = features(*T.flat(rb.column(0)))
            pair = np.unique(row * (1 << BITS) + word)
            edge = np.searchsorted(pair >> BITS, np.arange(rb.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array((pair & (1 << BITS) - 1).astype(np.int32)))], ["y", "words"])

    # The chosen labels, at most about 2 * per_label rows, are broadcast: the corpus is not shuffled for it.
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y").mapInArrow(run, "y double, words array<int>").toPandas()
    if got.empty or got["y"].nunique() < 2:
        return Ordinal.constant(bool(len(got)) and bool(got["y"].iloc[0]))
    toxic = got["y"].to_numpy() == 1
    size = got["words"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), size)
    word = np.concatenate(got["words"].to_numpy()).astype(np.int64)
    width = 1 << BITS
    in_toxic, in_all = np.bincount(word[toxic[row]], minlength=width), np.bincount(word, minlength=width)
    a, b, base = toxic.sum(), (~toxic).sum(), in_all / len(got)
    z = (in_toxic / a - (in_all - in_toxic) / b) / np.sqrt(np.maximum(base * (1 - base), 1e-9) * (1 / a + 1 / b))
    kept = np.flatnonzero((np.abs(z) > LEAST_Z) & (in_all >= LEAST_DOCS))
    if not len(kept):
        return Ordinal.constant(False)
    number = np.full(width, -1)
    number[kept] = np.arange(len(kept))
    has = number[word] >= 0
    row, col = row[has], number[word[has]]
    bad = z[kept][col] > 0
    amount = np.bincount(row[bad], minlength=len(got))
    edges = np.quantile(amount[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(edges, amount, side="left"), 0)
    # The sample has fewer of the commoner label than all labels have: it is weighed back, the mean weight is 1.
    rate = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(toxic, rate[1.0] / a, rate[0.0] / b)
    w, theta = fit_ordinal(row, col, grade, len(kept), weight=weight / weight.mean())
    weights = np.zeros(width, dtype=np.float32)
    weights[kept] = w
    return Ordinal(weights, theta)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``doc_id, held_out, severity, grade, score, predicted``: severity 0 to ``GRADES - 1``, score is P(grade > 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            above = shared.value.above(*T.flat(rb.column(2)))
            grade = np.column_stack([np.ones(len(above)), above]) - np.column_stack([above, np.zeros(len(above))])
            cols = [pa.array(above.sum(axis=1)), pa.array(grade.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array((above[:, 0] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *cols], ["doc_id", "held_out", "severity", "grade", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, severity double, grade int, score double, predicted int")
