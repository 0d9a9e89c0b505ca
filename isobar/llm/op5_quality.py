"""Quality scores by random Fourier features and ridge regression.

Each whole text becomes a row of document statistics (shares of letters,
digits, capitals and symbols, word and line lengths, repetition, ...).  Cosines
of random projections of the standardised row approximate a Gaussian kernel.
The normal equations of a ridge regression on these features are summed a
partition at a time, then over partitions by cell, and solved once; isotonic
regression (pool adjacent violators) turns the fitted values into calibrated
probabilities.

Training uses about ``SAMPLE`` labelled rows for each label (by a hash of the
id, so the same ones each time), and weighs in the calibration as many rows as
it stands for; a row's fold decides whether it goes into the
normal equations (three quarters) or the calibration (one quarter).  Scoring
reads every text.

Results: an empty table gives no rows; very long texts are one row like any
other; repeated rows are scored each, and learned from each; columns other than
those named are ignored (``kept`` passes them through); rows of one fitted value
have one score.  An empty or null text has the statistics of an empty text and a score
like any other; with no labelled rows every score is 0.5, with one label only
it is that label; labels that are null or neither 0 nor 1 are passed over; a
document with several labels counts with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .common import columns, dropped, held_out, sample, saved

#: Random features; width of the kernel (standard deviations); ridge penalty a row; labelled rows a label; seed.
FEATURES, WIDTH, RIDGE, SAMPLE, SEED = 256, 3.0, 1e-4, 6000, 20_240_607

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line feed, 6 ordinary punctuation, 7 symbol, 8 not ASCII, 9 inner byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[192:], _CLASS[128:192] = 8, 9


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    rows = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(rows), size)
    cls = _CLASS[raw]
    count = np.bincount(row * 10 + cls, minlength=rows * 10).reshape(rows, 10).astype(float)
    words = T.Words(raw, off)
    wrow, wlen = words.row(), words.end - words.start
    n = words.n.astype(float)
    chars = np.maximum(size - count[:, 9], 1)
    per = lambda x, y: x / np.maximum(y, 1)
    by_word = lambda x: np.bincount(wrow, weights=x, minlength=rows)
    mean_len = per(by_word(wlen), n)
    sq_len = per(by_word(wlen.astype(float) ** 2), n)
    last = cls[words.end - 1] if len(wlen) else np.zeros(0, np.uint8)
    head = cls[words.start] if len(wlen) else np.zeros(0, np.uint8)
    hashes = words.hashes()
    pair = wrow.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hashes
    distinct = np.bincount(_distinct_rows(pair, wrow), minlength=rows)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1])] if len(hashes) else np.zeros(0, bool)
    at, h3 = words.windows(hashes, 3)
    r3 = wrow[at] if len(at) else at
    distinct3 = np.bincount(_distinct_rows(r3.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h3, r3), minlength=rows)
    return np.column_stack(
        [
            np.log1p(n), np.log1p(chars), mean_len, np.sqrt(np.maximum(sq_len - mean_len**2, 0)),
            per(count[:, 1], chars), per(count[:, 2], chars), per(count[:, 3], chars), per(count[:, 4] + count[:, 5], chars), per(count[:, 6], chars),
            np.sqrt(per(count[:, 7], chars)), per(count[:, 8], chars), np.log1p(count[:, 5]), per(n, count[:, 5] + 1) ** 0.25,
            per(by_word(last == 6), n), per(by_word(last == 7), n), per(by_word(head == 2), n), per(by_word(wlen == 1), n), per(by_word(wlen > 20), n),
            per(distinct, np.maximum(n, 1) ** 0.8), per(distinct3, np.maximum(n - 2, 1)), per(by_word(same), n),
        ]
    )


def _distinct_rows(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The row of each distinct key."""
    if not len(key):
        return np.zeros(0, np.int64)
    return row[np.unique(key, return_index=True)[1]]


class Features:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.omega = rng.normal(size=(len(mean), features)) / width
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), z, np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)])


def isotonic(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x; ``rows`` says how many rows each one stands for."""
    rows = np.ones(len(x)) if rows is None else rows
    order = np.argsort(x, kind="stable")
    at, inverse = np.unique(x[order], return_inverse=True)
    weight = np.bincount(inverse, weights=rows[order])
    value = np.bincount(inverse, weights=(rows * y)[order]) / weight
    blocks: list[list[float]] = []  # value, weight, first, last
    for k, (v, w) in enumerate(zip(value, weight, strict=True)):
        blocks.append([v, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, end = blocks.pop()
            v1, w1, first, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, end])
    return np.array([at[int(b[k])] for b in blocks for k in (2, 3)]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Scorer:
    """Calibrated scores; ``constant`` where nothing could be fitted."""

    def __init__(self, features: Features | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None, constant: float = 0.5):
        self.features, self.weights, self.knots, self.constant = features, weights, knots, constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(off) - 1, self.constant)
        return np.clip(np.interp(self.raw(statistics(raw, off)), *self.knots), 0.0, 1.0)


def _stat_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text"):
            x = statistics(*T.flat(rb.column(2)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "fold", "x"])

    return docs.select("y", "fold", "text").mapInArrow(run, "y double, fold int, x array<double>")


def fit(labelled: DataFrame, rate: dict[float, int], features: int = FEATURES) -> Scorer:
    """Learns from a bounded number of (doc_id, text, y) rows, y 0 or 1; ``rate``: how many of each label there are in all."""
    chosen = labelled.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(4)).cast("int"))
    stats = saved(_stat_rows(chosen))
    width = len(statistics(np.zeros(0, np.uint8), np.zeros(1 + 1, np.int64))[0])
    moments = stats.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(width)], *[F.sum(F.col("x")[k] ** 2).alias(f"q{k}") for k in range(width)]).collect()
    n = sum(r["n"] for r in moments)
    if n == 0 or len(moments) < 2:
        return Scorer(None, None, None, 0.5 if n == 0 else float(moments[0]["y"]))
    mean = np.array([sum(r[f"s{k}"] for r in moments) for k in range(width)]) / n
    scale = np.sqrt(np.maximum(np.array([sum(r[f"q{k}"] for r in moments) for k in range(width)]) / n - mean**2, 0))
    phi = Features(mean, scale, features)
    balance = {r["y"]: n / (len(moments) * r["n"]) for r in moments}  # both labels weigh alike
    dims = 1 + width + features

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((dims, dims)), np.zeros(dims)
        for rb in batches:
            if rb.num_rows:
                y = rb.column(0).to_numpy(zero_copy_only=False)
                z = phi(np.array(rb.column(2).values.to_numpy(zero_copy_only=False)).reshape(-1, width)[-rb.num_rows :] if rb.column(2).offset == 0 else np.array(rb.column(2).to_pylist()))
                w = np.array([balance[v] for v in y])
                gram += z.T @ (z * w[:, None])
                right += z.T @ (w * y)
        if gram[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack([gram, right]).ravel()), dims + 1).cast(pa.list_(pa.float64()))], ["i", "v"])

    cells = stats.where("fold <> 0").coalesce(8).mapInArrow(sums, "i int, v array<double>").selectExpr("i", "posexplode(v) as (j, v)").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if cells.empty:
        return Scorer(None, None, None, float(max(moments, key=lambda r: r["n"])["y"]))
    system = np.zeros((dims, dims + 1))
    system[cells["i"], cells["j"]] = cells["v"]
    weights = np.linalg.solve(system[:, :-1] + np.eye(dims) * (RIDGE * n), system[:, -1])
    rest = stats.where("fold = 0").select("y", "x").toPandas()
    if rest.empty:
        rest = stats.select("y", "x").toPandas()
    dropped(stats)
    out = Scorer(phi, weights, None)
    # The sample may hold other shares of the labels than the corpus: rows count so that shares agree.
    have = {r["y"]: r["n"] for r in moments}
    v, y = out.raw(np.array(rest["x"].tolist())), rest["y"].to_numpy()
    out.knots = isotonic(v, y, np.array([rate[k] / have[k] for k in y]))
    return out


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            s = shared.value(*T.flat(rb.column(2)))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def usable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, y)`` of labels that may be learned from."""
    return labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("double").alias("y"))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE) -> Scorer:
    """Learns ``labels`` from the whole texts of about ``per_label`` documents a label.

    The chosen labels, at most about twice ``per_label`` rows of 16 bytes, are
    broadcast, so the texts of the corpus are not shuffled for it.
    """
    have = usable(labels, label)
    ids = sample(have, "y", per_label)
    rate = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return fit(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), rate)


def kept(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (with a ``text`` column) whose score is at least ``threshold``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    # The columns travel as one, whatever their names.
    rows, at = docs.select(F.struct(*columns(docs)).alias("row")), docs.columns.index("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0).field(at), rb.column(0)], ["text", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(texts(batches), "text", 1 << 20):
            good = pa.array(shared.value(*T.flat(rb.column(0))) >= threshold)
            yield pa.RecordBatch.from_arrays([rb.column(1).filter(good)], ["row"])

    kept_rows = rows.mapInArrow(run, StructType([rows.schema["row"]]))
    return kept_rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
