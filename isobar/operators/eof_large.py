"""Leading singular vectors of matrices with two large sides.

A randomised range finder: a random frame of ``rank + oversample`` columns over
the smaller side is multiplied by ``A'A`` and made orthonormal again until its
singular values settle.  A pass reads panels of rows, multiplies each by the
frame and by its own transpose, and adds the products up in a tree: neither the
Gram matrix of a side nor the matrix itself is ever in one place.  At the end
the rows of ``A Q`` stay where they are: each partition reduces its own to a
triangle by QR, triangles meet in a tree, and the SVD of the last one turns the
frame and the rows into singular vectors.  Where the spectrum is flat, so that
passes gain little, the frame grows; one as wide as the smaller side is exact.

The driver and each task hold a frame: the smaller side times ``rank +
oversample`` numbers, ``CELLS`` at most.  Modes over the larger side are a
table, made by a map of the rows, and never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .linear import CELLS
from .sums import STRIP, panels, salted, strips, summed

#: Passes that a frame may still need; one that needs more is doubled.
AHEAD = 8


def gram_product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """``A' (A q)`` over rows ``(i, x)``; one pass."""
    n, k = q.shape
    height = max(1, STRIP // max(k, 1))
    shared = rows.sparkSession.sparkContext.broadcast(q)  # a frame, CELLS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, total = shared.value, None
        for _, a in panels(batches, n):
            part = a.T @ (a @ frame)
            total = part if total is None else np.add(total, part, out=total)
        if total is not None:
            for s, v in strips(total, height):
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([v], pa.binary())], names=["strip", "v"])

    out = np.zeros((n, k))
    for r in summed(salted(rows.select("i", "x").mapInArrow(run, "strip int, v binary"))).toLocalIterator():
        at = r["strip"] * height
        part = np.frombuffer(r["v"]).reshape(-1, k)
        out[at : at + len(part)] = part
    shared.destroy()
    return out


def triangle(rows: DataFrame, n: int, q: np.ndarray) -> np.ndarray:
    """``R`` of the QR of ``A q``: partitions first, then groups of ``FAN`` of their triangles, then these."""
    k = q.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, a in panels(batches, n):
            y = a @ shared.value
            r = np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")
        if r is not None:
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["strip", "v"])

    def node(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([np.frombuffer(b.as_py()).reshape(-1, k) for b in table.column("v")]), mode="r")
        return pa.table({"v": pa.array([r.tobytes()], pa.binary())})

    level = salted(rows.select("i", "x").mapInArrow(leaf, "strip int, v binary")).groupBy("salt").applyInArrow(node, "v binary")
    parts = [np.frombuffer(r["v"]).reshape(-1, k) for r in level.collect()]  # one triangle for each FAN partitions
    return np.linalg.qr(np.vstack(parts), mode="r") if parts else np.zeros((k, k))


@dataclass
class LargeEof:
    """Singular values ``s`` and modes as a table ``(state columns, u array<double>)``."""

    names: list[str]
    modes: DataFrame
    s: np.ndarray
    samples: int
    total_variance: float
    passes: int

    @property
    def variance(self) -> np.ndarray:
        return self.s**2 / (self.samples - 1)

    @property
    def fraction(self) -> np.ndarray:
        return self.variance / self.total_variance


def leading(rows: DataFrame, n: int, rank: int, oversample: int = 10, tolerance: float = 1e-8, most: int = 60, seed: int = 20_240_801) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(s, right vectors [n, rank], map from A q to left vectors, passes)`` of rows ``(i, x)``.

    The frame's random numbers depend on the seed alone.  Passes end when the
    singular values change by less than ``tolerance`` of the first one.  A frame
    that shrinks the change too slowly for this is doubled (``n`` vectors and
    ``CELLS`` numbers at most); where values still change after ``most`` passes,
    an error says so.
    """
    k = min(rank + oversample, n)
    if n * k > CELLS:
        raise ValueError(f"{n} columns by {k} vectors: a frame may have {CELLS} numbers")
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(n, k)))[0]
    before, change, passes = None, None, 0
    while True:
        z = gram_product(rows, q)
        passes += 1
        q, r = np.linalg.qr(z)
        now = np.sqrt(np.linalg.svd(r, compute_uv=False))[:rank]
        last, change = change, None if before is None else np.abs(now - before).max() / max(now[0], 1e-300)
        if k == n or (change is not None and change <= tolerance):
            break
        if passes == most:
            raise ValueError(f"singular values still change after {most} passes: ask for fewer modes or more oversampling")
        before = now
        wide = min(2 * k, n, CELLS // n)
        if last and wide > k and change > tolerance * (last / change) ** AHEAD:
            q = np.linalg.qr(np.hstack([q, rng.normal(size=(n, wide - k))]))[0]
            k, change = wide, None
    _, s, vt = np.linalg.svd(triangle(rows, n, q))
    s, vt = s[:rank], vt[:rank]
    right = q @ vt.T
    # A q = U s V': left vectors are A q V / s = A right / s.
    return s, right, np.divide(right, s, out=np.zeros_like(right), where=s > s[:1] * 1e-14 if len(s) else False), passes


def _vectors(df: DataFrame, by: list[str], along: list[str], index: DataFrame, x: str) -> DataFrame:
    small = F.broadcast(index) if index.count() * (16 + 8 * len(along)) <= 64 << 20 else index
    v = F.collect_list(F.struct("_i", F.col(x).cast("double").alias("x")))
    return df.where(F.col(x).isNotNull()).join(small, along).groupBy(*by).agg(v.alias("_v")).select(*by, F.col("_v._i").alias("i"), F.col("_v.x").alias("x"))


def numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct labels with their number ``_i`` in order; offsets of partitions are all that the driver sees."""
    labels = df.select(*names).distinct().repartitionByRange(*names).sortWithinPartitions(*names)
    # The lower 33 bits of the id count a partition's rows.
    kept = written(labels.select(*names, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_r")))
    at, offset = 0, {}
    for r in kept.groupBy("_p").count().orderBy("_p").collect():
        offset[r["_p"]] = at
        at += r["count"]
    if at >= 1 << 31:
        raise ValueError(f"{at} distinct {names}")
    start = F.create_map(*[F.lit(v) for pair in offset.items() for v in pair]) if offset else F.create_map(F.lit(0), F.lit(0))
    return kept.select(*names, (start[F.col("_p")] + F.col("_r")).cast("int").alias("_i"))


def eof_fit_large(df: DataFrame, state: list[str], sample: list[str], rank: int, x: str = "x", **how) -> LargeEof:
    """The leading ``rank`` modes of a long table as it is (not centred); missing entries count as 0.

    ``how``: ``oversample``, ``tolerance``, ``most``, ``seed`` of ``leading``.
    Of a mode's two signs the one with the positive largest entry is taken.
    """
    st, sa = numbered(df, state), numbered(df, sample)
    n_states, n_samples = st.count(), sa.count()
    rank = min(rank, n_states, n_samples)
    by_state = n_samples <= n_states
    index, along, by, n = (sa, sample, state, n_samples) if by_state else (st, state, sample, n_states)
    rows = written(_vectors(df, by, along, index, x))
    var = df.groupBy(*state).agg(F.var_samp(x).alias("v")).agg(F.sum("v")).first()[0]
    s, right, to_left, passes = leading(rows, n, rank, **how)
    if by_state:
        modes = left_vectors(rows, state, n, to_left)
    else:
        spark = df.sparkSession
        flat = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(right)], "_i int, u array<double>")
        modes = written(st.join(F.broadcast(flat), "_i").select(*state, "u"))  # CELLS numbers at most
    return LargeEof(state, oriented(modes, rank), s, n_samples, float(var or 0.0), passes)


def eof_fit_rows(rows: DataFrame, state: list[str], rank: int, values: str = "values", **how) -> LargeEof:
    """The same for rows ``(state, values)`` that are stacked already (``linear.stack_state``): an array of all samples each."""
    n = rows.select(F.size(values)).first()[0]
    v = F.col(values)
    plain = rows.select(*state, F.lit(None).cast("array<int>").alias("i"), v.alias("x"))
    mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
    var = rows.select((F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y) - n * mean * mean).alias("v")).agg(F.sum("v") / (n - 1)).first()[0]
    s, _, to_left, passes = leading(plain, n, min(rank, n), **how)
    return LargeEof(state, oriented(left_vectors(plain, state, n, to_left), len(s)), s, n, float(var or 0.0), passes)


def left_vectors(rows: DataFrame, state: list[str], n: int, to_left: np.ndarray) -> DataFrame:
    """``state, u``: a map of the rows, written."""
    shared = rows.sparkSession.sparkContext.broadcast(to_left)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in state) + ", u array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value.shape[1]
        for part, a in panels(batches, n):
            u = a @ shared.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)), pa.array(u.ravel()))
            yield pa.record_batch([*[part.column(part.schema.get_field_index(c)) for c in state], lists], names=[*state, "u"])

    return written(rows.mapInArrow(run, schema))


def oriented(modes: DataFrame, rank: int) -> DataFrame:
    """Modes with their largest entry positive; the table is read once for ``rank`` numbers."""
    if not rank:
        return modes
    big = modes.agg(*[F.max_by(F.col("u")[k], F.abs(F.col("u")[k])).alias(f"m{k}") for k in range(rank)]).first()
    sign = F.array(*[F.lit(-1.0 if (big[k] or 0) < 0 else 1.0) for k in range(rank)])
    return modes.withColumn("u", F.zip_with("u", sign, lambda u, s: u * s))
