"""Matrix views of field tables: state vectors, EOFs, covariances.

A matrix is a long table of state columns, sample columns and ``x``.  Products
over samples are summed inside partitions and then in a tree (``sums``), so only
matrices of the smaller side's size (at most ``SIDE`` squared) reach the driver.  States
may be more than that where samples are not: they are numbered without a
window, and the driver holds their labels and modes (``CELLS`` numbers at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .sums import STRIP, panels, salted, strips, summed

#: Largest side of a matrix that is solved on the driver (0.5 GB of doubles at 8192).
SIDE = 8192
#: Largest number of entries of the modes of a fit (0.5 GB of doubles).
CELLS = 1 << 26
#: Bytes of a table that is sent to every task.
BROADCAST_BYTES = 64 << 20


def stack_state(df: DataFrame, state: list[str], sample: list[str], value: str = "value") -> DataFrame:
    """One row for each state element, its values in the order of samples."""
    return df.groupBy(*state).agg(F.transform(F.array_sort(F.collect_list(F.struct(*sample, F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def unstack_state(stacked: DataFrame, state: list[str], samples: DataFrame, sample: list[str]) -> DataFrame:
    """Back to long form; ``samples`` are the distinct sample labels."""
    numbered = samples.select(*sample).distinct().withColumn("_k", F.row_number().over(Window.orderBy(*sample)) - 1)
    return stacked.select(*state, F.posexplode("values").alias("_k", "value")).join(F.broadcast(numbered), "_k").drop("_k")  # one row a time step


def complete_rows(df: DataFrame, state: list[str], value: str = "value") -> DataFrame:
    """State elements without a gap (the mask that EOFs need)."""
    return df.groupBy(*state).agg((F.count(value) == F.count(F.lit(1))).alias("complete"))


def nan_mask(df: DataFrame, state: list[str], value: str = "value") -> DataFrame:
    """Rows of state elements without a gap."""
    return df.join(complete_rows(df, state, value).where("complete").select(*state), state, "left_semi")


def indexed(df: DataFrame, names: list[str], most: int | None = None) -> tuple[DataFrame, list[tuple]]:
    """Distinct labels in order with their number; at most ``most`` (``SIDE``) of them reach the driver."""
    most = SIDE if most is None else most
    rows = df.select(*names).distinct().orderBy(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct {names}")
    labels = [tuple(r) for r in rows]
    spark = df.sparkSession
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return spark.createDataFrame([(*r, k) for k, r in enumerate(labels)], f"{schema}, _i int"), labels


def sized(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast where it is small: its rows are counted, with the entries of their arrays."""
    arrays = [f.name for f in table.schema if isinstance(f.dataType, ArrayType)]
    entries = F.coalesce(F.sum(sum((F.size(F.col(f"`{c}`")) for c in arrays), F.lit(0)).cast("bigint")), F.lit(0))
    held = table.agg(F.count(F.lit(1)).alias("n"), entries.alias("m")).first()
    return F.broadcast(table) if 8 * (held["n"] * (2 + len(table.columns)) + held["m"]) <= BROADCAST_BYTES else table


def _products(vectors: DataFrame, n: int) -> np.ndarray:
    """Sum of ``v v'`` over rows ``(i array<int>, x array<double>)``."""
    height = max(1, STRIP // max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, m in panels(batches, n):
            total = m.T @ m if total is None else np.add(total, m.T @ m, out=total)
        if total is not None:
            for s, v in strips(total, height):
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([v], pa.binary())], names=["strip", "v"])

    out = np.zeros((n, n))
    for r in summed(salted(vectors.select("i", "x").mapInArrow(run, "strip int, v binary"))).toLocalIterator():
        part = np.frombuffer(r["v"]).reshape(-1, n)
        out[r["strip"] * height : r["strip"] * height + len(part)] = part
    return out


def _vectors(df: DataFrame, by: list[str], index: DataFrame, names: list[str], x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).join(sized(index), names).groupBy(*by).agg(F.collect_list(F.struct("_i", F.col(x).alias("x"))).alias("_v")).select(*by, F.col("_v._i").alias("i"), F.col("_v.x").alias("x"))


@dataclass
class EofFit:
    """Modes ``u`` (state x mode) with singular values ``s``."""

    names: list[str]
    states: list[tuple]
    u: np.ndarray
    s: np.ndarray
    samples: int
    total_variance: float
    dof: float = float("nan")
    extra: dict = field(default_factory=dict)

    @property
    def variance(self) -> np.ndarray:
        return self.extra.get("variance", self.s**2 / (self.samples - 1))

    @property
    def fraction(self) -> np.ndarray:
        return self.variance / self.total_variance

    @property
    def fraction_error(self) -> np.ndarray:
        """Sampling error after North's rule."""
        return self.fraction * np.sqrt(2 / self.dof)

    @property
    def retained(self) -> float:
        return float(self.variance.sum())

    def table(self, spark, name: str = "eof") -> DataFrame:
        kinds = ["double" if isinstance(v, float) else "string" if isinstance(v, str) else "bigint" for v in self.states[0]]
        schema = ", ".join(f"`{n}` {k}" for n, k in zip(self.names, kinds, strict=True))
        return spark.createDataFrame([(name, m, *st, float(self.u[i, m])) for m in range(self.u.shape[1]) for i, st in enumerate(self.states)], f"name string, mode int, {schema}, u double")


def _signed(u: np.ndarray) -> np.ndarray:
    """Modes with their largest entry positive."""
    big = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    return u * np.where(big < 0, -1.0, 1.0)


def eof_fit(df: DataFrame, state: list[str], sample: list[str], rank: int | None = None, x: str = "x", with_dof: bool = False) -> EofFit:
    """Leading singular vectors of the matrix as it is (not centred), from the Gram matrix of its smaller side.

    The smaller side may have ``SIDE`` elements; the modes ``CELLS`` entries.
    """
    n_states, n_samples = (df.select(*c).distinct().count() for c in (state, sample))
    top = min(n_states, n_samples)
    rank = top if rank is None else min(rank, top)
    if top > SIDE or n_states * max(rank, 1) > CELLS:
        raise ValueError(f"{n_states} states and {n_samples} samples for {rank} modes: the smaller side may have {SIDE}, the modes {CELLS} entries")
    st, states = indexed(df, state, n_states)
    if n_states <= n_samples:
        g = _products(_vectors(df, sample, st, state, x), len(states))
        value, vec = np.linalg.eigh(g)
        order = np.argsort(value)[::-1][:rank]
        u, s = vec[:, order], np.sqrt(np.maximum(value[order], 0))
    else:
        sa, samples = indexed(df, sample)
        g = _products(_vectors(df, state, sa, sample, x), len(samples))
        value, vec = np.linalg.eigh(g)
        order = np.argsort(value)[::-1][:rank]
        s, v = np.sqrt(np.maximum(value[order], 0)), vec[:, order]

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [np.asarray(xx) @ v[i] for i, xx in zip(b["i"], b["x"], strict=True)]
                yield pd.DataFrame({"k": b["_i"], "u": [r / np.where(s > 0, s, 1) for r in rows]})

        rows = _vectors(df, state, sa, sample, x).join(sized(st), state).select("_i", "i", "x").mapInPandas(project, "k int, u array<double>").toPandas()
        u = np.zeros((len(states), rank))
        u[rows["k"]] = np.vstack(rows["u"]) if len(rows) else u
    var = df.groupBy(*state).agg(F.var_samp(x).alias("v")).agg(F.sum("v")).first()[0]
    out = EofFit(state, states, _signed(u), s, n_samples, float(var or 0.0))
    if with_dof:
        from .reduce import effective_dof

        out.dof = float(effective_dof(df, state, sample, x).first()["dof"])
    return out


def varimax(loadings: np.ndarray, normalize: bool = True, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Orthogonal rotation that maximises the variance of squared loadings."""
    h = np.sqrt((loadings**2).sum(1)) if normalize else np.ones(len(loadings))
    h[h == 0] = 1
    a = loadings / h[:, None]
    r = np.eye(a.shape[1])
    gain = 0.0
    for _ in range(rounds):
        b = a @ r
        u, s, v = np.linalg.svd(a.T @ (b**3 - b * (b**2).mean(0)))
        r = u @ v
        if s.sum() < gain * (1 + tolerance):
            break
        gain = s.sum()
    return (a @ r) * h[:, None]


def rotate(fit: EofFit, scale: bool = True, normalize: bool = True) -> EofFit:
    """Varimax-rotated modes, ordered by the length of their loadings (which stands for their variance)."""
    load = varimax(fit.u * fit.s / np.sqrt(fit.samples) if scale else fit.u, normalize)
    length = np.sqrt((load**2).sum(0))
    order = np.argsort(length)[::-1]
    length = length[order]
    out = EofFit(fit.names, fit.states, load[:, order] / length, np.sqrt(length * fit.samples), fit.samples, fit.total_variance, fit.dof)
    out.extra["variance"] = length
    return out


def basis(spark, fit: EofFit) -> DataFrame:
    """State columns and their row of the modes."""
    kinds = ["double" if isinstance(v, float) else "string" if isinstance(v, str) else "bigint" for v in fit.states[0]]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(fit.names, kinds, strict=True))
    return spark.createDataFrame([(*st, [float(v) for v in fit.u[i]]) for i, st in enumerate(fit.states)], f"{schema}, u array<double>")


def project(rows: DataFrame, modes: DataFrame, state: list[str], sample: list[str], x: str = "x") -> DataFrame:
    """``sample, mode, score``: ``U' x``; ``modes`` are (state, u array), with a column ``first`` the number of the first mode in ``u``."""
    each = rows.where(F.col(x).isNotNull()).join(sized(modes), state).select(*sample, F.col(x).alias("_x"), *([F.col("first").alias("_f")] if "first" in modes.columns else []), F.posexplode("u").alias("mode", "_u"))
    if "first" in modes.columns:
        each = each.withColumn("mode", F.col("mode") + F.col("_f"))
    return each.groupBy(*sample, "mode").agg(F.sum(F.col("_x") * F.col("_u")).alias("score"))


def product(u: Column, scores: Column) -> Column:
    """Sum of ``u[m] * scores[m]``; ``scores`` maps modes to numbers, missing ones count as 0."""
    parts = F.transform(u, lambda x, m: F.coalesce(x * F.try_element_at(scores, m), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def by_mode(scores: DataFrame, sample: list[str], mode: str = "mode", score: str = "score") -> DataFrame:
    """``sample, _s``: a row for each sample with its scores as a map."""
    return scores.groupBy(*sample).agg(F.map_from_entries(F.collect_list(F.struct(F.col(mode), F.col(score)))).alias("_s"))


def reconstruct(scores: DataFrame, modes: DataFrame, state: list[str], sample: list[str]) -> DataFrame:
    """``state, sample, x``: ``U score``; a row of scores for each sample meets each state once."""
    # Every state at every sample is the result itself: nothing is multiplied beyond it.
    return by_mode(scores, sample).crossJoin(sized(modes.select(*state, "u"))).select(*state, *sample, product(F.col("u"), F.col("_s")).alias("x"))


def eof_project(rows: DataFrame, fit: EofFit, sample: list[str], x: str = "x") -> DataFrame:
    return project(rows, basis(rows.sparkSession, fit), fit.names, sample, x)


def lag_covariance(df: DataFrame, state: str, sample: str, lag: int = 1, x: str = "x") -> DataFrame:
    """``i, j, c0, ct``: covariances at lag 0 and ``lag`` (sums over the lagged pairs, divided by their number less one); x has zero mean."""
    st, states = indexed(df, [state])
    n = len(states)
    vec = df.join(F.broadcast(st), state).groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(x).alias("x")))), lambda s: s["x"]).alias("a"))
    # Pairs meet by number, so no window over the whole axis is needed.
    order = vec.select(F.col(sample).alias("k"), "a")
    pairs = order.select("k", F.col("a").alias("x0")).join(order.select((F.col("k") - lag).alias("k"), F.col("a").alias("x1")), "k")

    height = max(1, STRIP // max(2 * n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, m = np.zeros((n, 2, n)), 0
        for rb in batches:
            if rb.num_rows:
                x0, x1 = (rb.column(k).flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, n) for k in (0, 1))
                both[:, 0] += x0.T @ x0
                both[:, 1] += x1.T @ x0
                m += rb.num_rows
        if m:  # the number of pairs goes with each strip
            for k in range(0, n, height):
                yield pa.record_batch([pa.array([k // height], pa.int32()), pa.array([np.r_[m, both[k : k + height].ravel()].tobytes()], pa.binary())], names=["strip", "v"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for s, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v)
                both = x[1:].reshape(-1, 2, n) / (x[0] - 1)
                i, j = np.divmod(np.arange(len(both) * n), n)
                yield pa.record_batch([pa.array((i + s * height).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[:, 0].ravel()), pa.array(both[:, 1].ravel())], names=["i", "j", "c0", "ct"])

    sums = summed(salted(pairs.select("x0", "x1").mapInArrow(run, "strip int, v binary")))
    return sums.mapInArrow(entries, "i int, j int, c0 double, ct double")
