"""Serial ensemble square-root filters.

``update`` is one observation as joins and aggregates over a distributed
state; the array versions serve the assimilation cycle, whose reduced state
fits in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import sized


def update(prior: DataFrame, estimate: DataFrame, obs: float, error_std: float, state: list[str], ens: str = "ens", value: str = "value", localization: DataFrame | None = None) -> DataFrame:
    """Posterior of ``prior(state, ens, value)`` after one observation.

    ``estimate(ens, y)`` is the observation's estimate by each member (one row
    a member); ``localization(state, loc)`` scales the gain of state rows.
    """
    stats = estimate.agg(F.avg("y").alias("ym"), (F.var_samp("y") + error_std**2).alias("iv"))
    y = sized(estimate.crossJoin(F.broadcast(stats)))  # one row a member, and one in all
    rows = prior.join(y, ens)
    w = Window.partitionBy(*state)
    gain = F.covar_samp(F.col(value), F.col("y")).over(w) / F.col("iv")
    if localization is not None:
        rows = rows.join(localization.select(*state, "loc"), state, "left")
        gain = gain * F.coalesce(F.col("loc"), F.lit(1.0))
    rows = rows.withColumn("_k", gain).withColumn("_m", F.avg(value).over(w))
    alpha = 1 / (1 + F.sqrt(F.lit(error_std**2) / F.col("iv")))
    new = F.col(value) + F.col("_k") * (F.lit(obs) - F.col("ym")) - alpha * F.col("_k") * (F.col("y") - F.col("ym"))
    return rows.select(*state, ens, new.alias(value))


def update_time_average(prior: DataFrame, obs: list[float], psms: list[dict[int, float]], errors: list[float], times: list[list[int]], steps: int, state: str = "state", ens: str = "ens", x: str = "x") -> DataFrame:
    """Table form of ``assimilate_time_average`` for linear observations.

    A row of ``prior(state, ens, x)`` holds an array of all ``steps`` time steps;
    ``psms[k]`` gives the weight of each state element that observation ``k``
    sees.  Each posterior is kept on executors, as the next observation reads
    it several times.
    """
    rows = prior.persist()
    for k, (o, weights, error, at) in enumerate(zip(obs, psms, errors, times, strict=True)):
        if k:
            rows = rows.persist()
        mean = rows.withColumn("_m", sum((F.col(x)[t] for t in at), F.lit(0.0)) / len(at))
        weight = F.create_map(*[F.lit(w) for pair in weights.items() for w in pair])
        # The observation is linear: its mean over the times is that of the mean state.
        seen = mean.where(F.col(state).isin(list(weights))).groupBy(ens).agg(F.sum(weight[F.col(state)] * F.col("_m")).alias("_y"))
        stats = seen.agg(F.avg("_y").alias("_ym"), (F.var_samp("_y") + error**2).alias("_iv"))
        pairs = mean.join(seen, ens)
        gain = pairs.groupBy(state).agg(F.covar_samp("_m", "_y").alias("_k"))
        # One row, and one row a state element.
        both = pairs.join(F.broadcast(gain), state).crossJoin(F.broadcast(stats))
        alpha = 1 / (1 + F.sqrt(F.lit(error**2) / F.col("_iv")))
        move = F.col("_k") / F.col("_iv") * (F.lit(o) - F.col("_ym") - alpha * (F.col("_y") - F.col("_ym")))
        rows = both.withColumn("_d", move).select(state, ens, F.zip_with(x, F.array(*[F.lit(t in at) for t in range(steps)]), lambda a, due: F.when(due, a + F.col("_d")).otherwise(a)).alias(x))
    return rows


def ensrf(prior: np.ndarray, obs: float, estimate: np.ndarray, error_std: float, loc: np.ndarray | None = None) -> np.ndarray:
    """Posterior of ``[state, ens]`` after one observation."""
    y = np.ravel(estimate)
    dy = y - y.mean()
    innovation = y.var(ddof=1) + error_std**2
    gain = (prior - prior.mean(1, keepdims=True)) @ dy / (len(y) - 1) / innovation
    if loc is not None:
        gain = gain * np.ravel(loc)
    alpha = 1 / (1 + np.sqrt(error_std**2 / innovation))
    return prior + np.outer(gain, obs - y.mean() - alpha * dy)


def _finite(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).any():
        raise ValueError("no posterior value is finite")
    return x


Psm = Callable[[np.ndarray], np.ndarray]


def assimilate(prior: np.ndarray, obs: list[float], psms: list[Psm], errors: list[float], locs: list[np.ndarray] | None = None) -> np.ndarray:
    """One observation after the other, each estimated from the state so far."""
    x = prior.copy()
    for k, o in enumerate(obs):
        x = _finite(ensrf(x, o, psms[k](x), errors[k], locs[k] if locs else None))
    return x


def assimilate_time_average(prior: np.ndarray, obs: list[float], psms: list[Psm], errors: list[float], times: list[list[int]], locs: list[np.ndarray] | None = None) -> np.ndarray:
    """``[state, ens, time]``: the mean over an observation's times is updated, deviations from it are put back."""
    x = prior.copy()
    for k, o in enumerate(obs):
        part = x[:, :, times[k]]
        mean = part.mean(2)
        estimate = np.mean([psms[k](x[:, :, t]) for t in times[k]], axis=0)
        new = ensrf(mean, o, estimate, errors[k], locs[k] if locs else None)
        x[:, :, times[k]] = part + (new - mean)[:, :, None]
        _finite(x)
    return x


def assimilate_time_stack(prior: np.ndarray, obs: list[float], psms: list[Psm], errors: list[float], times: list[list[int]], locs: list[np.ndarray] | None = None) -> np.ndarray:
    """``[state, ens, time]``: the states of an observation's times are one tall state."""
    x = prior.copy()
    for k, o in enumerate(obs):
        part = x[:, :, times[k]]
        tall = np.concatenate([part[:, :, j] for j in range(part.shape[2])])
        loc = np.tile(np.ravel(locs[k]), part.shape[2]) if locs else None
        new = ensrf(tall, o, psms[k](part.mean(2)), errors[k], loc)
        x[:, :, times[k]] = np.stack(np.split(new, part.shape[2]), axis=2)
        _finite(x)
    return x


def inflate(x: np.ndarray, factor: float) -> np.ndarray:
    mean = x.mean(1, keepdims=True)
    return mean + (x - mean) * np.sqrt(factor)
