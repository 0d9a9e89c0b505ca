"""The assimilation cycle: observations and forecasts, season after season.

The recurrence is sequential and its reduced state small (about 130 by 400),
so one task runs one Monte-Carlo iteration; iterations run side by side.  The
schedule, what is assimilated when, is a join done before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_RADIUS_M
from ..functions.timeaxis import split_seasonality
from ..operators.enkf import assimilate_time_average, assimilate_time_stack, inflate
from ..operators.lim import Lim
from ..operators.proxies import SEASONALITIES

HISTORY = 4
#: Integration steps a year of the stochastic forecast.
STEPS_PER_YEAR = 1440


def schedule(obs: DataFrame, seasonal: DataFrame | None, annual: DataFrame | None, year_start: int, year_end: int) -> DataFrame:
    """``step, pid, obs, slope, intercept, err_std, row, back``: what is assimilated at each step.

    Models carry ``row`` (of the backward matrix) for reduced space, or ``at``
    (number of a state row) for physical space.

    A season's record meets its season's model; an annual one is due in the
    last season of its seasonality and needs all of them since the start.
    ``back`` are the steps before the current one (0: itself) it stands for.
    A record with several values at one step is an error.
    """
    step = (F.col("year") - year_start) * 4
    parts = []
    if seasonal is not None:
        s = obs.join(seasonal, ["pid", "season"]).withColumn("step", step + F.col("season")).withColumn("back", F.array(F.lit(0)))
        parts.append(s)
    if annual is not None:
        table = []
        for k, list_ in enumerate(SEASONALITIES):
            before, own = split_seasonality(list(list_))
            order = [q - 4 for q in before] + list(own)
            table.append((k, list_[-1], [order[-1] - q for q in order]))
        kinds = obs.sparkSession.createDataFrame(table, "seasonality int, last int, back array<int>")
        a = obs.join(annual.join(F.broadcast(kinds), "seasonality"), "pid").withColumn("step", step + F.col("last"))  # ten rows
        parts.append(a.where(F.array_max("back") <= F.col("step")))
    out = None
    for p in parts:
        p = p.where(F.col("value").isNotNull() & F.col("year").between(year_start, year_end)).select("step", "pid", F.col("value").alias("obs"), "slope", "intercept", "err_std", *[c for c in ("row", "at") if c in p.columns], "back")
        out = p if out is None else out.unionByName(p)
    once = out.groupBy("step", "pid").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in out.columns if c not in ("step", "pid")])
    return once.withColumn("_e", F.when(F.col("_n") > 1, F.raise_error(F.lit("several values of a record at one step")))).where(F.col("_e").isNull()).drop("_n", "_e")


@dataclass
class Physical:
    """Assimilation in physical space, which allows localisation: matrices to reduced space and back, places of the rows."""

    forward: np.ndarray
    backward: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    radius_km: float | None = None

    def localization(self, row: int) -> np.ndarray | None:
        """Weights of all state rows around the row that an observation looks at."""
        if self.radius_km is None:
            return None
        a, b = np.radians(self.lat[row]), np.radians(self.lat)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(self.lon - self.lon[row]) / 2) ** 2
        z = 2 * EARTH_RADIUS_M / 1e3 * np.arcsin(np.sqrt(np.minimum(h, 1))) / (self.radius_km / 2)
        near = 1 + z**2 * (-5 / 3 + z * (5 / 8 + z * (0.5 - z / 4)))
        with np.errstate(divide="ignore"):
            far = 4 - 5 * z + z**2 * (5 / 3 + z * (5 / 8 + z * (-0.5 + z / 12))) - 2 / (3 * z)
        return np.where(z <= 1, near, np.where(z <= 2, far, 0.0))


def run_cycle(prior: np.ndarray, due: dict[int, list], lim: Lim, steps: int, mode: str, rng: np.random.Generator, inflation: float | None, substeps: int, space: Physical | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields ``(step, prior, final posterior)``; a posterior is final when it has left the window.

    ``mode`` is ``average`` or ``stack`` (window of four seasons) or
    ``instantaneous`` (the current season alone).  With ``space`` the state is
    physical, observations look at single rows of it (``at``), and only the
    forecast goes through reduced space.
    """
    if mode == "instantaneous" and any(list(r["back"]) != [0] for rows in due.values() for r in rows):
        raise ValueError("instantaneous assimilation takes seasonal records only")
    filter_ = assimilate_time_stack if mode == "stack" else assimilate_time_average
    history = 1 if mode == "instantaneous" else HISTORY
    window: list[tuple[int, np.ndarray, np.ndarray]] = []
    for step in range(steps):
        window.append((step, prior, prior))
        if len(window) > history:
            yield window.pop(0)
        x = np.stack([w[2] for w in window], axis=2)
        last = len(window) - 1
        rows = [r for r in due.get(step, []) if max(r["back"]) <= last]
        if rows:
            look = (lambda s, r: np.asarray(r["row"]) @ s) if space is None else (lambda s, r: s[int(r["at"])])
            psms = [lambda s, r=r: r["intercept"] + r["slope"] * look(s, r) for r in rows]
            locs = [space.localization(int(r["at"])) for r in rows] if space is not None and space.radius_km is not None else None
            x = filter_(x, [r["obs"] for r in rows], psms, [r["err_std"] for r in rows], [[last - b for b in r["back"]] for r in rows], locs)
        window = [(w[0], w[1], x[:, :, k]) for k, w in enumerate(window)]
        now = window[-1][2] if space is None else space.forward @ window[-1][2]
        prior = lim.simulate(now, 1, substeps, rng)[:, :, -1]
        if space is not None:
            prior = space.backward @ prior
        if inflation is not None:
            prior = inflate(prior, inflation)
    yield from window


def reconstruct(due: DataFrame, iterations: int, initial: np.ndarray, lim: Lim, year_start: int, year_end: int, fraction: float = 1.0, mode: str = "average", inflation: float | None = None, seed: int = 562_151, substeps: int | None = None, space: Physical | None = None) -> DataFrame:
    """``iteration, year, season, state, ens, prior, posterior`` of all iterations.

    Each iteration assimilates a seeded share of the records.  Model and
    initial ensemble (a few MB) go out as broadcast variables.  A step's rows
    leave the task when it is final, so a task holds a window and no history.
    """
    spark = due.sparkSession
    shared = spark.sparkContext.broadcast((initial, lim.to_json(), space))
    steps = (year_end - year_start + 1) * 4
    sub = substeps or int(STEPS_PER_YEAR * lim.tau)
    runs = spark.range(iterations).select(F.col("id").cast("int").alias("iteration"))
    chosen = F.pmod(F.xxhash64(F.lit(544_502) + F.col("iteration"), F.col("pid")), F.lit(1 << 30)) < int(fraction * (1 << 30))
    rows = due.crossJoin(F.broadcast(runs)).where(chosen)  # as many rows as iterations
    # An iteration without records still runs.
    rows = runs.join(rows, "iteration", "left")

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x0, text, physical = shared.value
        pdf = pd.concat(batches)
        by_step: dict[int, list] = {}
        for r in pdf.dropna(subset=["step"]).sort_values(["step", "pid"]).to_dict("records"):
            by_step.setdefault(int(r["step"]), []).append(r)
        rng = np.random.default_rng([seed, key[0]])
        n, m = x0.shape
        for step, before, after in run_cycle(x0, by_step, Lim.from_json(text), steps, mode, rng, inflation, sub, physical):
            yield pd.DataFrame({"iteration": key[0], "year": year_start + step // 4, "season": step % 4, "state": np.repeat(np.arange(n), m), "ens": np.tile(np.arange(m), n), "prior": before.ravel(), "posterior": after.ravel()})

    return rows.groupBy("iteration").applyInPandas(run, "iteration int, year int, season int, state int, ens int, prior double, posterior double")


def initial_from_sample(reduced: DataFrame, members: int, seed_offset: int = 0) -> np.ndarray:
    """``[state, ens]``: reduced states of ``members`` DJF years drawn without replacement."""
    djf = reduced.where("season = 0")
    years = sorted(r[0] for r in djf.select("year").distinct().collect())
    if len(years) < members:
        raise ValueError("fewer years than members")
    drawn = np.random.default_rng(682_652 + seed_offset).choice(years, members, replace=False)
    rows = djf.where(F.col("year").isin([int(y) for y in drawn])).select("year", "state", "x").toPandas()
    return rows.pivot(index="state", columns="year", values="x")[list(drawn)].to_numpy()


def initial_from_noise(state: np.ndarray, std: float, members: int, seed: int = 562_151) -> np.ndarray:
    """A state times normal factors around 1."""
    return state[:, None] * np.random.default_rng(seed).normal(1.0, std, (len(state), members))
