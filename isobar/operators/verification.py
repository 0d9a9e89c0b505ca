"""Verification of stochastic forecasts, in reduced and in physical space.

Every case (a start) and every block of its members is a task of its own with a
random stream keyed by seed, case and block, so results depend neither on
partitions nor on what else is forecast.  Scores are two sums: over the members
of a case at a lead, then over cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lim import Lim
from .linear import indexed, sized
from .mapper import Mapper
from .proxies import drawn

#: Members of a task; starts of a task where only scores are asked for.
BLOCK, STARTS = 25, 64


def starts(reduced: DataFrame, step: str, horizon: int, cases: int | None = None, seed: int = 89_155_354) -> DataFrame:
    """``case``: steps that all of the next ``horizon`` follow; ``cases`` of them, drawn by a hash, or all."""
    steps = reduced.select(F.col(step).cast("bigint").alias("case")).distinct()
    # Each step says for which starts it is needed; a start has all that it needs.
    due = steps.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda k: F.col("case") - k)).alias("case"))
    whole = due.groupBy("case").count().where(F.col("count") == horizon + 1).select("case")
    return whole if cases is None else whole.orderBy(drawn(F.col("case"), seed)).limit(cases)


def stochastic_forecasts(model: Lim, reduced: DataFrame, step: str, horizon: int, members: int, substeps: int, state: str = "state", x: str = "x", cases: int | None = None, seed: int = 45_287_653, keep_initial: bool = True) -> DataFrame:
    """``case, lead, ens, state, x``: ``members`` stochastic forecasts from every case, ``horizon`` steps long; lead 0 is the start."""
    st, labels = indexed(reduced, [state])
    n = len(labels)
    if n != len(model.g):
        raise ValueError(f"the model has {len(model.g)} elements, the state {n}")
    vec = reduced.join(F.broadcast(st), state).groupBy(F.col(step).cast("bigint").alias("case")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(x).cast("double").alias("v")))), lambda s: s["v"]).alias("x0"))
    blocks = -(-members // BLOCK)
    tasks = vec.where(F.size("x0") == n).join(starts(reduced, step, horizon, cases, seed), "case").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared = reduced.sparkSession.sparkContext.broadcast(model.to_json())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lim = Lim.from_json(shared.value)
        for rb in batches:
            for case, x0, block in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                m = min(BLOCK, members - block * BLOCK)
                rng = np.random.default_rng([seed, case % (1 << 63), block])
                out = lim.simulate(np.repeat(np.array(x0)[:, None], m, axis=1), horizon, substeps, rng, keep_initial)
                flat = np.ascontiguousarray(np.moveaxis(out, 0, 2))  # member, lead, state
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n, dtype=np.int32)), pa.array(flat.ravel()))
                ens = np.repeat(np.arange(m, dtype=np.int32) + block * BLOCK, horizon + 1)
                lead = np.tile(np.arange(horizon + 1, dtype=np.int32), m)
                yield pa.record_batch([pa.array(np.full(len(ens), case)), pa.array(lead), pa.array(ens), lists], names=["case", "lead", "ens", "v"])

    # A task is dear and its row small: blocks are dealt evenly before they are forecast.
    dealt = tasks.select("case", "x0", "block").repartition(F.xxhash64("case", "block"))
    out = dealt.mapInArrow(run, "case bigint, lead int, ens int, v array<double>")
    return out.select("case", "lead", "ens", F.posexplode("v").alias("_i", "x")).join(F.broadcast(st), "_i").select("case", "lead", "ens", state, "x")


def by_case(forecasts: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """``case, lead, by, mean, variance`` over members."""
    return forecasts.groupBy("case", "lead", *by).agg(F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"))


def scores(cases: DataFrame, truth: DataFrame, step: str, by: list[str], x: str = "x", name: str = "rmse") -> DataFrame:
    """``lead, by, <name>, spread, cases``: error of the ensemble mean against what came, and root of the mean variance.

    ``cases`` are the rows of ``by_case``; pairs without a truth are not counted.
    """
    came = truth.select(F.col(step).cast("bigint").alias("_t"), *by, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    pairs = cases.withColumn("_t", F.col("case") + F.col("lead")).join(came, ["_t", *by])
    return pairs.groupBy("lead", *by).agg(F.sqrt(F.avg((F.col("mean") - F.col("_x")) ** 2)).alias(name), F.sqrt(F.avg("variance")).alias("spread"), F.count(F.lit(1)).alias("cases"))


def state_scores(model: Lim, reduced: DataFrame, step: str, horizon: int, members: int, substeps: int, state: str = "state", x: str = "x", cases: int | None = None, seed: int = 45_287_653, keep_initial: bool = True) -> DataFrame:
    """``scores`` by state element of the forecasts that ``stochastic_forecasts`` would draw, without a row for each of their numbers.

    Steps go in runs of ``STARTS``, each with the ``horizon`` steps after it: a
    task forecasts from its starts, block by block with the same streams,
    compares with what came, and hands out sums for each lead and element.
    """
    st, labels = indexed(reduced, [state])
    n = len(labels)
    if n != len(model.g):
        raise ValueError(f"the model has {len(model.g)} elements, the state {n}")
    width = max(STARTS, 8 * horizon)
    spark = reduced.sparkSession
    drawn_cases = None if cases is None else [r["case"] for r in starts(reduced, step, horizon, cases, seed).collect()]  # ``cases`` numbers
    shared = spark.sparkContext.broadcast(model.to_json())

    def run(table: pa.Table) -> pa.Table:
        lim = _model(shared.value)
        first = table.column("_run")[0].as_py()
        t, i, v = (table.column(c).to_numpy() for c in ("_t", "_i", "_v"))
        known = table.column("_v").is_valid().to_numpy()
        steps, at = np.unique(t, return_inverse=True)
        full, start = np.zeros((len(steps), n), bool), np.zeros((len(steps), n))
        full[at[known], i[known]], start[at[known], i[known]] = True, v[known]
        whole = (steps >= first) & (steps < first + width) & full.all(1) & (np.bincount(at, minlength=len(steps)) == n)
        for k in range(1, horizon + 1):
            whole &= np.isin(steps + k, steps)
        if drawn_cases is not None:
            whole &= np.isin(steps, drawn_cases)
        case, x0 = steps[whole], start[whole]
        mean, square = np.zeros((2, len(case), n, horizon + 1))
        if lim.quiet(substeps):  # members are all the same
            mean = np.moveaxis(lim.simulate(x0.T, horizon, substeps, np.random.default_rng(seed), keep_initial), 1, 0)
        else:
            for c in range(len(case)):
                done = 0
                for block in range(-(-members // BLOCK)):
                    m = min(BLOCK, members - block * BLOCK)
                    rng = np.random.default_rng([seed, int(case[c]) % (1 << 63), block])
                    out = lim.simulate(np.repeat(x0[c][:, None], m, axis=1), horizon, substeps, rng, keep_initial)
                    own = out.mean(1)
                    gap = own - mean[c]
                    square[c] += ((out - own[:, None]) ** 2).sum(1) + gap**2 * (done * m / (done + m))
                    mean[c] += gap * (m / (done + m))
                    done += m
        variance = square / max(members - 1, 1)
        sums = []
        for k in range(horizon + 1):
            due = known & np.isin(t - k, case)
            c, e = np.searchsorted(case, t[due] - k), i[due]
            error = mean[c, e, k] - v[due]
            sums.append([np.bincount(e, w, n) for w in (error**2, variance[c, e, k], np.ones(len(e)))])
        lists = lambda j, kind: pa.array([s[j].tolist() for s in sums], pa.list_(kind))
        return pa.table({"lead": pa.array(range(horizon + 1), pa.int32()), "e": lists(0, pa.float64()), "s": lists(1, pa.float64()), "m": pa.array([s[2].astype(np.int64).tolist() for s in sums], pa.list_(pa.int64()))})

    t = F.col(step).cast("bigint")
    rows = reduced.join(F.broadcast(st), state).select(t.alias("_t"), "_i", F.col(x).cast("double").alias("_v"))
    t, size = F.col("_t"), F.lit(width).cast("bigint")
    runs = F.sequence(t - horizon - F.pmod(t - horizon, size), t - F.pmod(t, size), size)
    # A task is dear and its rows few: a fixed number of partitions, so that they are not put together.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sums = rows.withColumn("_run", F.explode(runs)).repartition(parts, "_run").groupBy("_run").applyInArrow(run, "lead int, e array<double>, s array<double>, m array<bigint>")
    each = sums.select("lead", F.posexplode(F.arrays_zip("e", "s", "m")).alias("_i", "z")).groupBy("lead", "_i").agg(*[F.sum(f"z.{c}").alias(c) for c in "esm"])
    return each.where("m > 0").join(F.broadcast(st), "_i").select("lead", state, F.sqrt(F.col("e") / F.col("m")).alias("rmse"), F.sqrt(F.col("s") / F.col("m")).alias("spread"), F.col("m").alias("cases"))


@lru_cache(1)
def _model(text: str) -> Lim:
    return Lim.from_json(text)


def physical_forecasts(forecasts: DataFrame, mapper: Mapper, fields: list[str] | None = None) -> DataFrame:
    """``case, lead, ens, field, lat, lon, value``: the way back of every member."""
    if mapper.by_season:
        raise ValueError("forecasts of a seasonal mapper need the season of each lead")
    spark = forecasts.sparkSession
    places = mapper.backward_matrix(spark).select("field", "lat", "lon")
    chosen = places if fields is None else places.where(F.col("field").isin(*fields))
    return mapper.backward(forecasts, ["case", "lead", "ens"], chosen).select("case", "lead", "ens", "field", "lat", "lon", "value")


def verify_physical(forecasts: DataFrame, mapper: Mapper, cells: DataFrame, time: list[str], step, fields: list[str] | None = None) -> DataFrame:
    """``field, lat, lon, lead, rmse, rmse_truncated, spread, cases`` against the truth and against what of it the reduced space can hold.

    ``step`` (a column of ``time``) is the number of a time step, as in the
    forecasts.  The first compares with the state as it came, so it includes
    what truncation loses; the second is the error of the forecast alone.
    """
    by = ["field", "lat", "lon"]
    own = by_case(physical_forecasts(forecasts, mapper, fields), by, "value")
    truth = cells.select(*by, step.alias("_k"), "value")
    held = mapper.truncate(cells, time).select(*by, step.alias("_k"), "value")
    whole = scores(own, truth, "_k", by, "value")
    cut = scores(own, held, "_k", by, "value", "rmse_truncated").drop("spread", "cases")
    return whole.join(sized(cut), ["lead", *by]).select(*by, "lead", "rmse", "rmse_truncated", "spread", "cases")
