"""Site records: resampling, duplicates, splits, and linear observation models.

``sites(pid, ptype, dt, lat, lon)`` and ``site_obs(pid, year, season, value)``;
models are rows with ``slope, intercept, err_std`` and their diagnostics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeaxis as ta
from ..functions.scalar import EARTH_RADIUS_M
from ..sources.storage import written
from .linear import sized

#: Least common samples, least correlation, largest autocorrelation of the residuals.
MIN_OVERLAP, MIN_CORR, MAX_ACOR = 25, 0.05, 0.9
#: The seasonalities tried for annual records.
SEASONALITIES: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (3, 0, 1, 2), (2, 3, 0, 1), (1, 2, 3, 0), (2,), (1, 2), (2, 3), (0,), (3, 0), (0, 1))
#: Observations of a part of a box; degrees of longitude of a box; records of a tile of products.
ENTRIES, _WIDE, _TILE = 1 << 19, 15.0, 512
MARINE = ("marine", "coral", "bivalve")


def seasonalize(obs: DataFrame, t: str = "t", value: str = "value") -> DataFrame:
    """Subseasonal records to seasons, unweighted; first and last seasons of a record with fewer than three samples go."""
    d = F.col(t) - F.floor(t)
    month = F.least(F.floor(d * 12).cast("int") + 1, F.lit(12))
    s = obs.select("pid", ta.season_year(F.floor(t).cast("int"), month).alias("year"), ta.season_of_month(month).alias("season"), F.col(t).alias("_t"), value)
    g = s.groupBy("pid", "year", "season").agg(F.avg(value).alias(value), F.countDistinct("_t").alias("_n"))
    k = F.col("year") * 4 + F.col("season")
    w = Window.partitionBy("pid")
    ends = g.withColumns({"_k": k, "_a": F.min(k).over(w), "_z": F.max(k).over(w)})
    return ends.where(~((F.col("_k") == F.col("_a")) | (F.col("_k") == F.col("_z"))) | (F.col("_n") >= 3)).select("pid", "year", "season", value)


def annual(obs: DataFrame, t: str = "t", value: str = "value") -> DataFrame:
    """One value a year: the mean of all samples whose time truncates to it."""
    return obs.groupBy("pid", F.col(t).cast("int").alias("year")).agg(F.avg(value).alias(value))


def by_resolution(sites: DataFrame) -> DataFrame:
    """``group``: subseasonal, seasonal or annual, from the nominal step; others have none."""
    dt = F.col("dt")
    return sites.withColumn("group", F.when(dt < 0.24, "subseasonal").when(dt.between(0.24, 0.26), "seasonal").when(dt.between(0.99, 1.01), "annual"))


def duplicates(sites: DataFrame, obs: DataFrame, min_corr: float = 0.999, max_km: float = 1000.0, min_overlap: int = 10, identical: bool = False, prefer: Column | None = None, time: list[str] | None = None) -> DataFrame:
    """``pid``: records to drop.

    Two records of one type and step, at most ``max_km`` apart, are duplicates
    if ``min_overlap`` common times or more correlate above ``min_corr``, or
    (``identical``) if they have the same values in order.  The longer stays;
    of equally long ones that for which ``prefer`` (a column of ``sites``)
    holds, else the later pid.

    Records meet in boxes of latitude and longitude, split into parts of
    ``ENTRIES`` observations; each pair of parts that may hold near records is a
    task that compares them by matrix products and hands out the records to
    drop, so that no row is sent for a pair of records or for their common times.
    """
    time = time or ["year", "season"]
    step = 10.0  # degrees; more than max_km on a meridian
    if max_km > step * 111:
        step = max_km / 111 + 1
    o = obs.where("value is not null")
    size = o.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    times = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in time])
    if identical:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct(*time, "value"))), lambda x: F.round(x["value"], 8) + F.lit(0.0))
        series = o.groupBy("pid").agg(F.sha2(F.to_json(in_order), 256).alias("_v"))
        alike, held, entries = ["ptype", "dt", "n", "_v"], [], F.lit(1)
    else:
        dated = o.where(F.concat(*[F.col(c).cast("string") for c in time]).isNotNull())  # no time, no common one
        series = dated.groupBy("pid").agg(F.collect_list(F.struct(times.alias("t"), F.col("value").cast("double").alias("x"))).alias("_o")).select("pid", F.col("_o.t").alias("t"), F.col("_o.x").alias("x"))
        alike, held, entries = ["ptype", "dt"], ["t", "x"], F.col("n")
    listed = sites.groupBy("pid").agg(F.count(F.lit(1)).alias("_k"))
    s = sites.withColumn("_f", (prefer if prefer is not None else F.lit(False)).cast("int")).join(size, "pid").join(listed, "pid").join(series, "pid")
    boxes = F.floor(F.col("lat") / step).cast("int").alias("_y"), F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / _WIDE).cast("int").alias("_x")
    s = written(s.select("pid", "ptype", F.round("dt", 4).alias("dt"), "lat", "lon", "n", "_k", "_f", *boxes, *[c for c in ("_v",) if identical], *held))
    cell = [*alike, "_y", "_x"]
    cells = s.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"), F.ceil(F.sum(entries) / ENTRIES).cast("int").alias("_parts"))
    meet = written(_meetings(cells, alike, step, max_km))
    rows = s.join(sized(cells.select(*cell, "_parts")), cell).withColumn("_p", F.pmod(F.xxhash64("pid"), F.col("_parts")).cast("int"))
    task = ["_ya", "_xa", "_pa", "_yb", "_xb", "_pb"]
    sent = rows.join(sized(meet), [*cell, "_p"]).select(*alike, *task, "_side", "pid", "lat", "lon", *[c for c in ("n", "_k", "_f") if c not in alike], *held)

    def run(table: pa.Table) -> pa.Table:
        return _losers(table, min_corr, max_km, min_overlap, identical)

    kind = sites.schema["pid"].dataType.simpleString()
    lost = sent.groupBy(*alike, *task).applyInArrow(run, f"pid {kind}, other {kind}, m bigint")
    # A pid that is listed at several places may have its common times in several tasks.
    return lost.groupBy("pid", "other").agg(F.sum("m").alias("m")).where(F.col("m") >= min_overlap).select("pid").distinct()


def _meetings(cells: DataFrame, alike: list[str], step: float, max_km: float) -> DataFrame:
    """Parts of boxes ``(alike, _y, _x, _p, _side)`` by the pairs of parts ``(_ya, ..., _pb)`` in which records may be near."""
    parts = cells.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    a = parts.select(*alike, *[F.col(c).alias(f"{c}a") for c in ("_y", "_x", "_p")], "_rows").withColumn("_yb", F.explode(F.array("_ya", F.col("_ya") + 1)))
    b = parts.select(*alike, *[F.col(c).alias(f"{c}b") for c in ("_y", "_x", "_p")])
    at, to = F.struct("_ya", "_xa", "_pa"), F.struct("_yb", "_xb", "_pb")
    around = F.abs(F.col("_xa") - F.col("_xb"))
    gap = F.greatest(F.least(around, int(360 / _WIDE) - around) - 1, F.lit(0)) * _WIDE
    low = [F.cos(F.radians(F.least(F.greatest(F.abs(F.col(y)), F.abs(F.col(y) + 1)) * step, F.lit(90.0)))) for y in ("_ya", "_yb")]
    most = np.sin(min(max_km / (2 * EARTH_RADIUS_M / 1e3), np.pi / 2)) ** 2 + 1e-9
    pairs = a.join(b, [*alike, "_yb"]).where((low[0] * low[1] * F.sin(F.radians(gap) / 2) ** 2 <= most) & ((at < to) | ((at == to) & (F.col("_rows") > 1))))
    ends = [F.struct(F.lit(k).alias("_side"), *[F.col(f"{c}{e}").alias(c) for c in ("_y", "_x", "_p")]) for k, e in enumerate("ab")]
    both = pairs.withColumn("_e", F.explode(F.when(at == to, F.array(ends[0])).otherwise(F.array(*ends))))
    return both.select(*alike, "_ya", "_xa", "_pa", "_yb", "_xb", "_pb", "_e.*")


def _losers(table: pa.Table, min_corr: float, max_km: float, min_overlap: int, identical: bool) -> pa.Table:
    """``pid, other, m``: records of two parts (or within one) that lose against another.

    With ``min_overlap`` common times the other is not told (``other`` is
    ``pid``); with fewer it is, where one of the two is listed more than once.
    """
    pid, side = table.column("pid").combine_chunks(), table.column("_side").to_numpy()
    order = np.unique(np.array(pid.to_pylist()), return_inverse=True)[1]
    lat, lon = (np.radians(table.column(c).to_numpy()) for c in ("lat", "lon"))
    n, f, k = (table.column(c).to_numpy() for c in ("n", "_f", "_k"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    if not identical:
        x, t = table.column("x").combine_chunks(), table.column("t").combine_chunks()
        start, codes = x.offsets.to_numpy() - x.offsets[0].as_py(), t.flatten().dictionary_encode()
        wide, when, value = len(codes.dictionary), codes.indices.to_numpy(), x.flatten().to_numpy()

    def dense(rows: np.ndarray) -> list[np.ndarray]:
        """Number, sum and sum of squares of each record's values, centred and scaled, at each time."""
        out = [np.zeros((len(rows), wide)) for _ in range(3)]
        for r, i in enumerate(rows):
            at, v = when[start[i] : start[i + 1]], value[start[i] : start[i + 1]]
            v = v - v.mean()
            v /= np.sqrt((v * v).mean()) or 1.0
            for m, w in zip(out, (1.0, v, v * v), strict=True):
                np.add.at(m[r], at, w)
        return out

    def direct(i: int, j: int) -> float:
        a, b = slice(start[i], start[i + 1]), slice(start[j], start[j + 1])
        p, q = np.nonzero(when[a][:, None] == when[b])
        u, v = value[a][p], value[b][q]
        if np.ptp(u) == 0 or np.ptp(v) == 0:
            return np.nan
        u, v = u - u.mean(), v - v.mean()
        return (u @ v) / np.sqrt((u @ u) * (v @ v))

    lost, weak = np.zeros(len(side), bool), []
    tiles = [[r[c : c + _TILE] for c in range(0, len(r), _TILE)] for r in (left, right)]
    for ka, a in enumerate(tiles[0]):
        da = None if identical else dense(a)
        for b in tiles[1][ka if right is left else 0 :]:
            hit = order[a][:, None] != order[b]
            if a[0] == b[0]:
                hit &= np.arange(len(a))[:, None] < np.arange(len(b))
            if not identical:
                (wa, sa, qa), (wb, sb, qb) = da, (da if a[0] == b[0] else dense(b))
                m = wa @ wb.T
                with np.errstate(all="ignore"):
                    su, sv, uu, vv = sa @ wb.T, wa @ sb.T, qa @ wb.T, wa @ qb.T
                    vu, vw = uu - su * su / m, vv - sv * sv / m
                    r = (sa @ sb.T - su * sv / m) / np.sqrt(vu * vw)
                    hit &= m >= np.where(k[a][:, None] * k[b] > 1, 2, max(min_overlap, 2))
                    # What products leave in doubt is worked out from the values.
                    doubt = hit & ~((np.abs(r - min_corr) > 1e-6) & (vu > 1e-7 * uu) & (vw > 1e-7 * vv))
                    for p, q in zip(*np.nonzero(doubt), strict=True):
                        r[p, q] = direct(a[p], b[q])
                    hit &= r > min_corr
            p, q = np.nonzero(hit)
            i, j = a[p], b[q]
            h = np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[j] - lon[i]) / 2) ** 2
            near = 2 * EARTH_RADIUS_M / 1e3 * np.arcsin(np.sqrt(np.minimum(h, 1))) <= max_km
            p, q, i, j = p[near], q[near], i[near], j[near]
            first = order[i] < order[j]
            i, j = np.where(first, i, j), np.where(first, j, i)
            loser = np.where((n[i] > n[j]) | ((n[i] == n[j]) & (f[i] == 1)), j, i)
            sure = np.ones(len(i), bool) if identical else m[p, q] >= min_overlap
            lost[loser[sure]] = True
            weak += [(int(c), int(d), int(e)) for c, d, e in zip(loser[~sure], (i + j - loser)[~sure], () if identical else m[p, q][~sure])]
    rows = np.flatnonzero(lost)
    gone, other = (pa.array(np.concatenate([rows, [w[c] for w in weak]]).astype(np.int64)) for c in (0, 1))
    count = np.concatenate([np.full(len(rows), min_overlap), [w[2] for w in weak]]).astype(np.int64)
    return pa.table({"pid": pid.take(gone), "other": pid.take(other), "m": pa.array(count)})


def dedupe(sites: DataFrame, obs: DataFrame, **options) -> DataFrame:
    return sites.join(duplicates(sites, obs, **options), "pid", "left_anti")


def at_step(sites: DataFrame, obs: DataFrame, year: int, season: int) -> DataFrame:
    """Observations of one assimilation step: a season's for seasonal records, the year's for annual ones."""
    own = ((F.col("dt") < 0.5) & (F.col("year") == year) & (F.col("season") == season)) | ((F.col("dt") >= 0.5) & (F.col("year") == year))
    return obs.join(sites.select("pid", "dt"), "pid").where(own & F.col("value").isNotNull()).select("pid", "year", "season", "value")


def drawn(key: Column, seed: int) -> Column:
    """A number that depends on key and seed alone: rows in its order are a random draw that anything with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_sites(sites: DataFrame, fraction: float, seed_offset: int = 0) -> DataFrame:
    """``sites`` with ``assimilated``: a share of the records, drawn by a hash of their ids."""
    pids = sites.select("pid").distinct()
    # The records whose hash is among the first: one border, found by a sort, decides for each row apart.
    keep = int(pids.count() * fraction)
    h = drawn(F.col("pid"), 544_502 + seed_offset)
    border = pids.select(h.alias("h")).orderBy("h").limit(keep).agg(F.max("h")).first()[0]
    return sites.withColumn("assimilated", (h <= border) if border is not None else F.lit(False))


def subsample(members: DataFrame, size: int, seed_offset: int = 0, ens: str = "ens") -> DataFrame:
    """The rows of ``size`` members, drawn without replacement by a hash of their number."""
    some = members.select(ens).distinct().orderBy(drawn(F.col(ens), 42_324_235 + seed_offset)).limit(size)
    return members.join(F.broadcast(some), ens, "left_semi")  # ``size`` numbers


# -- linear observation models ----------------------------------------------


def calibrate(pairs: DataFrame, by: list[str], order: list[str], x: str = "x", y: str = "value") -> DataFrame:
    """Least squares of ``y`` on ``x`` with its diagnostics, for each group.

    One aggregation for the fit, one for the lag-1 autocorrelation of the
    residuals; both work on the same partitions.
    """
    has = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*by)
    rows = has.select(*by, *order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = rows.withColumns({"_s": F.regr_slope(F.col("_y"), F.col("_x")).over(w), "_i": F.regr_intercept(F.col("_y"), F.col("_x")).over(w)})
    rows = rows.withColumn("_e", F.col("_y") - F.col("_i") - F.col("_s") * F.col("_x"))
    rows = rows.withColumn("_p", F.lag("_e").over(w.orderBy(*order)))
    n = F.col("n")
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("_s").alias("slope"), F.first("_i").alias("intercept"), F.sum(F.col("_e") ** 2).alias("ss_res"),
        (F.var_pop("_y") * F.count("_y")).alias("ss_tot"), F.stddev_pop(F.col("_i") + F.col("_s") * F.col("_x")).alias("_fit"), F.stddev_pop("_e").alias("_err"), F.sum(F.col("_e") * F.col("_p")).alias("_c"),
    )
    g = g.where(F.col("slope").isNotNull() & (n > 2))
    r2 = 1 - F.try_divide(F.col("ss_res"), F.col("ss_tot"))
    g = g.withColumn("r2", r2)
    return g.select(
        *by, "n", "slope", "intercept",
        F.sqrt(F.col("ss_res") / n).alias("err_std"),
        F.try_divide(F.col("_fit"), F.col("_err")).alias("snr"), "r2",
        (1 - (1 - F.col("r2")) * (n - 1) / (n - 2)).alias("r2adj"),
        (n * F.log(F.col("ss_res") / n) + 3 * F.log(n)).alias("bic"),
        (6 - 2 * F.log(F.col("ss_res"))).alias("aic"),
        (F.signum("slope") * F.sqrt(F.greatest(F.col("r2"), F.lit(0.0)))).alias("corr"),
        F.try_divide(F.col("_c") / (n - 1), F.col("_err") * F.col("_err")).alias("acor"),
    )


def passing(models: DataFrame, min_overlap: int = MIN_OVERLAP, min_corr: float = MIN_CORR, max_acor: float = MAX_ACOR) -> DataFrame:
    return models.where((F.col("n") >= min_overlap) & (F.abs("corr") >= min_corr) & (F.abs("acor") <= max_acor))


def best(models: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The model with the smallest BIC, the first candidate on ties."""
    w = Window.partitionBy(*by).orderBy(F.round("bic", 9), *order)
    return models.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def candidate_fields(sites: DataFrame) -> DataFrame:
    """``pid, field, candidate``: air temperature, for marine records the sea's too."""
    marine = reduce(lambda a, b: a | b, [F.col("ptype").startswith(p) for p in MARINE])
    fields = F.when(marine, F.array(F.lit("tas"), F.lit("tos"))).otherwise(F.array(F.lit("tas")))
    return sites.select("pid", F.posexplode(fields).alias("candidate", "field"))


def calibrate_seasonal(sites: DataFrame, obs: DataFrame, cells: DataFrame, nearest: DataFrame, **gates) -> DataFrame:
    """A model for each record and season: candidate fields at the nearest cell with data, gates, smallest BIC.

    ``cells(field, lat, lon, year, season, value)``; ``nearest(pid, field, lat, lon)``.
    """
    at = candidate_fields(sites).join(nearest, ["pid", "field"])
    truth = at.join(cells.withColumnRenamed("value", "x"), ["field", "lat", "lon"])
    pairs = truth.join(obs, ["pid", "year", "season"])
    models = calibrate(pairs, ["pid", "season", "field", "candidate", "lat", "lon"], ["year"])
    return best(passing(models, **gates), ["pid", "season"], ["candidate"])


def seasonality_means(cells: DataFrame, seasonalities=None, by: tuple[str, ...] = ("field", "lat", "lon")) -> DataFrame:
    """``seasonality, <by>, year, value``: what ``annualize`` gives for each list of seasons, from one aggregation.

    A season may belong to several lists, so rows are multiplied by the small
    table of memberships; the first and last year of a list go where not all of
    its seasons are there.
    """
    rows = []
    for k, q in enumerate(SEASONALITIES if seasonalities is None else seasonalities):
        before, _ = ta.split_seasonality(list(q))
        rows += [(k, int(s), int(s in before), len(q)) for s in q]
    member = cells.sparkSession.createDataFrame(rows, "seasonality int, season int, _shift int, _size int")
    # A few rows for each list of seasons.
    each = cells.join(F.broadcast(member), "season").withColumn("_y", (F.col("year") + F.col("_shift")).cast("int"))
    years = each.select("seasonality", "_size", "_y", "season").distinct().groupBy("seasonality", "_size", "_y").agg(F.count(F.lit(1)).alias("_n"))
    ends = years.groupBy("seasonality").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    drop = years.join(ends, "seasonality").where((F.col("_n") < F.col("_size")) & ((F.col("_y") == F.col("_lo")) | (F.col("_y") == F.col("_hi")))).select("seasonality", "_y")
    # At most two rows for each list of seasons.
    return each.join(F.broadcast(drop), ["seasonality", "_y"], "left_anti").groupBy("seasonality", *by, F.col("_y").alias("year")).agg(F.avg("value").alias("value"))


def calibrate_annual(sites: DataFrame, obs: DataFrame, cells: DataFrame, nearest: DataFrame, seasonalities=None, **gates) -> DataFrame:
    """A model for each annual record: candidate fields and seasonalities, gates, smallest BIC.

    All seasonalities are computed as one table, so the records are joined once.
    """
    at = candidate_fields(sites).join(nearest, ["pid", "field"])
    means = seasonality_means(cells, seasonalities)
    pairs = at.join(means.withColumnRenamed("value", "x"), ["field", "lat", "lon"]).join(obs, ["pid", "year"])
    models = calibrate(pairs, ["pid", "field", "candidate", "seasonality", "lat", "lon"], ["year"])
    return best(passing(models, **gates), ["pid"], ["candidate", "seasonality"])


def forward(models: DataFrame, truth: DataFrame, on: list[str], x: str = "x") -> DataFrame:
    """``estimated = intercept + slope x``."""
    return truth.join(models, on).withColumn("estimated", F.col("intercept") + F.col("slope") * F.col(x))


def identity_models(sites: DataFrame, error_std: float) -> DataFrame:
    return sites.select("pid", F.lit(0.0).alias("intercept"), F.lit(1.0).alias("slope"), F.lit(error_std).alias("err_std"))


def noise(pid: Column, *step: Column, seed: int) -> Column:
    """Standard normal number that depends on the row's key and seed alone (Box-Muller on two hashes)."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), pid, *step), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(F.lit(2 * np.pi) * unit(1))


def pseudo_obs(truth: DataFrame, std: Column, seed: int = 48_761_555, keys: tuple[str, ...] = ("year", "season"), x: str = "x") -> DataFrame:
    """Truth at sites plus reproducible noise of the given standard deviation."""
    return truth.withColumn("value", F.col(x) + std * noise(F.col("pid"), *[F.col(k) for k in keys], seed=seed))


def pseudo_obs_from_models(truth: DataFrame, models: DataFrame, on: list[str], snr_scale: float = 1.0, seed: int = 52_565_641) -> DataFrame:
    """Model of the truth plus noise of ``std(model) / snr / snr_scale`` for each record."""
    est = forward(models, truth, on)
    std = F.stddev_pop("estimated").over(Window.partitionBy(*on))
    return est.withColumn("value", F.col("estimated") + std / F.col("snr") / snr_scale * noise(F.col("pid"), F.col("year"), seed=seed))


def pseudo_network(sites_obs: DataFrame, seasonal: DataFrame | None, annual: DataFrame | None, cells: DataFrame, seasonalities=None, snr_scale: float = 1.0, seed: int = 52_565_641) -> tuple[DataFrame, DataFrame]:
    """Pseudo-records of a real network, with its seasonality, gaps and signal-to-noise ratios, from a known truth.

    ``sites_obs(pid, year[, season], value)``: where a record has a value, its
    pseudo-record has one (if the truth has).  ``seasonal`` models are
    ``pid, season, field, lat, lon, slope, intercept, snr``, a model for each
    season of a record; ``annual`` models have ``seasonality`` (a number in
    ``seasonalities``) in place of the season, and see the truth averaged over
    its seasons.  ``cells(field, lat, lon, year, season, value)`` is the truth.

    Returns ``pid, year, season (null for annual records), estimated,
    noise_std, value`` and the models under the pseudo-records' names: the
    models of the network are those of its copy.  The noise is that of the
    model: the standard deviation of its estimates (of each season apart) over
    its ``snr`` and over ``snr_scale``, drawn by record, year and season.
    """
    out, kept = None, None
    name = F.concat(F.lit("pseudo_"), F.col("pid").cast("string"))
    obs = sites_obs.where(F.col("value").isNotNull())
    for models, step in ((seasonal, "season"), (annual, "seasonality")):
        if models is None:
            continue
        m = models.select("pid", step, "field", "lat", "lon", "slope", "intercept", "snr")
        if step == "season":
            truth, times = cells.withColumnRenamed("value", "x"), obs.select("pid", "year", "season").distinct()
        else:
            truth, times = seasonality_means(cells, seasonalities).withColumnRenamed("value", "x"), obs.select("pid", "year").distinct()
        seen = m.join(truth, ["field", "lat", "lon", step]).where(F.col("x").isNotNull())
        seen = seen.join(times, ["pid", "year", *(["season"] if step == "season" else [])], "left_semi")
        own = seen.withColumn("estimated", F.col("intercept") + F.col("slope") * F.col("x"))
        group = ["pid", "season"] if step == "season" else ["pid"]
        std = own.groupBy(*group).agg(F.stddev_pop("estimated").alias("_std"))
        own = own.join(std, group).withColumn("noise_std", F.col("_std") / F.col("snr") / snr_scale)
        season = F.col("season").cast("int") if step == "season" else F.lit(None).cast("int")
        at = F.coalesce(season, F.lit(-1))
        rows = own.select(name.alias("pid"), "year", season.alias("season"), "estimated", "noise_std", (F.col("estimated") + F.col("noise_std") * noise(F.col("pid"), F.col("year"), at, seed=seed)).alias("value"))
        names = m.withColumn("pid", name)
        out, kept = (rows, names) if out is None else (out.unionByName(rows), kept.unionByName(names, allowMissingColumns=True))
    if out is None:
        raise ValueError("a network needs seasonal or annual models")
    # A model without any pseudo-observation is left out.
    return out, kept.join(out.select("pid").distinct(), "pid", "left_semi")


def verification(models: DataFrame, estimates: DataFrame, obs: DataFrame, on: list[str], time: list[str]) -> DataFrame:
    """``pid, time, true, estimated``: models of the ensemble mean next to what was observed."""
    est = forward(models, estimates, on)
    return est.join(obs.withColumnRenamed("value", "true"), ["pid", *time]).select("pid", *time, "true", "estimated")
