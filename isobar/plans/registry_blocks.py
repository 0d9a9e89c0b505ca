"""Queries of the block operators: filters over rows of any number, resumable cycles, large EOFs, Zarr stores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_RADIUS_M
from ..operators import curvilinear, enkf_blocks, eof_large, linear, resample, spatial, verification
from ..operators.lim import Lim
from ..sources import storage, zarr
from . import cycle
from . import views as v
from .registry import query

# -- Zarr -----------------------------------------------------------------------


@query("SELECT field, year, month, lat, lon, r{value} AS value FROM cells WHERE field = 'tos' AND year BETWEEN 1996 AND 1998 AND lat >= 0")
def source_zarr(s, d):
    """A year and a part of the globe of one field; other chunks are not opened."""
    path = storage.shared_folder(s)
    zarr.save_zarr(v.cells(s, d), path, {"time": 12, "lat": 2, "lon": 3}, double=True)
    return zarr.load_zarr(s, path, ["tos"], (1996, 1998), lat=(0, 90))


@query("SELECT field, ens, year, month, lat, lon, r{value::FLOAT::DOUBLE} AS value FROM cells_ens")
def sink_zarr(s, d):
    """Members in chunks of their own, values as floats."""
    path = storage.shared_folder(s)
    zarr.save_zarr(v.cells_ens(s, d), path, {"time": 24, "ens": 1})
    return zarr.load_zarr(s, path).select("field", "ens", "year", "month", "lat", "lon", "value")


# -- filters --------------------------------------------------------------------

_KM = 2 * EARTH_RADIUS_M / 1e3
_RADIUS = 12_000.0


def _sequence(observations: list[tuple], radius: float) -> dict[str, str]:
    """Views ``f0, f1, ...``: the state after each observation ``(lat, lon, slope, intercept, obs, err)``, one after the other."""
    views = {"f0": "SELECT lat, lon, year, month, ens, value AS x FROM cells_ens SEMI JOIN (SELECT lat, lon, year, month FROM cells_ens GROUP BY ALL HAVING count(value) = 5) USING (lat, lon, year, month)"}
    for k, (lat, lon, slope, intercept, obs, err) in enumerate(observations):
        z = f"({_KM!r} * asin(sqrt(least(1e0, power(sin(radians({lat}e0 - lat) / 2), 2) + cos(radians({lat}e0)) * cos(radians(lat)) * power(sin(radians(lon - {lon}e0) / 2), 2)))) / {radius / 2!r})"
        loc = "CASE WHEN z <= 1 THEN 1 + z * z * (-5e0 / 3 + z * (5e0 / 8 + z * (0.5e0 - z / 4))) WHEN z <= 2 THEN 4 - 5 * z + z * z * (5e0 / 3 + z * (5e0 / 8 + z * (-0.5e0 + z / 12))) - 2e0 / (3 * z) ELSE 0 END"
        views[f"y{k}"] = f"SELECT year, month, ens, {intercept} + {slope} * x AS y FROM f{k} WHERE lat = {lat} AND lon = {lon}"
        views[f"s{k}"] = f"SELECT year, month, avg(y) AS ym, var_samp(y) + {err * err!r} AS iv FROM y{k} GROUP BY 1, 2"
        views[f"g{k}"] = f"SELECT lat, lon, year, month, {loc} * c / iv AS g FROM (SELECT *, {z} AS z FROM (SELECT lat, lon, year, month, covar_samp(x, y) AS c FROM f{k} JOIN y{k} USING (year, month, ens) GROUP BY ALL)) JOIN s{k} USING (year, month)"
        views[f"f{k + 1}"] = f"SELECT lat, lon, year, month, ens, x + coalesce(g * ({obs}e0 - ym) - g / (1 + sqrt({err * err!r} / iv)) * (y - ym), 0) AS x FROM f{k} LEFT JOIN y{k} USING (year, month, ens) LEFT JOIN s{k} USING (year, month) LEFT JOIN g{k} USING (lat, lon, year, month)"
    return views


#: Latitude, longitude, slope, intercept, value and error of three observations.
_OBSERVATIONS = [(0, 154, 1.0, 0.0, 1.1, 0.3), (30, 82, 0.5, 0.2, 0.7, 0.2), (-30, 226, 2.0, -1.0, 1.3, 0.4)]


def _month_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows with all members."""
    return enkf_blocks.ensemble_rows(v.cells_ens(s, d).where("value is not null"), ["lat", "lon", "year", "month"]).where(F.size("x") == 5)


@query("SELECT lat, lon, year, month, ens, r{x} AS value FROM f3 WHERE year = 1997 AND month = 5", **_sequence(_OBSERVATIONS, _RADIUS))
def enkf_blocks_localized(s, d):
    """A month's state after three observations in a row, localised."""
    rows = _month_rows(s, d).where("year = 1997 and month = 5")
    return enkf_blocks.long_rows(_assimilated(s, rows, _RADIUS), ["lat", "lon", "year", "month"])


@query("SELECT year, month, r{avg(x)} AS mean, r{sum(x * x)} AS squares, count(*) AS n FROM f3 WHERE year = 2000 AND month = 2 GROUP BY 1, 2", **_sequence(_OBSERVATIONS, 1e9))
def enkf_blocks_global(s, d):
    """Without localisation the sequence is one linear map of every row."""
    rows = _month_rows(s, d).where("year = 2000 and month = 2")
    return enkf_blocks.long_rows(_assimilated(s, rows, None), ["year", "month"]).groupBy("year", "month").agg(F.avg("value").alias("mean"), F.sum(F.col("value") ** 2).alias("squares"), F.count(F.lit(1)).alias("n"))


def _assimilated(s: SparkSession, rows: DataFrame, radius: float | None) -> DataFrame:
    models = s.createDataFrame([(k, float(a), float(o), slope, icept, obs, err, [0]) for k, (a, o, slope, icept, obs, err) in enumerate(_OBSERVATIONS)], "k bigint, lat double, lon double, slope double, intercept double, obs double, err_std double, times array<int>")
    # An observation where the cell has gaps is not assimilated.
    seen = models.join(rows.select("lat", "lon"), ["lat", "lon"], "left_semi")
    places = rows.withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"}).withColumns({"lat": F.col("cell_lat"), "lon": F.col("cell_lon")})
    keyed = seen.withColumns({"cell_lat": F.col("lat"), "cell_lon": F.col("lon")})
    return enkf_blocks.assimilate_blocks(places, keyed, ["cell_lat", "cell_lon"], 5, radius_km=radius).drop("cell_lat", "cell_lon")


# -- a cycle --------------------------------------------------------------------


@query()
def reconstruction_blocks(s, d):
    """A localised cycle over all seasons from 1996 on in rows of blocks, stopped half way and resumed; posterior means."""
    season = v.seasonal(s, d).where("field = 'tos' and year >= 1996")
    whole = linear.nan_mask(season, ["lat", "lon"])
    change = whole.join(whole.groupBy("lat", "lon", "season").agg(F.avg("value").alias("m")), ["lat", "lon", "season"]).select("lat", "lon", "year", "season", (F.col("value") - F.col("m")).alias("x"))
    fit = linear.eof_fit(change, ["lat", "lon"], ["year", "season"], 4)
    at = {p: k for k, p in enumerate(fit.states)}
    space = s.createDataFrame([(k, *p, u.tolist(), u.tolist()) for (p, k), u in zip(at.items(), fit.u, strict=True)], "key bigint, lat double, lon double, f array<double>, b array<double>")
    obs = change.join(space.select("key", "lat", "lon"), ["lat", "lon"])
    step = ((F.col("year") - 1996) * 4 + F.col("season")).cast("int")
    due = obs.where("key % 3 = 0").select(step.alias("step"), F.col("key").alias("k"), "key", F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), F.col("x").alias("obs"), F.lit(0.2).alias("err_std"), F.array(F.lit(0)).alias("back"), "lat", "lon")
    spread = fit.s / math.sqrt(fit.samples)
    model = Lim(0.25, np.eye(4) * 0.6, np.eye(4) * (4 * math.log(0.6)) + 0j, 2 * -4 * math.log(0.6) * spread**2, np.eye(4), 1.0)
    members = 8
    start = fit.u @ (spread[:, None] * np.random.default_rng(562_151).normal(size=(4, members)))
    initial = s.createDataFrame([(k, r.tolist()) for k, r in enumerate(start)], "key bigint, x array<double>")
    steps = due.agg(F.max("step")).first()[0] + 1
    path = storage.shared_folder(s)
    for part in (steps // 2, steps):
        run = cycle.PhysicalCycle(s, path, space, due, model, members, radius_km=_RADIUS)
        run.run(part, initial)
    mean = F.aggregate("x", F.lit(0.0), lambda a, y: a + y) / members
    return run.posterior().join(space.select("key", "lat", "lon"), "key").select("step", "lat", "lon", mean.alias("posterior"))


# -- curvilinear grids ------------------------------------------------------------

#: North pole of the rotated source grid.
_POLE = (50.0, 20.0)


def _rotation() -> dict[str, str]:
    """Views: the rotated cells, their quadrilaterals, and the place of every target in every one of them."""
    p, q = (math.radians(x) for x in _POLE)
    xyz = "cos(radians({0})) * cos(radians({1})) AS {2}1, cos(radians({0})) * sin(radians({1})) AS {2}2, sin(radians({0})) AS {2}3".format
    corner = {"p": "a", "q": "b", "s": "c", "r": "d"}
    front = ", ".join(f"{k}1 * n1 + {k}2 * n2 + {k}3 * n3 AS {k}f" for k in "abcd")
    flat = ", ".join(f"({k}2 * cos(o) - {k}1 * sin(o)) / nullif({k}f, 0) AS {k}u, ({k}3 * cos(l) - {k}1 * sin(l) * cos(o) - {k}2 * sin(l) * sin(o)) / nullif({k}f, 0) AS {k}v" for k in "abcd")
    place = lambda n: f"-((au + t{n} * cu) * (bu + t{n} * du) + (av + t{n} * cv) * (bv + t{n} * dv)) / nullif(power(bu + t{n} * du, 2) + power(bv + t{n} * dv, 2), 0) AS s{n}"
    here = lambda n: f"coalesce(least(s{n}, t{n}) >= -1e-9 AND greatest(s{n}, t{n}) <= 1 + 1e-9 AND disc >= 0 AND least(af, bf, cf, df) > 1e-6, FALSE)"
    return {
        "gx": f"SELECT cell, lat, lon, {xyz('lat', 'lon', 'g')} FROM grid",
        "gr": f"SELECT cell % 5 AS i, cell // 5 AS j, lat AS lat0, lon AS lon0, degrees(asin(least(1e0, greatest(-1e0, {-math.cos(p)!r} * g1 + {math.sin(p)!r} * g3)))) AS lat, ((degrees(atan2({math.sin(q)!r} * ({math.sin(p)!r} * g1 + {math.cos(p)!r} * g3) + {math.cos(q)!r} * g2, {math.cos(q)!r} * ({math.sin(p)!r} * g1 + {math.cos(p)!r} * g3) - {math.sin(q)!r} * g2)) % 360) + 360) % 360 AS lon FROM gx",
        "quad": "SELECT p.i AS i, p.j AS j, " + ", ".join(f"{t}.lat0 AS {k}lat0, {t}.lon0 AS {k}lon0, " + xyz(f"{t}.lat", f"{t}.lon", k) for t, k in corner.items()) + " FROM gr p JOIN gr q ON q.i = (p.i + 1) % 5 AND q.j = p.j JOIN gr s ON s.i = q.i AND s.j = p.j + 1 JOIN gr r ON r.i = p.i AND r.j = p.j + 1",
        "tg": f"SELECT (m // 9 * 20 - 80)::DOUBLE AS to_lat, (m % 9 * 40 + 20)::DOUBLE AS to_lon, radians(to_lat) AS l, radians(to_lon) AS o, {xyz('to_lat', 'to_lon', 'n')} FROM range(81) x(m)",
        "h1": f"SELECT *, {front} FROM tg CROSS JOIN quad",
        "h2": f"SELECT *, {flat} FROM h1",
        "h3": "SELECT * EXCLUDE (bu, bv, cu, cv, du, dv), bu - au AS bu, bv - av AS bv, du - au AS cu, dv - av AS cv, au - bu - du + cu AS du, av - bv - dv + cv AS dv FROM h2",
        "h4": "SELECT *, cu * dv - cv * du AS k2, au * dv - av * du + cu * bv - cv * bu AS k1, au * bv - av * bu AS k0, k1 * k1 - 4 * k2 * k0 AS disc, -(k1 + CASE WHEN k1 < 0 THEN -1 ELSE 1 END * sqrt(greatest(disc, 0))) / 2 AS q FROM h3",
        "h5": f"SELECT *, k0 / nullif(q, 0) AS t1, q / nullif(k2, 0) AS t2, {place(1)}, {place(2)} FROM h4",
        "h6": f"SELECT *, least(1, greatest(0, CASE WHEN {here(1)} THEN s1 ELSE s2 END)) AS s, least(1, greatest(0, CASE WHEN {here(1)} THEN t1 ELSE t2 END)) AS t FROM h5 WHERE {here(1)} OR {here(2)} QUALIFY row_number() OVER (PARTITION BY to_lat, to_lon ORDER BY j, i) = 1",
        "cw": " UNION ALL ".join(f"SELECT {k}lat0 AS lat, {k}lon0 AS lon, to_lat, to_lon, {w} AS w FROM h6" for k, w in (("a", "(1 - s) * (1 - t)"), ("b", "s * (1 - t)"), ("c", "s * t"), ("d", "(1 - s) * t"))),
    }


@query(
    "SELECT field, year, season, to_lat AS lat, to_lon AS lon, r{CASE WHEN 1 - coalesce(sum(CASE WHEN value IS NOT NULL THEN w END), 0) / sum(w) <= 0.75e0 THEN sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END) END} AS value FROM seas JOIN cw USING (lat, lon) WHERE w > 1e-12 GROUP BY 1, 2, 3, 4, 5",
    **_rotation(),
)
def regrid_curvilinear(s, d):
    """The cells as points of a rotated grid, on a regular one."""
    cells = v.grid(s)
    lat, lon = curvilinear.rotated(F.col("lat"), F.col("lon"), *_POLE)
    grid = cells.select((F.col("cell") % 5).cast("long").alias("i"), F.floor(F.col("cell") / 5).cast("long").alias("j"), lat.alias("lat"), lon.alias("lon"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    weights = curvilinear.curvilinear_weights(grid.select("i", "j", "lat", "lon"), spatial.regular_grid(s, -90, 90, 20, 0, 360, 40))
    place = storage.written(grid.select("lat", "lon", "lat0", "lon0"))
    field = v.seasonal(s, d).withColumnsRenamed({"lat": "lat0", "lon": "lon0"}).join(F.broadcast(place), ["lat0", "lon0"])  # 25 cells
    return spatial.regrid(field, weights, ["field", "year", "season"])


# -- fields that grow with the tables ---------------------------------------------

_FINE = {
    "fine": "SELECT 'tas' AS field, ((c_custkey % 360) * 0.5e0 - 89.75e0) AS lat, (((c_custkey // 360) % 720) * 0.5e0 + 0.25e0) AS lon, (year(o_orderdate) + (month(o_orderdate) = 12)::INT)::INT AS year, (month(o_orderdate) % 12 // 3)::INT AS season, avg(o_totalprice) / 99991e0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "coarse": "SELECT *, floor(lat / 5) * 5 + 2.5e0 AS to_lat, floor(lon / 5) * 5 + 2.5e0 AS to_lon, sin(radians(lat + 0.25e0)) - sin(radians(lat - 0.25e0)) AS w FROM fine",
}


def _fine(s: SparkSession, d: str) -> DataFrame:
    """A cell of half a degree for every customer (259,200 before they share), its orders by season."""
    o = v.read(s, d, "orders").join(v.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, m, y = F.col("c_custkey"), F.month("o_orderdate"), F.year("o_orderdate")
    cell = o.select(F.lit("tas").alias("field"), ((k % 360) * 0.5 - 89.75).alias("lat"), ((F.floor(k / 360) % 720) * 0.5 + 0.25).alias("lon"), (y + (m == 12).cast("int")).alias("year"), F.floor((m % 12) / 3).cast("int").alias("season"), "o_totalprice")
    return cell.groupBy("field", "lat", "lon", "year", "season").agg((F.avg("o_totalprice") / 99991.0).alias("value"))


@query("SELECT field, year, season, to_lat AS lat, to_lon AS lon, r{sum(w * value) / sum(w)} AS value FROM coarse GROUP BY ALL", **_FINE)
def regrid_conservative_fine(s, d):
    """From half a degree to five degrees."""
    x = _fine(s, d)
    weights = spatial.conservative_weights(x.select("lat", "lon"), spatial.regular_grid(s, -90, 90, 5, 0, 360, 5), 0.5, 0.5, 5, 5)
    return spatial.regrid(x, weights, ["field", "year", "season"])


@query(
    "SELECT r{sum(c.c * p.c) * any_value(total) / any_value(n)} AS first, r{any_value(total) / any_value(n)} AS retained FROM gc c JOIN c14 p USING (i, j) CROSS JOIN (SELECT sum(CASE WHEN i = j THEN c END) AS total FROM gram) CROSS JOIN (SELECT count(DISTINCT year * 4 + season) - 1 AS n FROM fine)",
    **_FINE,
    change="SELECT lat, lon, year * 4 + season AS k, value - avg(value) OVER (PARTITION BY lat, lon, season) AS x FROM fine",
    gram="SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS c FROM change a JOIN change b USING (lat, lon) GROUP BY 1, 2",
    gc="SELECT i, j, c / sum(CASE WHEN i = j THEN c END) OVER () AS c FROM gram",
    **{f"c{k + 1}": f"SELECT i, j, c / sum(CASE WHEN i = j THEN c END) OVER () AS c FROM (SELECT a.i AS i, b.j AS j, sum(a.c * b.c) AS c FROM {f'c{k}' if k else 'gc'} a JOIN {f'c{k}' if k else 'gc'} b ON a.j = b.i GROUP BY 1, 2)" for k in range(14)},
)
def eof_large_fine(s, d):
    """Variance of the first mode of the anomalies of all cells, and of all modes; gaps count as 0."""
    x = resample.anomalize(_fine(s, d), "season").select("lat", "lon", "year", "season", F.col("value").alias("x"))
    n = x.select("year", "season").distinct().count()
    fit = eof_large.eof_fit_large(x, ["lat", "lon"], ["year", "season"], 2, oversample=n, tolerance=1e-12)
    whole = x.agg((F.sum(F.col("x") * F.col("x")) / (n - 1)).alias("retained"))
    return whole.select(F.lit(float(fit.variance[0])).alias("first"), "retained")


# -- EOF ------------------------------------------------------------------------


def _powers(times: int) -> dict[str, str]:
    """Views ``c0`` (covariance of the state) and ``c1, ...``: each the square of the one before, over its trace."""
    views = {"c0": "SELECT i, j, c / sum(CASE WHEN i = j THEN c END) OVER () AS c FROM (SELECT a.state_idx AS i, b.state_idx AS j, sum(a.x * b.x) AS c FROM sm a JOIN sm b USING (sample_idx) GROUP BY 1, 2)"}
    for k in range(times):
        views[f"c{k + 1}"] = f"SELECT i, j, c / sum(CASE WHEN i = j THEN c END) OVER () AS c FROM (SELECT a.i AS i, b.j AS j, sum(a.c * b.c) AS c FROM c{k} a JOIN c{k} b ON a.j = b.i GROUP BY 1, 2)"
    return views


_LOADINGS = "SELECT i AS state_idx, r{c} AS loading FROM c14 WHERE i = j"


@query(_LOADINGS, **_powers(14))
def eof_first_mode(s, d):
    """Squared loadings of the first mode: a high power of the covariance is the mode's outer product."""
    fit = linear.eof_fit(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], 3)
    return s.createDataFrame([(i, float(u * u)) for (i,), u in zip(fit.states, fit.u[:, 0], strict=True)], "state_idx int, loading double")


@query(_LOADINGS, **_powers(14))
def eof_large_first_mode(s, d):
    """The same from a random frame, with modes that stay on executors."""
    fit = eof_large.eof_fit_large(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], 3, oversample=40, tolerance=1e-14)
    return fit.modes.select("state_idx", (F.col("u")[0] * F.col("u")[0]).alias("loading"))


# -- verification of forecasts --------------------------------------------------

#: Damping a year of an element of the state, substeps of a quarter, steps ahead.
_DAMPING, _SUBSTEPS, _AHEAD = "(0.5e0 + state_idx / 32e0)", 90, 4


@query(
    "SELECT lead, state_idx, r{sqrt(avg(power(mean - x, 2)))} AS rmse, r{sqrt(avg(variance))} AS spread, count(*) AS cases FROM fc JOIN sm USING (state_idx) WHERE sm.sample_idx = fc.case_idx + lead GROUP BY 1, 2",
    whole=f"SELECT a.sample_idx AS case_idx FROM (SELECT DISTINCT sample_idx FROM sm) a JOIN (SELECT DISTINCT sample_idx FROM sm) b ON b.sample_idx BETWEEN a.sample_idx AND a.sample_idx + {_AHEAD} GROUP BY 1 HAVING count(*) = {_AHEAD + 1}",
    fc=f"SELECT case_idx, lead::INT AS lead, state_idx, x * CASE WHEN lead = 0 THEN 1 ELSE power(1 - {_DAMPING} * {0.25 / _SUBSTEPS!r}, lead * {_SUBSTEPS}) * (1 - {_DAMPING} * {0.25 / _SUBSTEPS / 2!r}) END AS mean, 0e0 AS variance FROM sm JOIN whole ON case_idx = sample_idx CROSS JOIN range({_AHEAD + 1}) l(lead)",
)
def verification_without_noise(s, d):
    """Forecasts of a damped state from every start; without noise all members are the damped start."""
    model = _damped(np.zeros(64))
    x = v.state_matrix(s, d)
    return verification.state_scores(model, x, "sample_idx", _AHEAD, 2, _SUBSTEPS, state="state_idx")


@query()
def verification_stochastic(s, d):
    """The same with noise that keeps the variance of the state, 50 members a start."""
    x = v.state_matrix(s, d)
    var = {r["state_idx"]: r["v"] for r in x.groupBy("state_idx").agg(F.var_pop("x").alias("v")).collect()}
    rate = 0.5 + np.arange(64) / 32
    model = _damped(2 * rate * np.array([var[k] for k in range(64)]))
    return verification.state_scores(model, x, "sample_idx", _AHEAD, 50, _SUBSTEPS, state="state_idx")


def _damped(noise: np.ndarray) -> Lim:
    rate = 0.5 + np.arange(64) / 32
    return Lim(0.25, np.diag(np.exp(-0.25 * rate)), np.diag(-rate).astype(complex), noise, np.eye(64), 1.0)
