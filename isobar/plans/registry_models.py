"""Queries on site records and on linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeaxis as ta
from ..operators import enkf, lim, linear, proxies, reduce, resample, spatial
from ..operators.mapper import Mapper
from . import assimilate, postprocess
from . import views as v
from .registry import _anom, query

# -- site records -----------------------------------------------------------


@query("SELECT pid, year, season, r{value} AS value FROM site_obs")
def proxy_seasonal(s, d):
    return v.site_obs(s, d)


@query("SELECT pid, d::INT AS year, r{avg(value)} AS value FROM samples GROUP BY 1, 2")
def proxy_annual(s, d):
    return proxies.annual(v.samples(s, d))


@query("SELECT pid, dt, CASE WHEN dt < 0.24e0 THEN 'subseasonal' WHEN dt <= 0.26e0 THEN 'seasonal' WHEN dt BETWEEN 0.99e0 AND 1.01e0 THEN 'annual' END AS \"group\" FROM sites")
def proxies_by_resolution(s, d):
    return proxies.by_resolution(v.sites(s, d)).select("pid", "dt", "group")


_TWIN_S = "SELECT * FROM sites UNION ALL SELECT pid + 100000, ptype, dt, lat + 1, lon FROM sites WHERE pid % 5 = 0"
_TWIN_O = "SELECT * FROM site_obs UNION ALL SELECT pid + 100000, year, season, 2 * value + 1 FROM site_obs WHERE pid % 5 = 0 AND (year % 7 > 0 OR pid % 2 = 0)"
_KM = "2 * 6371.0088e0 * asin(sqrt(least(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2, 1)))"


def _twins(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    st, ob = v.sites(s, d), v.site_obs(s, d)
    twin = st.where("pid % 5 = 0").withColumn("pid", F.col("pid") + 100_000).withColumn("lat", F.col("lat") + 1)
    copy = ob.where("pid % 5 = 0 and (year % 7 > 0 or pid % 2 = 0)").withColumn("pid", F.col("pid") + 100_000).withColumn("value", 2 * F.col("value") + 1)
    return st.unionByName(twin), ob.unionByName(copy)


@query(
    "SELECT pid, ptype, dt, r{lat} AS lat, r{lon} AS lon FROM ts WHERE pid NOT IN (SELECT CASE WHEN na > nb THEN q ELSE p END FROM (SELECT a.pid AS p, b.pid AS q, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m, corr(x.value, y.value) AS r FROM cnt a JOIN cnt b ON a.ptype = b.ptype AND a.dt = b.dt AND a.pid < b.pid JOIN tob x ON x.pid = a.pid JOIN tob y ON y.pid = b.pid AND y.year = x.year AND y.season = x.season WHERE "
    + _KM
    + " <= 1000 GROUP BY 1, 2) WHERE m >= 10 AND r > 0.999e0)",
    ts=_TWIN_S,
    tob=_TWIN_O,
    cnt="SELECT ts.*, n FROM ts JOIN (SELECT pid, count(*) AS n FROM tob GROUP BY 1) USING (pid)",
)
def dedupe_proxies(s, d):
    st, ob = _twins(s, d)
    return proxies.dedupe(st, ob).select("pid", "ptype", "dt", "lat", "lon")


@query("SELECT o.pid, o.year, o.season, r{value} AS value FROM site_obs o JOIN sites USING (pid) WHERE (dt < 0.5e0 AND year = 12 AND season = 2) OR (dt >= 0.5e0 AND year = 12)")
def proxies_at_step(s, d):
    return proxies.at_step(v.sites(s, d), v.site_obs(s, d), 12, 2)


# -- observation models -----------------------------------------------------

_OWN = "(pid % 25 // 5 * 30 - 60)::DOUBLE AS lat, (pid % 5 * 72 + 10)::DOUBLE AS lon"
_PAIRS = f"SELECT o.pid, o.year, o.season, o.value AS y, c.value AS x FROM (SELECT *, {_OWN} FROM site_obs) o JOIN site_cells c ON c.lat = o.lat AND c.lon = o.lon AND c.year = o.year AND c.season = o.season WHERE c.field = 'tas'"


def _calibrated(keys: str, order: str, source: str) -> str:
    """SQL of a least-squares fit with its diagnostics, for each ``keys``."""
    return f"""SELECT {keys}, count(*) AS n, any_value(b) AS slope, any_value(a) AS intercept, sqrt(sum(e * e) / count(*)) AS err_std, stddev_pop(a + b * x) / nullif(stddev_pop(e), 0) AS snr,
    1 - sum(e * e) / nullif(var_pop(y) * count(*), 0) AS r2, count(*) * ln(sum(e * e) / count(*)) + 3 * ln(count(*)) AS bic, 6 - 2 * ln(sum(e * e)) AS aic, sum(e * p) / (count(*) - 1) / nullif(var_pop(e), 0) AS acor
    FROM (SELECT *, lag(e) OVER (PARTITION BY {keys} ORDER BY {order}) AS p FROM (SELECT *, y - a - b * x AS e FROM (SELECT *, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, count(*) OVER w AS m, var_pop(x) OVER w AS vx FROM {source} WINDOW w AS (PARTITION BY {keys})) WHERE m > 2 AND vx > 0)) GROUP BY {keys}"""


_SHOW = "n, r{slope} AS slope, r{intercept} AS intercept, r{err_std} AS err_std, r{snr} AS snr, r{r2} AS r2, r{1 - (1 - r2) * (n - 1) / (n - 2)} AS r2adj, r{bic} AS bic, r{aic} AS aic, r{sign(slope) * sqrt(greatest(r2, 0))} AS corr, r{acor} AS acor"
_GATE = "n >= {n} AND sqrt(greatest(r2, 0)) >= 0.05e0 AND abs(acor) <= 0.9e0"


def _nearest(s: SparkSession, d: str) -> DataFrame:
    """Nearest cell with data for each record and field."""
    cells, out = v.site_cells(s, d), None
    for f in ("tas", "tos"):
        n = spatial.nearest_gridpoint_with_data(v.sites(s, d), cells.where(F.col("field") == f)).select("pid", F.lit(f).alias("field"), F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"))
        out = n if out is None else out.unionByName(n)
    return out


def _pairs(s: SparkSession, d: str) -> DataFrame:
    at = _nearest(s, d).where("field = 'tas'")
    truth = at.join(v.site_cells(s, d).withColumnRenamed("value", "x"), ["field", "lat", "lon"])
    return truth.join(v.site_obs(s, d), ["pid", "year", "season"])


@query(f"SELECT pid, {_SHOW} FROM cal", pairs=_PAIRS, cal=_calibrated("pid", "year, season", "pairs"))
def psm_calibrate(s, d):
    return proxies.calibrate(_pairs(s, d), ["pid"], ["year", "season"])


_CANDS = f"SELECT o.pid, o.year, o.season, o.value AS y, c.value AS x, c.field, (c.field = 'tos')::INT AS candidate FROM (SELECT *, {_OWN} FROM site_obs) o JOIN site_cells c ON c.lat = o.lat AND c.lon = o.lon AND c.year = o.year AND c.season = o.season WHERE c.field = 'tas' OR pid % 3 = 0"


@query(
    f"SELECT pid, season, field, {_SHOW} FROM (SELECT *, row_number() OVER (PARTITION BY pid, season ORDER BY round(bic, 9), candidate) AS k FROM cal WHERE {_GATE.format(n=8)}) WHERE k = 1",
    pairs=_CANDS,
    cal=_calibrated("pid, season, field, candidate", "year", "pairs"),
)
def psm_calibrate_seasonal(s, d):
    return proxies.calibrate_seasonal(v.sites(s, d), v.site_obs(s, d), v.site_cells(s, d), _nearest(s, d), min_overlap=8).drop("candidate", "lat", "lon")


def _means_sql() -> str:
    parts = []
    for k, seasons in enumerate(proxies.SEASONALITIES):
        before, _ = ta.split_seasonality(list(seasons))
        label = f"year + (season IN ({', '.join(map(str, before))}))::INT" if before else "year"
        x = f"(SELECT *, {label} AS y FROM site_cells WHERE season IN ({', '.join(map(str, seasons))}))"
        parts.append(f"SELECT {k} AS seasonality, field, lat, lon, y::INT AS year, avg(value) AS x FROM {x} WHERE y NOT IN (SELECT y FROM {x} GROUP BY 1 HAVING count(DISTINCT season) < {len(seasons)} AND (y = (SELECT min(y) FROM {x}) OR y = (SELECT max(y) FROM {x}))) GROUP BY 1, 2, 3, 4, 5")
    return " UNION ALL ".join(parts)


@query(
    f"SELECT pid, field, seasonality::INT AS seasonality, {_SHOW} FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(bic, 9), candidate, seasonality) AS k FROM cal WHERE {_GATE.format(n=25)}) WHERE k = 1",
    means=_means_sql(),
    ann=f"SELECT pid, d::INT AS year, avg(value) AS y, {_OWN} FROM samples GROUP BY 1, 2",
    pairs="SELECT a.pid, a.year, a.y, m.x, m.field, m.seasonality, (m.field = 'tos')::INT AS candidate FROM ann a JOIN means m USING (lat, lon, year) WHERE m.field = 'tas' OR a.pid % 3 = 0",
    cal=_calibrated("pid, field, candidate, seasonality", "year", "pairs"),
)
def psm_calibrate_annual(s, d):
    return proxies.calibrate_annual(v.sites(s, d), proxies.annual(v.samples(s, d)), v.site_cells(s, d), _nearest(s, d)).drop("candidate", "lat", "lon")


@query(f"SELECT pid, season, field, r{{bic}} AS bic FROM (SELECT *, row_number() OVER (PARTITION BY pid, season ORDER BY round(bic, 9), candidate) AS k FROM cal) WHERE k = 1", pairs=_CANDS, cal=_calibrated("pid, season, field, candidate", "year", "pairs"))
def psm_select_bic(s, d):
    at = proxies.candidate_fields(v.sites(s, d)).join(_nearest(s, d), ["pid", "field"])
    pairs = at.join(v.site_cells(s, d).withColumnRenamed("value", "x"), ["field", "lat", "lon"]).join(v.site_obs(s, d), ["pid", "year", "season"])
    return proxies.best(proxies.calibrate(pairs, ["pid", "season", "field", "candidate"], ["year"]), ["pid", "season"], ["candidate"]).select("pid", "season", "field", "bic")


@query("SELECT p.pid, p.year, p.season, r{intercept + slope * x} AS estimated FROM pairs p JOIN cal USING (pid)", pairs=_PAIRS, cal=_calibrated("pid", "year, season", "pairs"))
def psm_forward(s, d):
    p = _pairs(s, d)
    return proxies.forward(proxies.calibrate(p, ["pid"], ["year", "season"]), p.select("pid", "year", "season", "x"), ["pid"]).select("pid", "year", "season", "estimated")


@query('SELECT p.pid, p.year, p.season, r{y} AS "true", r{intercept + slope * x} AS estimated FROM pairs p JOIN cal USING (pid)', pairs=_PAIRS, cal=_calibrated("pid", "year, season", "pairs"))
def verification_proxies(s, d):
    p = _pairs(s, d)
    models = proxies.calibrate(p, ["pid"], ["year", "season"])
    return proxies.verification(models, p.select("pid", "year", "season", "x"), v.site_obs(s, d), ["pid"], ["year", "season"])


@query("SELECT pid, row_number() OVER (ORDER BY md5('544502:' || pid)) <= floor(0.8e0 * count(*) OVER ()) AS assimilated FROM sites")
def split_proxies(s, d):
    return proxies.split_sites(v.sites(s, d), 0.8).select("pid", "assimilated")


@query()
def pseudo_obs(s, d):
    return proxies.pseudo_obs(_pairs(s, d).select("pid", "year", "season", "x"), F.lit(0.1))


@query()
def pseudo_obs_from_models(s, d):
    p = _pairs(s, d)
    models = proxies.calibrate(p, ["pid"], ["year", "season"]).select("pid", "slope", "intercept", "snr")
    return proxies.pseudo_obs_from_models(p.select("pid", "year", "season", "x"), models, ["pid"]).select("pid", "year", "season", "value")


_SEASON_MODELS = f"SELECT pid, season, field, lat, lon, slope, intercept, snr FROM (SELECT *, row_number() OVER (PARTITION BY pid, season ORDER BY round(bic, 9), candidate) AS k FROM scal WHERE {_GATE.format(n=8)}) WHERE k = 1"
_YEAR_MODELS = f"SELECT pid, seasonality, field, lat, lon, slope, intercept, snr FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(bic, 9), candidate, seasonality) AS k FROM acal WHERE {_GATE.format(n=25)}) WHERE k = 1"


@query(
    "SELECT 'pseudo_' || pid AS pid, year, season, r{estimated} AS estimated, r{noise_std} AS noise_std FROM (SELECT *, stddev_pop(estimated) OVER (PARTITION BY pid, season) / snr / 2 AS noise_std FROM (SELECT m.pid, c.year, c.season, intercept + slope * c.value AS estimated, snr FROM smod m JOIN site_cells c USING (field, lat, lon, season) SEMI JOIN sobs o ON o.pid = m.pid AND o.year = c.year AND o.season = c.season)) UNION ALL SELECT 'pseudo_' || pid, year, -1, r{estimated}, r{noise_std} FROM (SELECT *, stddev_pop(estimated) OVER (PARTITION BY pid) / snr / 2 AS noise_std FROM (SELECT m.pid, c.year, intercept + slope * c.x AS estimated, snr FROM amod m JOIN means c USING (field, lat, lon, seasonality) SEMI JOIN aobs o ON o.pid = m.pid AND o.year = c.year))",
    sobs="SELECT * FROM site_obs WHERE pid % 2 = 1 AND value IS NOT NULL",
    aobs=f"SELECT pid, d::INT AS year, avg(value) AS y, {_OWN} FROM samples WHERE pid % 2 = 0 GROUP BY 1, 2",
    means=_means_sql(),
    spairs=f"SELECT o.pid, o.year, o.season, o.value AS y, c.value AS x, c.field, c.lat, c.lon, (c.field = 'tos')::INT AS candidate FROM (SELECT *, {_OWN} FROM sobs) o JOIN site_cells c ON c.lat = o.lat AND c.lon = o.lon AND c.year = o.year AND c.season = o.season WHERE c.field = 'tas' OR pid % 3 = 0",
    scal=_calibrated("pid, season, field, candidate, lat, lon", "year", "spairs"),
    smod=_SEASON_MODELS,
    apairs="SELECT a.pid, a.year, a.y, m.x, m.field, m.seasonality, lat, lon, (m.field = 'tos')::INT AS candidate FROM aobs a JOIN means m USING (lat, lon, year) WHERE m.field = 'tas' OR a.pid % 3 = 0",
    acal=_calibrated("pid, field, candidate, seasonality, lat, lon", "year", "apairs"),
    amod=_YEAR_MODELS,
)
def pseudo_obs_network(s, d):
    """A network of seasonal (odd) and annual (even) records copied with its seasonality; the noise is left to its tests."""
    sites, cells, near = v.sites(s, d), v.site_cells(s, d), _nearest(s, d)
    odd = v.site_obs(s, d).where("pid % 2 = 1")
    even = proxies.annual(v.samples(s, d).where("pid % 2 = 0"))
    seasonal = proxies.calibrate_seasonal(sites, odd, cells, near, min_overlap=8)
    annual = proxies.calibrate_annual(sites, even, cells, near)
    obs = odd.select("pid", "year", "season", "value").unionByName(even.select("pid", "year", F.lit(None).cast("int").alias("season"), "value"))
    rows, _ = proxies.pseudo_network(obs, seasonal, annual, cells, snr_scale=2.0)
    return rows.select("pid", "year", F.coalesce("season", F.lit(-1)).alias("season"), "estimated", "noise_std")


@query()
def pseudo_obs_lattice(s, d):
    sites = spatial.lattice(s, 20.0, 30.0, 2)
    at = spatial.nearest_gridpoint_with_data(sites, v.tos(s, d)).select("pid", F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"))
    truth = at.join(v.seasonal(s, d).where("field = 'tos'").withColumnRenamed("value", "x"), ["lat", "lon"])
    return proxies.pseudo_obs(truth, F.lit(0.2)).select("pid", "year", "season", "value")


# -- matrices ---------------------------------------------------------------


@query("SELECT state_idx, count(*) AS n, r{arg_min(x, sample_idx)} AS first, r{arg_max(x, sample_idx)} AS last, r{sum(x * k) / 1000} AS moment FROM (SELECT *, row_number() OVER (PARTITION BY state_idx ORDER BY sample_idx) AS k FROM sm) GROUP BY 1")
def stack_state(s, d):
    st = linear.stack_state(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], "x")
    moment = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return st.select("state_idx", F.size("values").cast("bigint").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"), (moment / 1000).alias("moment"))


@query("SELECT field, lat, lon, year, month, r{value} AS value FROM (SELECT *, count(value) OVER w AS n, count(*) OVER w AS m FROM cells WINDOW w AS (PARTITION BY field, lat, lon)) WHERE n = m")
def nan_mask(s, d):
    return linear.nan_mask(v.cells(s, d), ["field", "lat", "lon"])


@query("SELECT a.state_idx AS i, b.state_idx AS j, r{sum(a.x * b.x) / (count(*) - 1)} AS c0, r{sum(c.x * b.x) / (count(*) - 1)} AS ct FROM sm b JOIN sm a ON a.sample_idx = b.sample_idx JOIN sm c ON c.sample_idx = b.sample_idx + 1 AND c.state_idx = a.state_idx GROUP BY 1, 2")
def lag_covariance(s, d):
    return linear.lag_covariance(v.state_matrix(s, d), "state_idx", "sample_idx")


_EST = "SELECT sample_idx, sum(CASE state_idx WHEN 0 THEN x WHEN 1 THEN 0.5e0 * x ELSE 0 END) AS y FROM sm GROUP BY 1"
_UPD = "SELECT state_idx, sample_idx, r{x + g * (0.3e0 - ym) - g / (1 + sqrt(0.49e0 / iv)) * (y - ym)} AS value FROM (SELECT *, {loc} * covar_samp(x, y) OVER (PARTITION BY state_idx) / iv AS g FROM sm JOIN es USING (sample_idx) CROSS JOIN (SELECT avg(y) AS ym, var_samp(y) + 0.49e0 AS iv FROM es))"


def _update(s, d, loc=None):
    m = v.state_matrix(s, d).withColumnRenamed("x", "value")
    i = F.col("state_idx")
    est = m.where("state_idx < 2").groupBy("sample_idx").agg(F.sum(F.when(i == 0, F.col("value")).otherwise(0.5 * F.col("value"))).alias("y"))
    return enkf.update(m, est, 0.3, 0.7, ["state_idx"], "sample_idx", localization=loc)


@query(_UPD.replace("{loc}", "1e0"), es=_EST)
def enkf_single_update(s, d):
    return _update(s, d)


@query(_UPD.replace("{loc}", "1 / (1 + state_idx / 10e0)"), es=_EST)
def enkf_localized_update(s, d):
    return _update(s, d, s.range(64).select(F.col("id").cast("int").alias("state_idx"), (1 / (1 + F.col("id") / 10)).alias("loc")))


@query("SELECT sample_idx, m::INT AS mode, r{sum(x * cos(pi() * (state_idx + 0.5e0) * m / 64))} AS score FROM sm CROSS JOIN range(5) r(m) GROUP BY 1, 2")
def eof_project(s, d):
    i = F.col("id").cast("int")
    modes = s.range(64).select(i.alias("state_idx"), F.array(*[F.cos(F.lit(np.pi) * (i + 0.5) * m / 64) for m in range(5)]).alias("u"))
    return linear.project(v.state_matrix(s, d), modes, ["state_idx"], ["sample_idx"])


@query("SELECT r{sum(v)} AS total_variance, count(*) AS modes FROM (SELECT var_samp(x) AS v FROM sm GROUP BY state_idx)")
def eof_total_variance(s, d):
    """All modes together hold the total variance (the data have zero mean)."""
    fit = linear.eof_fit(v.state_matrix(s, d), ["state_idx"], ["sample_idx"])
    return s.createDataFrame([(float(fit.variance.sum()), len(fit.s))], "total_variance double, modes long")


@query()
def eof_variance(s, d):
    fit = linear.eof_fit(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], 10, with_dof=True)
    return s.createDataFrame([(k, *map(float, r)) for k, r in enumerate(zip(fit.variance, fit.fraction, fit.fraction_error, strict=True))], "mode int, variance double, fraction double, error double")


@query()
def eof_rotated(s, d):
    fit = linear.rotate(linear.eof_fit(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], 6, with_dof=True))
    return fit.table(s)


@query("SELECT state_idx, sample_idx, r{x} AS x FROM sm")
def eof_reconstruct(s, d):
    """With all modes, what was projected comes back."""
    m = v.state_matrix(s, d)
    fit = linear.eof_fit(m, ["state_idx"], ["sample_idx"])
    modes = linear.basis(s, fit).withColumn("state_idx", F.col("state_idx").cast("int"))
    return linear.reconstruct(linear.project(m, modes, ["state_idx"], ["sample_idx"]), modes, ["state_idx"], ["sample_idx"])


_TIME = ["year", "season"]


def _mapper(s: SparkSession, d: str, **options) -> tuple[Mapper, DataFrame]:
    # Fitting reads the fields several times: kept on executors, recomputed if one is lost.
    cells = resample.anomalize(v.seasonal(s, d), "season").persist()
    return Mapper(k=4, l=4, **options).fit(cells, _TIME), cells


@query()
def mapper_forward(s, d):
    m, cells = _mapper(s, d)
    return m.forward(linear.nan_mask(cells, ["field", "lat", "lon"]), _TIME)


@query()
def mapper_roundtrip(s, d):
    m, cells = _mapper(s, d, k_direct={"tos": 5}, separate_mean=True)
    return m.backward(m.forward(linear.nan_mask(cells, ["field", "lat", "lon"]), _TIME), _TIME)


@query()
def mapper_roundtrip_by_season(s, d):
    m, cells = _mapper(s, d, by_season=True)
    return m.backward(m.forward(linear.nan_mask(cells, ["field", "lat", "lon"]), _TIME), _TIME)


@query()
def truncate_dataset(s, d):
    m, cells = _mapper(s, d)
    return m.truncate(cells, _TIME)


def _lim(s: SparkSession, d: str) -> lim.Lim:
    """Fitted on the whole state; dynamics that grow are an error."""
    return lim.fit(v.state_matrix(s, d), "state_idx", "sample_idx", 0.25)


@query()
def lim_fit(s, d):
    m = _lim(s, d)
    n = len(m.g)
    return s.createDataFrame([(i, j, float(m.g[i, j]), float(m.l[i, j].real), float(m.l[i, j].imag)) for i in range(n) for j in range(n)], "i int, j int, g double, l_re double, l_im double")


@query()
def lim_forecast(s, d):
    m = _lim(s, d)
    f = m.forecast(np.ones(len(m.g)), 4)
    return s.createDataFrame([(i, k, float(f[i, k])) for i in range(len(f)) for k in range(5)], "state int, step int, x double")


@query()
def lim_forecast_stochastic(s, d):
    m = _lim(s, d)
    f = m.simulate(np.ones((len(m.g), 20)), 4, int(assimilate.STEPS_PER_YEAR * m.tau), np.random.default_rng(1))
    return s.createDataFrame([(i, k, float(f[i, :, k].mean()), float(f[i, :, k].std())) for i in range(len(f)) for k in range(5)], "state int, step int, mean double, std double")


@query()
def forecast_verification(s, d):
    """Deterministic forecasts from every start against what followed, over the whole state."""
    return lim.verify(_lim(s, d), v.state_matrix(s, d), "state_idx", "sample_idx", 4)


def _averaged(at: str, weights: dict[int, float], obs: float, error: float, before: str) -> dict[str, str]:
    """SQL of one observation of the mean over the steps ``at``: views of the mean, the estimate and the updated members."""
    seen = " + ".join(f"{w}e0 * sum(CASE state WHEN {i} THEN m END)" for i, w in weights.items())
    r = error**2
    return {
        f"{before}_m": f"SELECT state, ens, avg(x) AS m FROM {before} WHERE step IN ({at}) GROUP BY 1, 2",
        f"{before}_y": f"SELECT ens, {seen} AS y FROM {before}_m GROUP BY 1",
        f"{before}_s": f"SELECT avg(y) AS ym, var_samp(y) + {r!r}::DOUBLE AS iv FROM {before}_y",
        f"{before}_k": f"SELECT state, covar_samp(m, y) AS k FROM {before}_m JOIN {before}_y USING (ens) GROUP BY 1",
        f"{before}_d": f"SELECT state, ens, k / iv * ({obs}e0 - ym - (y - ym) / (1 + sqrt({r!r}::DOUBLE / iv))) AS move FROM {before}_k CROSS JOIN {before}_y CROSS JOIN {before}_s",
        f"{before}_new": f"SELECT state, ens, step, x + CASE WHEN step IN ({at}) THEN move ELSE 0 END AS x FROM {before} JOIN {before}_d USING (state, ens)",
    }


@query(
    "SELECT state, ens, step, r{x} AS x FROM tx_new_new",
    tx="SELECT state_idx AS state, sample_idx // 4 AS ens, (sample_idx % 4)::INT AS step, x FROM sm WHERE sample_idx // 4 IN (SELECT sample_idx // 4 FROM sm GROUP BY 1 HAVING count(DISTINCT sample_idx) = 4)",
    **_averaged("0, 1, 2, 3", {0: 1.0}, 0.5, 0.3, "tx"),
    **_averaged("3", {1: 1.0, 2: 1.0}, -0.2, 0.4, "tx_new"),
)
def enkf_time_average(s, d):
    """Four samples in a row are the time steps of a member; a last member without all of them has no estimates and stays out."""
    m = v.state_matrix(s, d).groupBy(F.col("state_idx").alias("state"), F.floor(F.col("sample_idx") / 4).alias("ens"))
    x = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "x"))), lambda a: a["x"]).alias("x")).where(F.size("x") == 4)
    post = enkf.update_time_average(x, [0.5, -0.2], [{0: 1.0}, {1: 1.0, 2: 1.0}], [0.3, 0.4], [[0, 1, 2, 3], [3]], 4)
    return post.select("state", "ens", F.posexplode("x").alias("step", "x"))


@query()
def initial_ensemble(s, d):
    m, cells = _mapper(s, d)
    x = assimilate.initial_from_sample(m.forward(linear.nan_mask(cells, ["field", "lat", "lon"]), _TIME), 4)
    return s.createDataFrame([(i, e, float(x[i, e])) for i in range(x.shape[0]) for e in range(x.shape[1])], "state int, ens int, x double")


def _cycle(s: SparkSession, d: str) -> tuple[Mapper, DataFrame, DataFrame]:
    m, cells = _mapper(s, d)
    complete = linear.nan_mask(cells, ["field", "lat", "lon"])
    reduced = m.forward(complete, _TIME)
    steps = reduced.withColumn("k", (F.col("year") * 4 + F.col("season")).cast("bigint")).select("k", "state", "x")
    model = lim.fit(steps, "state", "k", 0.25)
    rows = m.backward_matrix(s).where("field = 'tos'").select("lat", "lon", F.col("u").alias("row"))
    sites = v.grid(s).select(F.col("cell").cast("bigint").alias("pid"), "lat", "lon")
    truth = complete.where("field = 'tos'").join(sites, ["lat", "lon"]).withColumnRenamed("value", "x")
    obs = proxies.pseudo_obs(truth, F.lit(0.1)).select("pid", "year", "season", "value")
    models = proxies.identity_models(sites.join(rows, ["lat", "lon"]).select("pid", "row"), 0.1).join(sites.join(rows, ["lat", "lon"]).select("pid", "row"), "pid")
    seasonal = models.withColumn("season", F.explode(F.array(*[F.lit(q) for q in range(4)])))
    due = assimilate.schedule(obs, seasonal, None, 1996, 1998)
    x0 = assimilate.initial_from_sample(reduced, 6)
    post = assimilate.reconstruct(due, 3, x0, model, 1996, 1998, fraction=0.8)
    return m, post, obs


@query()
def reconstruction_cycle(s, d):
    return _cycle(s, d)[1].groupBy("iteration", "year", "season", "state").agg(F.avg("prior").alias("prior"), F.avg("posterior").alias("posterior"), F.var_samp("posterior").alias("variance"))


@query()
def collate_mc(s, d):
    post = _cycle(s, d)[1].select("iteration", "year", "season", "state", "ens", F.col("posterior").alias("x"))
    return postprocess.collate(post, [0, 2, 5], 3)


@query()
def postprocess_all(s, d):
    m, post, _ = _cycle(s, d)
    reduced = postprocess.collate(post.select("iteration", "year", "season", "state", "ens", F.col("posterior").alias("x")), [0, 2, 5], 3)
    cells = postprocess.physical(reduced, m, ["ens", *_TIME])
    out = postprocess.products(cells, (1996, 1999))
    return out["statistics"]


@query("SELECT field, year, season, region, r{avg(value)} AS mean FROM (SELECT field, year, season, lat, 'north' AS region, value FROM anom WHERE lat > 0 UNION ALL SELECT field, year, season, lat, 'south', value FROM anom WHERE lat < 0) GROUP BY 1, 2, 3, 4")
def postprocess_hemispheres(s, d):
    h = reduce.hemisphere_split(_anom(s, d)).select("field", "year", "season", F.explode(F.create_map(F.lit("north"), F.col("north"), F.lit("south"), F.col("south"))).alias("region", "v"))
    return h.where("v is not null or region is not null").groupBy("field", "year", "season", "region").agg(F.avg("v").alias("mean"))
