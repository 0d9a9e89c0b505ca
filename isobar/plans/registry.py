"""Every field-analytics query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import timeaxis as ta
from ..operators import indices, reduce, regress, resample, signal, spatial, vertical
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = ["field", "lat", "lon"]


def query(sql: str | None = None, **views: str) -> Callable:
    """Registers a query under its function's name; its doubles are rounded as the SQL's are."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = lambda s, d: v.rounded(fn(s, d))
        if sql:
            ORACLE_SQL[fn.__name__] = v.with_views(sql, views)
        return fn

    return add


def _anom(s: SparkSession, d: str) -> DataFrame:
    return resample.anomalize(v.seasonal(s, d), "season", period=(1996, 2000), t=ta.season_to_decimal(F.col("year"), F.col("season")))


_W = "cos(radians(lat))"


def _mean(where: str = "TRUE", w: str = _W, x: str = "value") -> str:
    return f"sum(CASE WHEN {where} THEN {w} * {x} END) / nullif(sum(CASE WHEN {where} AND {x} IS NOT NULL THEN {w} END), 0)"


# -- flagship ---------------------------------------------------------------


@query(
    f"SELECT field, year, season, 'global' AS region, r{{{_mean()}}} AS value FROM anom GROUP BY 1, 2, 3 UNION ALL SELECT field, year, season, 'nh', r{{{_mean('lat >= 0')}}} FROM anom GROUP BY 1, 2, 3 UNION ALL SELECT field, year, season, 'sh', r{{{_mean('lat <= 0')}}} FROM anom GROUP BY 1, 2, 3"
)
def regional_seasonal_anomalies(s, d):
    return reduce.regional_means(_anom(s, d), ["field", "year", "season"])


# -- time axis --------------------------------------------------------------

_T = "SELECT event_id, day(ts) + (hour(ts) * 60 + minute(ts)) / 1440e0 AS t FROM events"


def _times(s, d):
    return v.read(s, d, "events").select("event_id", (F.dayofmonth("ts") + (F.hour("ts") * 60 + F.minute("ts")) / 1440).alias("t"))


@query("SELECT event_id, CASE WHEN m IN (2, 5, 8, 11) THEN NULL WHEN m < 2 OR m > 11 THEN 0 WHEN m < 5 THEN 1 WHEN m < 8 THEN 2 ELSE 3 END::INT AS season, r{floor(t) + (CASE WHEN m < 2 OR m > 11 THEN 0 WHEN m < 5 THEN 1 WHEN m < 8 THEN 2 ELSE 3 END * 3 + 0.5e0) / 12} AS mid FROM (SELECT *, (t - floor(t)) * 12 AS m FROM tt)", tt=_T)
def decimal_to_season(s, d):
    return _times(s, d).withColumn("season", ta.decimal_to_season(F.col("t"))).select("event_id", "season", ta.season_to_decimal(F.floor("t"), F.coalesce("season", F.lit(3))).alias("mid"))


@query("SELECT event_id, (floor(t) + (m >= 11)::INT)::INT AS year, CASE WHEN m < 2 OR m >= 11 THEN 0 WHEN m < 5 THEN 1 WHEN m < 8 THEN 2 ELSE 3 END::INT AS season FROM (SELECT *, (t - floor(t)) * 12 AS m FROM tt)", tt=_T)
def round_to_season(s, d):
    y, q = ta.round_to_season(F.col("t"))
    return _times(s, d).select("event_id", y.alias("year"), q.alias("season"))


_TD = "SELECT o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 0.5e0) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END AS t FROM orders"


@query(
    "SELECT o_orderkey, strftime(make_date(y, 1, 1) + floor((t - y) * CASE WHEN y % 4 = 0 THEN 366 ELSE 365 END + 1e-9)::INT, '%Y-%m-%d') AS leap, lpad(y::VARCHAR, 4, '0') || strftime(DATE '2001-01-01' + floor((t - y) * 365 + 1e-9)::INT, '-%m-%d') AS noleap, (floor((t - y) * 12) + 1)::INT AS month FROM (SELECT *, floor(t)::INT AS y FROM td)", td=_TD
)
def decimal_to_date(s, d):
    o = F.col("o_orderdate")
    t = v.read(s, d, "orders").select("o_orderkey", (F.year(o) + (F.dayofyear(o) - 0.5) / F.when(F.year(o) % 4 == 0, 366).otherwise(365)).alias("t"))
    return t.select("o_orderkey", F.date_format(ta.decimal_to_date(F.col("t")), "yyyy-MM-dd").alias("leap"), ta.decimal_to_date(F.col("t"), False).alias("noleap"), ta.decimal_to_month(F.col("t")).alias("month"))


@query("SELECT o_orderkey, r{year(o_orderdate) + (month(o_orderdate) - 0.5e0) / 12} AS equal_months, r{year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366e0 ELSE 365e0 END} AS by_day FROM orders")
def date_to_decimal(s, d):
    o = F.col("o_orderdate")
    return v.read(s, d, "orders").select("o_orderkey", ta.date_to_decimal(o).alias("equal_months"), ta.date_to_decimal(o, False).alias("by_day"))


@query("SELECT DISTINCT year, season, lpad(year::VARCHAR, 4, '0') || '-' || ['DJF', 'MAM', 'JJA', 'SON'][season + 1] AS tuple, ['DJF', 'MAM', 'JJA', 'SON'][season + 1] || ' ' || lpad(year::VARCHAR, 4, '0') AS label, (year + 0.5e0) AS middle FROM seas")
def format_tuple_time(s, d):
    y, q = F.col("year"), F.col("season")
    t = v.seasonal(s, d).select("year", "season").distinct()
    return t.select("year", "season", ta.format_tuple(y, q).alias("tuple"), ta.format_tuple(y, q, False).alias("label"), ta.shift_to_year_middle(ta.season_to_decimal(y, q)).alias("middle"))


@query("SELECT field, r{quantile_cont(d, 0.5)} AS step, 'seasonal' AS resolution FROM (SELECT field, t - lag(t) OVER (PARTITION BY field ORDER BY t) AS d FROM (SELECT DISTINCT field, year + (season * 3 + 0.5e0) / 12 AS t FROM seas)) GROUP BY 1")
def time_resolution(s, d):
    return ta.time_resolution(v.seasonal(s, d).withColumn("t", ta.season_to_decimal(F.col("year"), F.col("season"))), "t", ["field"])


# -- resampling -------------------------------------------------------------


@query("SELECT field, lat, lon, year, season, r{value} AS value FROM seas")
def average_seasonally(s, d):
    return v.seasonal(s, d)


@query("SELECT field, lat, lon, year, season, r{avg(value)} AS value FROM seas0 WHERE (year, season) NOT IN (SELECT year, season FROM seas_drop) GROUP BY 1, 2, 3, 4, 5")
def average_seasonally_unweighted(s, d):
    return resample.average_seasonally(v.cells(s, d), weight_months=False)


def _annual_sql(year: str, weight: str = "day(last_day(make_date(year, month, 1)))") -> str:
    return f"""SELECT field, lat, lon, y::INT AS year, r{{avg(value * w) / avg(w)}} AS value FROM (SELECT *, {year} AS y, {weight} AS w, count(DISTINCT year * 12 + month) OVER (PARTITION BY {year}) AS n, min({year}) OVER () AS a, max({year}) OVER () AS z FROM cells) WHERE NOT (y = a OR y = z) OR n >= 12 GROUP BY 1, 2, 3, 4"""


@query(_annual_sql("year + (month = 12)::INT"))
def average_annually_monthly(s, d):
    return resample.average_annually_monthly(v.cells(s, d))


@query(_annual_sql("year - (month < 4)::INT"))
def average_annually_fiscal(s, d):
    return resample.average_annually_monthly(v.cells(s, d), first_month=4)


_AS = "SELECT *, [90.25e0, 92e0, 92e0, 91e0][season + 1] AS w FROM seas WHERE year NOT IN (SELECT year FROM seas GROUP BY 1 HAVING count(DISTINCT season) < 4 AND (year = (SELECT min(year) FROM seas) OR year = (SELECT max(year) FROM seas)))"


@query("SELECT field, lat, lon, year, r{avg(value * w) / avg(w)} AS value FROM x GROUP BY 1, 2, 3, 4", x=_AS)
def average_annually_seasonal(s, d):
    return resample.average_annually_seasonal(v.seasonal(s, d))


def _annualize(name: str, seasons: list[int]) -> None:
    before, own = ta.split_seasonality(seasons)
    label = f"year + (season IN ({', '.join(map(str, before))}))::INT" if before else "year"
    x = f"SELECT field, lat, lon, ({label})::INT AS y, season, value FROM seas WHERE season IN ({', '.join(map(str, seasons))})"
    sql = f"SELECT field, lat, lon, y AS year, r{{avg(value)}} AS value FROM x WHERE y NOT IN (SELECT y FROM x GROUP BY 1 HAVING count(DISTINCT season) < {len(seasons)} AND (y = (SELECT min(y) FROM x) OR y = (SELECT max(y) FROM x))) GROUP BY 1, 2, 3, 4"

    def fn(s, d):
        return resample.annualize(v.seasonal(s, d), seasons)

    fn.__name__ = name
    query(sql, x=x)(fn)


for _name, _seasons in {
    "annualize_annual": [0, 1, 2, 3], "annualize_son_jja": [3, 0, 1, 2], "annualize_jja_mam": [2, 3, 0, 1], "annualize_mam_djf": [1, 2, 3, 0], "annualize_jja": [2],
    "annualize_mam_jja": [1, 2], "annualize_jja_son": [2, 3], "annualize_djf": [0], "annualize_cross_year": [3, 0], "annualize_djf_mam": [0, 1],
}.items():
    _annualize(_name, _seasons)


@query("SELECT field, lat, lon, season, r{climatology} AS climatology FROM clim")
def climatology(s, d):
    return resample.climatology(v.seasonal(s, d), "season", period=(1996, 2000), t=ta.season_to_decimal(F.col("year"), F.col("season")))


@query("SELECT field, lat, lon, year, month, r{value - avg(value) OVER (PARTITION BY field, lat, lon, month)} AS value FROM cells")
def anomalize_monthly(s, d):
    return resample.anomalize(v.cells(s, d), "month")


@query("SELECT field, lat, lon, year, season, r{value - avg(value) OVER (PARTITION BY field, lat, lon, season)} AS value FROM seas")
def anomalize_seasonal(s, d):
    return resample.anomalize(v.seasonal(s, d), "season")


@query("SELECT field, lat, lon, year, r{value - avg(value) OVER (PARTITION BY field, lat, lon)} AS value FROM (SELECT field, lat, lon, year, avg(value * w) / avg(w) AS value FROM x GROUP BY 1, 2, 3, 4)", x=_AS)
def anomalize_annual(s, d):
    return resample.anomalize(resample.average_annually_seasonal(v.seasonal(s, d)), None)


@query("SELECT field, lat, lon, year, season, r{value} AS value FROM anom")
def anomalize_period(s, d):
    return _anom(s, d)


@query("SELECT field, ens, lat, lon, year, month, r{value - avg(value) OVER (PARTITION BY field, lat, lon, month)} AS value FROM cells_ens")
def anomalize_ensmean(s, d):
    return resample.anomalize(v.cells_ens(s, d), "month", ["field", "ens", "lat", "lon"], ensemble_mean="ens")


@query("SELECT event_type, strftime(date_trunc('month', day), '%Y-%m-%d') AS month_start, r{avg(x)} AS value FROM (SELECT event_type, ts::DATE AS day, avg(value) / 100 AS x FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def daily_to_monthly(s, d):
    days = v.read(s, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg((F.avg("value") / 100).alias("value"))
    return resample.daily_to_monthly(days, ["event_type"]).withColumn("month_start", F.date_format("month_start", "yyyy-MM-dd"))


# -- reductions -------------------------------------------------------------


@query(f"SELECT field, year, season, r{{{_mean()}}} AS value FROM seas GROUP BY 1, 2, 3")
def area_weighted_mean(s, d):
    return reduce.area_weighted_mean(v.seasonal(s, d), ["field", "year", "season"])


@query(f"SELECT field, year, season, r{{{_mean(w=_W + ' * ' + _W)}}} AS value FROM seas GROUP BY 1, 2, 3")
def area_weighted_mean_squared(s, d):
    return reduce.area_weighted_mean(v.seasonal(s, d), ["field", "year", "season"], squared=True)


@query("SELECT field, year, season, lat, r{avg(value)} AS value FROM seas GROUP BY 1, 2, 3, 4")
def zonal_mean(s, d):
    return reduce.plain_mean(v.seasonal(s, d), ["field", "year", "season", "lat"])


@query(f"SELECT field, year, season, lon, r{{{_mean()}}} AS value FROM seas GROUP BY 1, 2, 3, 4")
def meridional_mean(s, d):
    return reduce.area_weighted_mean(v.seasonal(s, d), ["field", "year", "season", "lon"])


@query(f"SELECT field, year, month, 'global' AS region, r{{{_mean()}}} AS value FROM cells GROUP BY 1, 2, 3 UNION ALL SELECT field, year, month, 'nh', r{{{_mean('lat >= 0')}}} FROM cells GROUP BY 1, 2, 3 UNION ALL SELECT field, year, month, 'sh', r{{{_mean('lat <= 0')}}} FROM cells GROUP BY 1, 2, 3")
def regional_means(s, d):
    return reduce.regional_means(v.cells(s, d), ["field", "year", "month"])


@query("SELECT field, lat, lon, year, month, r{CASE WHEN lat > 0 THEN value END} AS north, r{CASE WHEN lat < 0 THEN value END} AS south FROM cells")
def hemisphere_split(s, d):
    return reduce.hemisphere_split(v.cells(s, d)).drop("value")


_XY = "SELECT a.lat, a.lon, a.year, a.month, a.value AS x, b.value * 0.4e0 AS y FROM tas a JOIN tos b USING (lat, lon, year, month)"


def _xy(s, d):
    return v.tas(s, d).drop("field"), v.tos(s, d).drop("field").withColumn("value", F.col("value") * 0.4)


_KEYS = ["lat", "lon", "year", "month"]


@query("SELECT lat, lon, r{avg((x - y) ** 2)} AS mse FROM xy GROUP BY 1, 2", xy=_XY)
def mse(s, d):
    return reduce.errors(*_xy(s, d), _KEYS, ["lat", "lon"]).drop("rmse")


@query("SELECT lat, lon, r{sqrt(avg((x - y) ** 2))} AS rmse FROM xy GROUP BY 1, 2", xy=_XY)
def rmse(s, d):
    return reduce.errors(*_xy(s, d), _KEYS, ["lat", "lon"]).drop("mse")


@query(f"SELECT r{{mse}} AS mse, r{{sqrt(mse)}} AS rmse FROM (SELECT {_mean(x='e')} AS mse FROM (SELECT lat, lon, avg((x - y) ** 2) AS e FROM xy GROUP BY 1, 2))", xy=_XY)
def area_weighted_rmse(s, d):
    return reduce.area_weighted_errors(*_xy(s, d), _KEYS, [])


@query("SELECT lat, lon, r{1 - sum((y - x) ** 2) / nullif(sum((y - m) ** 2), 0)} AS ce FROM (SELECT *, avg(y) OVER (PARTITION BY lat, lon) AS m FROM xy) GROUP BY 1, 2", xy=_XY)
def coefficient_efficiency(s, d):
    return reduce.coefficient_of_efficiency(*_xy(s, d), _KEYS, ["lat", "lon"])


@query(f"SELECT field, r{{sqrt(sum({_W} * v))}} AS std FROM (SELECT field, lat, lon, var_samp(value) AS v FROM seas GROUP BY 1, 2, 3) GROUP BY 1")
def field_std(s, d):
    return reduce.field_std(v.seasonal(s, d), ["field"])


@query(f"SELECT field, season, r{{sqrt(sum({_W} * v))}} AS std FROM (SELECT field, season, lat, lon, var_samp(value) AS v FROM seas GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def field_std_by_season(s, d):
    return reduce.field_std(v.seasonal(s, d), ["field", "season"])


@query("SELECT year, month, lat, lon, r{avg(value)} AS mean, r{var_samp(value)} AS variance FROM cells_ens GROUP BY 1, 2, 3, 4")
def ensemble_stats(s, d):
    return reduce.ensemble_stats(v.cells_ens(s, d), ["year", "month", "lat", "lon"])


@query("SELECT year, month, lat, lon, r{quantile_cont(value, 0.05)} AS lower, r{quantile_cont(value, 0.95)} AS upper FROM cells_ens GROUP BY 1, 2, 3, 4")
def ensemble_quantiles(s, d):
    return reduce.ensemble_quantiles(v.cells_ens(s, d), ["year", "month", "lat", "lon"], 0.9)


@query(
    "SELECT year, month, lat, lon, r{arg_min(x, w)} AS lower, r{arg_min(y, w)} AS upper FROM (SELECT a.*, a.value AS x, b.value AS y, (round(b.value - a.value, 9), a.k) AS w FROM m a JOIN m b ON a.year = b.year AND a.month = b.month AND a.lat = b.lat AND a.lon = b.lon AND b.k = a.k + floor(0.6e0 * a.n)::INT) GROUP BY 1, 2, 3, 4",
    m="SELECT year, month, lat, lon, value, row_number() OVER (PARTITION BY year, month, lat, lon ORDER BY value) AS k, count(*) OVER (PARTITION BY year, month, lat, lon) AS n FROM cells_ens WHERE value IS NOT NULL",
)
def ensemble_hdi(s, d):
    return reduce.ensemble_hdi(v.cells_ens(s, d), ["year", "month", "lat", "lon"], 0.6)


@query("SELECT lat, lon, year, month, r{avg(value)} AS value FROM (SELECT lat, lon, year, month, value FROM tas UNION ALL SELECT lat, lon, year, month, value * 0.4e0 FROM tos WHERE year > 1995) WHERE year > 1995 GROUP BY 1, 2, 3, 4")
def multimodel_mean(s, d):
    a, b = _xy(s, d)
    return reduce.multimodel_mean([a, b.where("year > 1995")], _KEYS, ["year", "month"])


@query("SELECT lat, lon, count(CASE WHEN value < 1e0 THEN value END) = 0 AS land FROM tas GROUP BY 1, 2")
def land_mask(s, d):
    return reduce.land_mask(v.tas(s, d).withColumn("value", F.when(F.col("value") < 1.0, F.col("value"))), ["lat", "lon"])


@query(
    "SELECT max(n)::BIGINT AS n, r{avg(c / p)} AS r, r{max(n) * (1 - avg(c / p) ** 2) / (1 + avg(c / p) ** 2)} AS dof FROM (SELECT state_idx, count(*) AS n, avg(x * p) AS c, avg(x * x) AS p FROM (SELECT state_idx, x, lag(x) OVER (PARTITION BY state_idx ORDER BY sample_idx) AS p FROM sm) GROUP BY 1)"
)
def effective_dof(s, d):
    return reduce.effective_dof(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], "x")


@query("SELECT year, month, lat, lon, ens, r{m + (value - m) * sqrt(1.44e0)} AS value FROM (SELECT *, avg(value) OVER (PARTITION BY year, month, lat, lon) AS m FROM cells_ens)")
def inflate_covariance(s, d):
    return reduce.inflate(v.cells_ens(s, d), ["year", "month", "lat", "lon"], 1.44).drop("field")


@query("SELECT lat, lon, year, season, r{least(greatest(a.value + c.climatology, 1), 2)} AS value FROM anom a JOIN clim c USING (field, lat, lon, season) WHERE a.field = 'tas'")
def add_climatology_clip(s, d):
    clim = resample.climatology(v.seasonal(s, d), "season", period=(1996, 2000), t=ta.season_to_decimal(F.col("year"), F.col("season")))
    return reduce.add_climatology_clipped(_anom(s, d).where("field = 'tas'"), clim, [*CELL, "season"], 1.0, 2.0).drop("field")


@query("SELECT lat, lon, month, r{avg(value)} AS climatology FROM (SELECT * FROM tas WHERE year < 1998 UNION ALL SELECT * FROM tos WHERE year >= 1998 AND year < 2000) GROUP BY 1, 2, 3")
def hybrid_climatology(s, d):
    return reduce.hybrid_climatology(v.tas(s, d), v.tos(s, d).where("year >= 1998"), 2000, ["lat", "lon"], "month")


@query(
    "SELECT user_id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END AS new FROM (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv))) GROUP BY user_id, g",
    iv="SELECT user_id, day(ts)::INT AS a, (day(ts) + 2)::INT AS z FROM events WHERE value > 60",
)
def merge_intervals(s, d):
    e = v.read(s, d, "events").where("value > 60").select("user_id", F.dayofmonth("ts").alias("a"), (F.dayofmonth("ts") + 2).alias("z"))
    return reduce.merge_intervals(e, "a", "z", ["user_id"])


@query(
    "SELECT s_nationkey::INT AS cell, r{avg(l_quantity)} AS rsdt, r{avg(l_discount) * 100} AS rsut, r{avg(l_tax) * 100} AS rlut, r{avg(l_quantity) - avg(l_discount) * 100 - avg(l_tax) * 100} AS eei FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"
)
def derived_energy_imbalance(s, d):
    o = v.read(s, d, "lineitem").join(v.read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = o.groupBy(F.col("s_nationkey").cast("int").alias("cell")).agg(F.avg("l_quantity").alias("rsdt"), (F.avg("l_discount") * 100).alias("rsut"), (F.avg("l_tax") * 100).alias("rlut"))
    return reduce.energy_imbalance(g.unpivot(["cell"], ["rsdt", "rsut", "rlut"], "field", "value"), ["cell"])


# -- stitching --------------------------------------------------------------


@query(
    "SELECT * FROM (SELECT lat, lon, year::INT AS year, season::INT AS season, r{value} AS value FROM a UNION ALL SELECT lat, lon, year::INT, season::INT, r{value} FROM b UNION ALL SELECT lat, lon, 1998, 1, r{avg(value)} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE (year = 1997 OR year = 1999) AND season = 1 GROUP BY 1, 2)",
    a="SELECT lat, lon, year, season, value FROM seas WHERE field = 'tas' AND year * 4 + season < 1998 * 4 + 1",
    b0="SELECT lat, lon, year, season, value FROM seas WHERE field = 'tos' AND year * 4 + season >= 1998 * 4 + 2",
    b="SELECT b0.lat, b0.lon, year, season, value + coalesce(am - bm, 0) AS value FROM b0 LEFT JOIN (SELECT lat, lon, avg(value) AS am FROM a WHERE year > 1993 GROUP BY 1, 2) x USING (lat, lon) LEFT JOIN (SELECT lat, lon, avg(value) AS bm FROM b0 WHERE year < 2003 GROUP BY 1, 2) y USING (lat, lon)",
)
def stitch_series(s, d):
    k = F.col("year") * 4 + F.col("season")
    x = v.seasonal(s, d)
    return resample.stitch(x.where((F.col("field") == "tas") & (k < 1998 * 4 + 1)).drop("field"), x.where((F.col("field") == "tos") & (k >= 1998 * 4 + 2)).drop("field"), ["lat", "lon"])


# -- space ------------------------------------------------------------------

_HAV = "2 * 6371.0088e0 * asin(sqrt(least(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({y} - {x}) / 2) ** 2, 1)))"
_H = _HAV.format(a="s.lat", b="g.lat", x="s.lon", y="g.lon")


@query(f"SELECT s.pid, g.cell, r{{{_H}}} AS km FROM sites s CROSS JOIN grid g WHERE g.cell = s.pid % 5")
def haversine(s, d):
    g = v.grid(s).select("cell", F.col("lat").alias("b"), F.col("lon").alias("y"))
    x = v.sites(s, d).withColumn("cell", (F.col("pid") % 5).cast("int")).join(F.broadcast(g), "cell")  # 25 cells
    return x.select("pid", "cell", sc.haversine_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("y")).alias("km"))


@query(f"SELECT pid, grid_lat, grid_lon, r{{distance}} AS distance FROM (SELECT s.pid, g.lat AS grid_lat, g.lon AS grid_lon, round({_H}, 6) AS distance, row_number() OVER (PARTITION BY s.pid ORDER BY round({_H}, 6), g.lat, g.lon) AS k FROM sites s CROSS JOIN grid g) WHERE k = 1")
def nearest_gridpoint(s, d):
    return spatial.nearest_gridpoint(v.sites(s, d), v.grid(s))


@query(
    f"SELECT pid, grid_lat, grid_lon, r{{distance}} AS distance FROM (SELECT s.pid, g.lat AS grid_lat, g.lon AS grid_lon, round({_H}, 6) AS distance, row_number() OVER (PARTITION BY s.pid ORDER BY round({_H}, 6), g.lat, g.lon) AS k FROM sites s CROSS JOIN gd g) WHERE k = 1",
    gd="SELECT lat, lon FROM tas WHERE year = 1996 AND month = 5 AND value > 1.4e0",
)
def nearest_gridpoint_with_data(s, d):
    return spatial.nearest_gridpoint_with_data(v.sites(s, d), v.tas(s, d).where("year = 1996 and month = 5").withColumn("value", F.when(F.col("value") > 1.4, F.col("value"))))


@query("SELECT pid, arg_min(g.lat, (abs(s.lat - g.lat), g.lat)) AS grid_lat, arg_min(g.lon, (abs(s.lon - g.lon), g.lon)) AS grid_lon FROM sites s CROSS JOIN grid g GROUP BY 1")
def nearest_per_dimension(s, d):
    return spatial.nearest_per_dimension(v.sites(s, d), v.grid(s))


@query("SELECT event_id, r{CASE WHEN z <= 1 THEN 1 - z ** 2 * 5e0 / 3 + z ** 3 * 5 / 8 + z ** 4 / 2 - z ** 5 / 4 WHEN z <= 2 THEN 4 - 5 * z + z ** 2 * 5e0 / 3 + z ** 3 * 5 / 8 - z ** 4 / 2 + z ** 5 / 12 - 2e0 / 3 / z ELSE 0 END} AS loc FROM (SELECT event_id, value * 10 / 500e0 AS z FROM events)")
def gaspari_cohn(s, d):
    return v.read(s, d, "events").select("event_id", sc.gaspari_cohn(F.col("value") * 10, 1000.0).alias("loc"))


@query("SELECT (-75 + 30 * (i // 12))::DOUBLE AS lat, (15 + 30 * (i % 12))::DOUBLE AS lon FROM range(72) r(i)")
def regular_grid(s, d):
    return spatial.regular_grid(s, -90, 90, 30, 0, 360, 30)


@query("SELECT pid, r{2 * pi() * 6371.0088e0 * cos(radians(lat)) * lon / 360} AS x, r{pi() * 6371.0088e0 * lat / 180} AS y FROM sites")
def cartesian_coords(s, d):
    x, y = sc.cartesian_km(F.col("lat"), F.col("lon"))
    return v.sites(s, d).select("pid", x.alias("x"), y.alias("y"))


@query("SELECT field, lat, lon, year, season, r{CASE WHEN abs(lat) <= 45 THEN value END} AS value FROM seas")
def mask_poles(s, d):
    return v.seasonal(s, d).withColumn("value", sc.mask_poles(F.col("value"), F.col("lat"), 45.0))


_APART = "((lon_t - lon + 180) - floor((lon_t - lon + 180) / 360) * 360 - 180)"
_TGT = "SELECT (-75 + 30 * (i // 8))::DOUBLE AS lat_t, (22.5e0 + 45 * (i % 8)) AS lon_t FROM range(48) r(i)"
_CW = f"SELECT lat, lon, lat_t, lon_t, (sin(radians(least(lat + 15, lat_t + 15))) - sin(radians(greatest(lat - 15, lat_t - 15)))) * (least(36, {_APART} + 22.5e0) - greatest(-36, {_APART} - 22.5e0)) AS w FROM grid CROSS JOIN tgt WHERE abs(lat - lat_t) < 30 AND abs({_APART}) < 58.5e0"
_BW = f"SELECT lat, lon, lat_t, lon_t, (1 - abs(lat - least(greatest(lat_t, -60), 60)) / 30) * (1 - abs({_APART}) / 72) AS w FROM grid CROSS JOIN tgt WHERE abs(lat - least(greatest(lat_t, -60), 60)) < 30 AND abs({_APART}) < 72"
_RG = "SELECT field, year, season, lat_t AS lat, lon_t AS lon, r{CASE WHEN 1 - coalesce(sum(CASE WHEN value IS NOT NULL THEN w END), 0) / sum(w) <= 0.75e0 THEN sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END) END} AS value FROM seas JOIN ww USING (lat, lon) WHERE w > 1e-12 GROUP BY 1, 2, 3, 4, 5"


@query(_RG, tgt=_TGT, ww=_CW)
def regrid_conservative(s, d):
    w = spatial.conservative_weights(v.grid(s), spatial.regular_grid(s, -90, 90, 30, 0, 360, 45), 30, 72, 30, 45)
    return spatial.regrid(v.seasonal(s, d), w, ["field", "year", "season"])


@query(_RG, tgt=_TGT, ww=_BW)
def regrid_bilinear(s, d):
    w = spatial.bilinear_weights(v.grid(s), spatial.regular_grid(s, -90, 90, 30, 0, 360, 45), 30, 72)
    return spatial.regrid(v.seasonal(s, d), w, ["field", "year", "season"])


# -- regression and time series ---------------------------------------------

_ST = "SELECT *, year + (season * 3 + 0.5e0) / 12 AS t FROM seas"


def _st(s, d):
    return v.seasonal(s, d).withColumn("t", ta.season_to_decimal(F.col("year"), F.col("season")))


@query("SELECT field, lat, lon, year, season, r{value - (regr_intercept(value, t) OVER w + regr_slope(value, t) OVER w * t)} AS value FROM st WINDOW w AS (PARTITION BY field, lat, lon)", st=_ST)
def detrend_linear(s, d):
    return regress.detrend(_st(s, d), "t", CELL).drop("t")


@query("SELECT field, lat, lon, year, season, r{value - (regr_intercept(value, t) OVER w + regr_slope(value, t) OVER w * t)} AS value FROM st WINDOW w AS (PARTITION BY field, lat, lon, season)", st=_ST)
def detrend_by_season(s, d):
    return regress.detrend(_st(s, d), "t", [*CELL, "season"]).drop("t")


# Normal equations of a parabola in u by Cramer's rule.
@query(
    "SELECT field, lat, lon, year, season, r{CASE WHEN n > 2 THEN value - (c0 + c1 * u + c2 * u * u) / det ELSE value END} AS value FROM pu LEFT JOIN cf USING (field, lat, lon)",
    pu="SELECT field, lat, lon, year, season, value, year + (season * 3 + 0.5e0) / 12 - 1998 AS u FROM seas",
    mo="SELECT field, lat, lon, count(value) AS n, sum(u) AS s1, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(value) AS v0, sum(u * value) AS v1, sum(u * u * value) AS v2 FROM pu WHERE value IS NOT NULL GROUP BY 1, 2, 3",
    cf="SELECT field, lat, lon, n, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det, v0 * (s2 * s4 - s3 * s3) - s1 * (v1 * s4 - s3 * v2) + s2 * (v1 * s3 - s2 * v2) AS c0, n * (v1 * s4 - s3 * v2) - v0 * (s1 * s4 - s3 * s2) + s2 * (s1 * v2 - v1 * s2) AS c1, n * (s2 * v2 - v1 * s3) - s1 * (s1 * v2 - v1 * s2) + v0 * (s1 * s3 - s2 * s2) AS c2 FROM mo",
)
def detrend_quadratic(s, d):
    return regress.detrend(_st(s, d), "t", CELL, degree=2).drop("t")


_IX = f"SELECT year, season, {_mean('lat BETWEEN -30 AND 30')} AS x FROM seas WHERE field = 'tos' GROUP BY 1, 2"


def _index(s, d):
    return reduce.area_weighted_mean(v.seasonal(s, d).where("field = 'tos' and lat between -30 and 30"), ["year", "season"]).withColumnRenamed("value", "x")


@query("SELECT field, lat, lon, r{CASE WHEN count(value) = count(*) THEN regr_slope(value, x) END} AS slope FROM seas JOIN ix USING (year, season) WHERE x IS NOT NULL GROUP BY 1, 2, 3", ix=_IX)
def regress_field(s, d):
    return regress.regress_field(v.seasonal(s, d), _index(s, d), ["year", "season"], CELL)


@query(f"SELECT r{{regr_slope(value, x)}} AS slope FROM (SELECT year, season, {_mean()} AS value FROM seas WHERE field = 'tas' GROUP BY 1, 2) JOIN ix USING (year, season)", ix=_IX)
def regress_scalar(s, d):
    return regress.regress_scalar(reduce.area_weighted_mean(v.seasonal(s, d).where("field = 'tas'"), ["year", "season"]), _index(s, d), ["year", "season"])


_MO = "SELECT *, row_number() OVER (PARTITION BY field, lat, lon ORDER BY year, month) AS i FROM cells"


def _sliding(lo: str, hi: str) -> str:
    return f"SELECT field, lat, lon, year, month, r{{trend}} AS trend FROM (SELECT *, regr_slope(value, i) OVER w AS trend, count(value) OVER w AS n FROM mo WINDOW w AS (PARTITION BY field, lat, lon ORDER BY i ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)) WHERE n = 12"


@query(_sliding("6", "5"), mo=_MO)
def sliding_trend_center(s, d):
    return regress.sliding_trend(v.cells(s, d), ["year", "month"], CELL, 12)


@query(_sliding("11", "0"), mo=_MO)
def sliding_trend_right(s, d):
    return regress.sliding_trend(v.cells(s, d), ["year", "month"], CELL, 12, center=False)


@query("SELECT field, lat, lon, year, month, r{m} AS mean FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM mo WINDOW w AS (PARTITION BY field, lat, lon ORDER BY i ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)) WHERE n = 61", mo=_MO)
def rolling_mean(s, d):
    return regress.rolling_mean(v.cells(s, d), ["year", "month"], CELL, 61)


_PAIR = "SELECT a.lat, a.lon, a.year, a.month, a.value AS a, b.value AS b FROM tas a JOIN tos b USING (lat, lon, year, month)"


def _pair(s, d):
    return v.tas(s, d).select(*_KEYS, F.col("value").alias("a")).join(v.tos(s, d).select(*_KEYS, F.col("value").alias("b")), _KEYS)


_LAGS = " UNION ALL ".join(
    f"SELECT lat, lon, {k} AS lag, r{{corr(x, y)}} AS corr FROM (SELECT lat, lon, {'lag(a, ' + str(-k) + ') OVER w' if k < 0 else 'a'} AS x, {'lag(b, ' + str(k) + ') OVER w' if k > 0 else 'b'} AS y FROM pr WINDOW w AS (PARTITION BY lat, lon ORDER BY year, month)) GROUP BY 1, 2"
    for k in range(-3, 4)
)


@query(f"SELECT lat, lon, lag::INT AS lag, corr FROM ({_LAGS})", pr=_PAIR)
def lag_correlation(s, d):
    return signal.lag_correlation(_pair(s, d), ["lat", "lon"], ["year", "month"], 3)


_AC = "SELECT state_idx, sum(d * p) / (count(d) - 1) / (sum(d * d) / count(d)) AS r FROM (SELECT state_idx, d, lag(d) OVER (PARTITION BY state_idx ORDER BY sample_idx) AS p FROM (SELECT state_idx, sample_idx, x - avg(x) OVER (PARTITION BY state_idx) AS d FROM sm)) GROUP BY 1"


@query("SELECT state_idx, r{r} AS autocorrelation FROM ac", ac=_AC)
def autocorrelation(s, d):
    return signal.autocorrelation(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], value="x")


@query("SELECT state_idx, sample_idx, r{coalesce(x - r * lag(x) OVER (PARTITION BY state_idx ORDER BY sample_idx), x)} AS white FROM sm JOIN ac USING (state_idx)", ac=_AC)
def prewhiten(s, d):
    return signal.prewhiten(v.state_matrix(s, d), ["state_idx"], ["sample_idx"], value="x").drop("x")


@query("SELECT k, r{s / sum(s) OVER () * 100} AS power FROM (SELECT i::INT AS k, (1 - 0.36e0) / (1 - 1.2e0 * cos(2 * pi() * i / 200e0 * 0.5e0) + 0.36e0) AS s FROM range(200) r(i))")
def red_noise_spectrum(s, d):
    f = s.range(200).select(F.col("id").cast("int").alias("k"), (F.col("id") / 200).alias("f"))
    return signal.red_noise_spectrum(f, 0.6, 0.5).select("k", (F.col("power") * 100).alias("power"))


@query(
    "SELECT field, lat, lon, year, season, r{CASE WHEN p IS NULL THEN (n - value) / k WHEN n0 IS NULL THEN (value - p0) / h ELSE (h * h * n + (k * k - h * h) * value - k * k * p0) / (h * k * (h + k)) END} AS derivative FROM (SELECT *, lag(t) OVER w AS p, lag(value) OVER w AS p0, lead(value) OVER w AS n, lead(t) OVER w AS n0, t - lag(t) OVER w AS h, lead(t) OVER w - t AS k FROM st WINDOW w AS (PARTITION BY field, lat, lon ORDER BY t))",
    st=_ST,
)
def time_derivative(s, d):
    return regress.time_derivative(_st(s, d), "t", CELL).drop("t", "value")


def _area_series(s, d):
    m = reduce.area_weighted_mean(v.cells(s, d), ["field", "year", "month"])
    return m.withColumn("t", F.col("year") + (F.col("month") - 0.5) / 12).select("field", "t", "value")


@query()
def lowpass_filter(s, d):
    return signal.lowpass_filter(_area_series(s, d), ["field"], "t", 1.5)


@query()
def highpass_filter(s, d):
    return signal.highpass_filter(_area_series(s, d), ["field"], "t", 1.5)


@query()
def bandpass_filter(s, d):
    return signal.bandpass_filter(_area_series(s, d), ["field"], "t", 0.8, 3.0)


@query()
def spectrum_multitaper(s, d):
    return signal.spectrum_multitaper(_area_series(s, d), ["field"], "t", significance=0.95)


@query()
def corr_significance(s, d):
    return regress.correlation_significance(_pair(s, d).withColumn("t", F.col("year") * 12 + F.col("month")), ["lat", "lon"], "t")


# -- columns and units ------------------------------------------------------


@query("SELECT event_id, u AS unit, r{CASE u WHEN 'degC' THEN value + 273.15e0 WHEN '0.001' THEN value / 1000 WHEN '%' THEN value / 100 WHEN 'centimeters' THEN value / 100 WHEN 'hPa' THEN value * 100 ELSE value END} AS value, CASE u WHEN 'degC' THEN 'K' WHEN '0.001' THEN '1' WHEN '%' THEN '1' WHEN 'centimeters' THEN 'm' WHEN 'hPa' THEN 'Pa' ELSE u END AS si FROM (SELECT event_id, value, ['degC', '0.001', '%', 'centimeters', 'hPa', 'm'][event_id % 6 + 1] AS u FROM events)")
def convert_units_si(s, d):
    u = F.element_at(F.array(*map(F.lit, ("degC", "0.001", "%", "centimeters", "hPa", "m"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = v.read(s, d, "events").select("event_id", "value", u.alias("unit"))
    return e.select("event_id", "unit", sc.to_si(F.col("value"), F.col("unit")).alias("value"), sc.si_unit(F.col("unit")).alias("si"))


def _cloud(name: str, sql: str, band: str = "total") -> None:
    def fn(s, d):
        return vertical.cloud_fraction(v.columns(s, d), ["cell"], name, band)

    fn.__name__ = f"cloud_fraction_{name}" + ("" if band == "total" else f"_{band}")
    query(sql)(fn)


_cloud("max", "SELECT cell, r{max(value)} AS value FROM cols WHERE lev BETWEEN 5000 AND 120000 GROUP BY 1")
_cloud("min", "SELECT cell, r{least(1, sum(value))} AS value FROM cols WHERE lev BETWEEN 5000 AND 120000 GROUP BY 1")
_cloud("random", "SELECT cell, r{1 - product(1 - value)} AS value FROM cols WHERE lev BETWEEN 5000 AND 120000 GROUP BY 1")
_cloud("random", "SELECT cell, r{1 - product(1 - value)} AS value FROM cols WHERE lev BETWEEN 70000 AND 120000 GROUP BY 1", "low")
_cloud("random", "SELECT cell, r{1 - product(1 - value)} AS value FROM cols WHERE lev BETWEEN 40000 AND 70000 GROUP BY 1", "medium")
_cloud("random", "SELECT cell, r{1 - product(1 - value)} AS value FROM cols WHERE lev BETWEEN 5000 AND 40000 GROUP BY 1", "high")
# Blocks between clear levels: the largest of each, then random overlap of the blocks.
_cloud("maxrandom", "SELECT cell, r{1 - product(1 - m)} AS value FROM (SELECT cell, b, max(value) AS m FROM (SELECT *, sum((value = 0)::INT) OVER (PARTITION BY cell ORDER BY lev DESC) AS b FROM cols WHERE lev BETWEEN 5000 AND 120000) GROUP BY 1, 2) GROUP BY 1")


@query("SELECT cell, r{1025 * 3850e0 * sum(theta * dz) / 1e9} AS ohc FROM (SELECT cell, theta, depth, coalesce((lead(depth) OVER w + depth) / 2, depth + depth - coalesce((lag(depth) OVER w + depth) / 2, 0)) - coalesce((lag(depth) OVER w + depth) / 2, 0) AS dz FROM cols WINDOW w AS (PARTITION BY cell ORDER BY depth)) WHERE depth <= 500 GROUP BY 1")
def ohc(s, d):
    c = v.columns(s, d).select("cell", F.col("depth").alias("lev"), F.col("theta").alias("value"))
    return vertical.ohc(vertical.level_thickness(c, ["cell"]), ["cell"], 500).select("cell", (F.col("value") / 1e9).alias("ohc"))


@query("SELECT cell, r{o / 1e9} AS ohc, r{o * 361e12 / 1e24} AS total, r{o * 361e12 / 510e12 / 1e9} AS per_surface FROM (SELECT cell, 1025 * 3850e0 * avg(theta) * 700 AS o FROM cols GROUP BY 1)")
def ohc_layer_mean(s, d):
    c = v.columns(s, d).groupBy("cell").agg(F.avg("theta").alias("theta")).withColumn("o", vertical.ohc_from_layer_mean(F.col("theta"), 700.0))
    total = sc.ohc_total(F.col("o"))
    return c.select("cell", (F.col("o") / 1e9).alias("ohc"), (total / 1e24).alias("total"), (sc.ohc_per_area(total) / 1e9).alias("per_surface"))


_SI = "SELECT lat, lon, year, season, least(value / 4, 1) AS c, 6371.0088e0 ** 2 * radians(72) * (sin(radians(least(lat + 15, 90))) - sin(radians(greatest(lat - 15, -90)))) / 1e6 AS area FROM seas WHERE field = 'tos'"


def _sic(s, d):
    return vertical.sea_ice(v.seasonal(s, d).where("field = 'tos'").withColumn("value", F.least(F.col("value") / 4, F.lit(1.0))), ["year", "season"], 30, 72, threshold=0.95)


@query("SELECT year, season, r{coalesce(sum(CASE WHEN lat > 0 THEN c * area END), 0)} AS area_n, r{coalesce(sum(CASE WHEN lat < 0 THEN c * area END), 0)} AS area_s FROM si GROUP BY 1, 2", si=_SI)
def siarea(s, d):
    return _sic(s, d).select("year", "season", (F.col("area_n") / 1e6).alias("area_n"), (F.col("area_s") / 1e6).alias("area_s"))


@query("SELECT year, season, r{coalesce(sum(CASE WHEN lat > 0 AND c >= 0.95e0 THEN area END), 0)} AS extent_n, r{coalesce(sum(CASE WHEN lat < 0 AND c >= 0.95e0 THEN area END), 0)} AS extent_s FROM si GROUP BY 1, 2", si=_SI)
def siextent(s, d):
    return _sic(s, d).select("year", "season", (F.col("extent_n") / 1e6).alias("extent_n"), (F.col("extent_s") / 1e6).alias("extent_s"))


@query(
    "SELECT cell, lev, r{max(CASE WHEN lev <= p0 AND lev > p1 THEN v0 + (ln(p0) - ln(lev)) / (ln(p0) - ln(p1)) * (v1 - v0) WHEN p1 IS NULL AND lev = p0 THEN v0 END)} AS value FROM (SELECT cell, lev AS p0, theta AS v0, lead(lev) OVER w AS p1, lead(theta) OVER w AS v1 FROM cols WINDOW w AS (PARTITION BY cell ORDER BY lev DESC)) CROSS JOIN (SELECT unnest([100000e0, 85000e0, 70000e0, 50000e0, 25000e0, 5000e0, 1000e0]) AS lev) GROUP BY 1, 2"
)
def vertical_interp(s, d):
    c = v.columns(s, d).select("cell", F.col("lev").alias("p"), F.col("theta").alias("value"))
    return vertical.interpolate_log_pressure(c, ["cell"], [100000, 85000, 70000, 50000, 25000, 5000, 1000])


@query("SELECT cell, level, r{0.1e0 * level * 1000 + (1 - level / 8e0) * (900 + cell)} AS p, r{(0.1e0 * level + 1 - level / 8e0) * 1000} AS nominal, r{-CASE WHEN level < 4 THEN 0.1e0 + (-level / 8e0) * (least(300, 50 * cell) + 0.1e0) ELSE -depth END} AS z FROM cols")
def hybrid_levels(s, d):
    a, b, n = 0.1 * F.col("level"), 1 - F.col("level") / 8, F.col("level")
    z = sc.sigma_z(-n / 8, -F.col("depth"), F.lit(0.1), F.col("cell") * 50, F.lit(300), n, 4)
    return v.columns(s, d).select("cell", "level", sc.hybrid_pressure(900 + F.col("cell"), b, a, 1000.0).alias("p"), sc.hybrid_level(a, b).alias("nominal"), z.alias("z"))


# -- indices ----------------------------------------------------------------

_BOX = {"nino34": "lat BETWEEN -5 AND 5 AND lon BETWEEN 190 AND 240", "na": "lat BETWEEN 0 AND 60 AND lon BETWEEN 280 AND 360", "t1": "lat BETWEEN 25 AND 45 AND lon BETWEEN 140 AND 215", "t2": "lat BETWEEN -10 AND 10 AND lon BETWEEN 170 AND 270", "t3": "lat BETWEEN -50 AND -15 AND lon BETWEEN 150 AND 200"}


def _tos_anom(s, d):
    return _anom(s, d).where("field = 'tos'")


@query(f"SELECT year, season, r{{{_mean(_BOX['nino34'])}}} AS nino34 FROM anom WHERE field = 'tos' GROUP BY 1, 2")
def nino34(s, d):
    return indices.nino34(_tos_anom(s, d), ["year", "season"])


@query(f"SELECT year, season, r{{{_mean(_BOX['na'], x='(value - m)')}}} AS amo FROM (SELECT a.*, m FROM anom a JOIN (SELECT year, season, {_mean('lat BETWEEN -60 AND 60')} AS m FROM anom WHERE field = 'tos' GROUP BY 1, 2) USING (year, season) WHERE field = 'tos') GROUP BY 1, 2")
def amo(s, d):
    return indices.amo(_tos_anom(s, d), ["year", "season"])


@query(f"SELECT year, season, r{{{_mean(_BOX['t2'])} - ({_mean(_BOX['t1'])} + {_mean(_BOX['t3'])}) / 2}} AS ipo_tpi FROM anom WHERE field = 'tos' GROUP BY 1, 2")
def ipo_tpi(s, d):
    return indices.ipo_tripole(_tos_anom(s, d), ["year", "season"])


@query()
def pdo(s, d):
    return indices.pdo(_tos_anom(s, d), ["year", "season"])[0]


from . import registry_models  # noqa: E402, F401
from . import registry_extra  # noqa: E402, F401
from . import registry_checked  # noqa: E402, F401
from . import registry_blocks  # noqa: E402, F401
