"""Queries on projections, filters, names, joins and the remaining plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import timeaxis as ta
from ..operators import harmonics, linear, proxies, reduce, resample, spatial
from ..sources import io
from . import assimilate, postprocess
from . import views as v
from .registry import _anom, query
from .registry_models import _TIME, _mapper


@query("SELECT l_orderkey, l_linenumber, (round_even(0.25e0 * round_even(l_quantity * 0.37e0 / 0.25e0, 0), 1) + 0e0) AS rounded FROM lineitem WHERE l_orderkey % 10 < 10")
def round_to(s, d):
    return v.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", sc.round_to(F.col("l_quantity") * 0.37, 0.25, 1).alias("rounded"))


@query("SELECT pid, r{CASE WHEN lon < 0 THEN lon + 360 ELSE lon END} AS lon FROM (SELECT pid, lon - 180 AS lon FROM sites) ORDER BY lon")
def wrap_longitude(s, d):
    return v.sites(s, d).select("pid", sc.wrap_longitude(F.col("lon") - 180).alias("lon")).orderBy("lon")


@query("SELECT event_id, CASE WHEN value BETWEEN 10 AND 50 THEN value END AS value FROM events")
def filter_valid(s, d):
    return v.read(s, d, "events").select("event_id", sc.filter_valid(F.col("value"), F.lit(10.0), F.lit(50.0)).alias("value"))


@query("SELECT field, year, month, r{avg(value)} AS value, field IN ('tos', 'siconc', 'siconcn', 'siconcs', 'ohc300', 'ohc700') AS ocean FROM cells WHERE field IN ('tos') AND year BETWEEN 1996 AND 1998 GROUP BY 1, 2, 3")
def select_fields_and_years(s, d):
    """Both borders of a range belong to it."""
    x = v.cells(s, d).where(F.col("field").isin("tos") & F.col("year").between(1996, 1998))
    return reduce.plain_mean(x, ["field", "year", "month"]).withColumn("ocean", F.col("field").isin(*sc.OCEAN_FIELDS))


@query("SELECT lat, lon, year, season, r{max(CASE WHEN field = 'tas' THEN value END)} AS tas, r{max(CASE WHEN field = 'tos' THEN value END)} AS tos FROM seas GROUP BY 1, 2, 3, 4")
def merge_fields(s, d):
    """Outer merge of two fields on their coordinates."""
    x = v.seasonal(s, d)
    keys = ["lat", "lon", "year", "season"]
    return x.groupBy(*keys).pivot("field", ["tas", "tos"]).agg(F.first("value"))


@query("SELECT field, lat, lon, year, season, r{value} AS value FROM seas WHERE NOT (lat = 60 AND lon IN (10, 82))")
def mask_cells(s, d):
    mask = v.grid(s).where("lat = 60 and lon in (10, 82)")
    return spatial.mask_cells(v.seasonal(s, d), mask)


@query("SELECT field, year, season, ['DJF', 'MAM', 'JJA', 'SON'][season + 1] AS label, make_date(year, season * 3 + 1, 1)::VARCHAR AS stamp, r{avg(value)} AS value FROM seas GROUP BY 1, 2, 3")
def season_labels(s, d):
    q, y = F.col("season"), F.col("year")
    g = reduce.plain_mean(v.seasonal(s, d), ["field", "year", "season"])
    return g.withColumns({"label": ta.season_label(q), "stamp": F.make_date(y, q * 3 + 1, F.lit(1)).cast("string")})


@query("SELECT field, lat, lon, year, season, r{value / CASE field WHEN 'siconc' THEN 1e-2 ELSE 1 END} AS value FROM (SELECT CASE field WHEN 'tos' THEN 'siconc' ELSE field END AS field, lat, lon, year, season, value FROM seas)")
def scaled_fields(s, d):
    return io.scaled(v.seasonal(s, d).withColumn("field", F.when(F.col("field") == "tos", "siconc").otherwise(F.col("field"))))


@query("SELECT s_nationkey::INT AS cell, r{avg(l_quantity) - avg(l_tax) * 100} AS \"FSUT\", r{avg(l_tax) * 100 - avg(l_discount) * 100} AS \"RESTOM\" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def derived_model_fields(s, d):
    o = v.read(s, d, "lineitem").join(v.read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = o.groupBy(F.col("s_nationkey").cast("int").alias("cell")).agg(F.avg("l_quantity").alias("SOLIN"), (F.avg("l_tax") * 100).alias("FSNT"), (F.avg("l_discount") * 100).alias("FLNT"))
    out = io.derived_fields(g.unpivot(["cell"], ["SOLIN", "FSNT", "FLNT"], "field", "value"), ["cell"])
    return out.groupBy("cell").pivot("field", ["FSUT", "RESTOM"]).agg(F.first("value"))


@query("SELECT ens, lat, lon, year, month, r{value} AS value FROM cells_ens SEMI JOIN (SELECT ens FROM (SELECT DISTINCT ens FROM cells_ens) ORDER BY md5('42324235:' || ens) LIMIT 2) USING (ens)")
def subsample_ensemble(s, d):
    return proxies.subsample(v.cells_ens(s, d), 2).select("ens", "lat", "lon", "year", "month", "value")


@query("SELECT pid, year, season, r{y} AS value FROM (SELECT pid, year, season, value AS y FROM site_obs) SEMI JOIN (SELECT pid FROM sites WHERE dt > 0.5e0) USING (pid) ANTI JOIN (SELECT pid FROM sites WHERE ptype = 'ice') USING (pid)")
def proxies_minus_removed(s, d):
    """Records of one resolution without those of a removed type."""
    st = v.sites(s, d)
    return v.site_obs(s, d).join(st.where("dt > 0.5").select("pid"), "pid", "left_semi").join(st.where("ptype = 'ice'").select("pid"), "pid", "left_anti")


@query()
def regrid_spherical_harmonics(s, d):
    x = v.seasonal(s, d).where("field = 'tos'").select("year", "season", "lat", "lon", F.coalesce("value", F.lit(0.0)).alias("value"))
    return harmonics.truncate(x, ["year", "season"], 3)


@query()
def spectrum_spherical_harmonics(s, d):
    x = v.seasonal(s, d).where("field = 'tos'").select("year", "season", "lat", "lon", F.coalesce("value", F.lit(0.0)).alias("value"))
    return harmonics.spectrum(x, ["year", "season"], 3)


@query()
def pseudo_obs_idealized(s, d):
    """A seeded half of the records sees the truth with noise of one size."""
    st = proxies.split_sites(v.sites(s, d), 0.5).where("assimilated").select("pid")
    at = spatial.nearest_gridpoint_with_data(v.sites(s, d), v.tos(s, d)).select("pid", F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon")).join(st, "pid")
    truth = at.join(v.seasonal(s, d).where("field = 'tos'").withColumnRenamed("value", "x"), ["lat", "lon"])
    return proxies.pseudo_obs(truth, F.lit(0.3), seed=544_502).select("pid", "year", "season", "value")


def _physical(s, d, mode: str):
    m, cells = _mapper(s, d)
    complete = linear.nan_mask(cells, ["field", "lat", "lon"])
    places, forward, backward = m.matrices()
    reduced = m.forward(complete, _TIME)
    from ..operators import lim

    model = lim.fit(reduced.withColumn("k", (F.col("year") * 4 + F.col("season")).cast("bigint")).select("k", "state", "x"), "state", "k", 0.25)
    space = assimilate.Physical(forward, backward, np.array([p[1] for p in places]), np.array([p[2] for p in places]), 9000.0)
    at = s.createDataFrame([(k, lat, lon, k) for k, (f, lat, lon) in enumerate(places) if f == "tos"], "pid long, lat double, lon double, at int")
    obs = proxies.pseudo_obs(complete.where("field = 'tos'").join(at, ["lat", "lon"]).withColumnRenamed("value", "x"), F.lit(0.1)).select("pid", "year", "season", "value")
    models = proxies.identity_models(at, 0.1).join(at.select("pid", "at"), "pid").withColumn("season", F.explode(F.array(*[F.lit(q) for q in range(4)])))
    due = assimilate.schedule(obs, models, None, 1996, 1997)
    x0 = backward @ assimilate.initial_from_sample(reduced, 6)
    return assimilate.reconstruct(due, 2, x0, model, 1996, 1997, fraction=0.8, mode=mode, space=space)


@query()
def reconstruction_physical_instantaneous(s, d):
    return _physical(s, d, "instantaneous").groupBy("iteration", "year", "season", "state").agg(F.avg("posterior").alias("posterior"))


@query()
def reconstruction_physical_window(s, d):
    return _physical(s, d, "average").groupBy("iteration", "year", "season", "state").agg(F.avg("posterior").alias("posterior"))


@query("SELECT field, year, season, region, r{value} AS value FROM (SELECT field, year, season, 'global' AS region, sum(cos(radians(lat)) * value) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) AS value FROM pa GROUP BY 1, 2, 3)", pa="SELECT field, lat, lon, year, season, value - avg(CASE WHEN year + (season * 3 + 0.5e0) / 12 >= 1996 AND year + (season * 3 + 0.5e0) / 12 < 2000 THEN value END) OVER (PARTITION BY field, lat, lon, season) AS value FROM seas")
def postprocess_regional(s, d):
    """Post-processing of one member."""
    return postprocess.products(v.seasonal(s, d), (1996, 2000), ens=False)["regional"].where("region = 'global'").select("field", "year", "season", "region", "value")


@query("SELECT field, season, r{avg(value)} AS climatology, count(DISTINCT year) AS years FROM anom WHERE value IS NOT NULL GROUP BY 1, 2")
def anomaly_check(s, d):
    return _anom(s, d).where("value is not null").groupBy("field", "season").agg(F.avg("value").alias("climatology"), F.countDistinct("year").alias("years"))


@query("SELECT field, lat, lon, year, season, r{value - climatology} AS value FROM seas LEFT JOIN (SELECT field, lat, lon, season, avg(value) AS climatology FROM seas WHERE year <= 1998 GROUP BY 1, 2, 3, 4) USING (field, lat, lon, season)")
def anomalize_given_climatology(s, d):
    x = v.seasonal(s, d)
    given = resample.climatology(x, "season", period=(0, 1998), closed=True)
    return resample.anomalize(x, "season", given=given)
