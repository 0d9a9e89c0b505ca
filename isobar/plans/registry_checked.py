"""Queries whose results do not hang on signs of modes or drawn numbers, and sources and sinks over small written files."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lim, linear, regress, resample
from ..operators.mapper import Mapper
from ..sources import io
from . import postprocess
from . import views as v
from .registry import _PAIR, _pair, query
from .registry_models import _TIME

# -- modes ------------------------------------------------------------------

_SEASONAL = "SELECT field, lat, lon, year, season, value - avg(value) OVER (PARTITION BY field, lat, lon, season) AS value FROM seas"
_WHOLE = "SELECT field, lat, lon, year, season, r{value} AS value FROM (SELECT *, count(value) OVER w AS n, count(*) OVER w AS m FROM an WINDOW w AS (PARTITION BY field, lat, lon)) WHERE n = m"


@query(_WHOLE, an=_SEASONAL)
def mapper_roundtrip_all_modes(s, d):
    """With all modes the reduced space holds everything."""
    cells = resample.anomalize(v.seasonal(s, d), "season").persist()
    full = Mapper(k=linear.SIDE, l=linear.SIDE).fit(cells, _TIME)
    return full.backward(full.forward(linear.nan_mask(cells, ["field", "lat", "lon"]), _TIME), _TIME).select("field", "lat", "lon", *_TIME, "value")


@query(_WHOLE, an=_SEASONAL)
def truncate_all_modes(s, d):
    cells = resample.anomalize(v.seasonal(s, d), "season").persist()
    full = Mapper(k=linear.SIDE, l=linear.SIDE, separate_mean=True).fit(cells, _TIME)
    return full.truncate(cells, _TIME).select("field", "lat", "lon", *_TIME, "value")


@query("SELECT r{sum(CASE WHEN i = j THEN c END)} AS total, r{sum(c * c)} AS squares FROM (SELECT a.state_idx AS i, b.state_idx AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM sm a JOIN sm b USING (sample_idx) GROUP BY 1, 2)")
def eof_spectrum(s, d):
    """Sum and sum of squares of all variances: trace and squared norm of the covariance."""
    var = linear.eof_fit(v.state_matrix(s, d), ["state_idx"], ["sample_idx"]).variance
    return s.createDataFrame([(float(var.sum()), float((var**2).sum()))], "total double, squares double")


# -- linear models of a state projected on two fixed patterns ----------------

_Z = "SELECT sample_idx, sum(x * cos(pi() * (state_idx + 0.5e0) / 64)) AS a, sum(x * cos(pi() * (state_idx + 0.5e0) / 32)) AS b FROM sm GROUP BY 1"
_MODEL = {
    "z": _Z,
    "lagged": "SELECT sum(p.a * p.a) AS c11, sum(p.a * p.b) AS c12, sum(p.b * p.b) AS c22, sum(q.a * p.a) AS t11, sum(q.a * p.b) AS t12, sum(q.b * p.a) AS t21, sum(q.b * p.b) AS t22 FROM z p JOIN z q ON q.sample_idx = p.sample_idx + 1",
    "g": "SELECT (t11 * c22 - t12 * c12) / det AS g11, (t12 * c11 - t11 * c12) / det AS g12, (t21 * c22 - t22 * c12) / det AS g21, (t22 * c11 - t21 * c12) / det AS g22 FROM (SELECT *, c11 * c22 - c12 * c12 AS det FROM lagged)",
}


def _projected(s: SparkSession, d: str) -> DataFrame:
    """Every sample and state element, projected on two cosines."""
    i = F.col("id").cast("int")
    patterns = s.range(64).select(i.alias("state_idx"), F.array(*[F.cos(F.lit(np.pi) * (i + 0.5) * m / 64) for m in (1, 2)]).alias("u"))
    return linear.project(v.state_matrix(s, d), patterns, ["state_idx"], ["sample_idx"])


def _projected_lim(s: SparkSession, d: str) -> lim.Lim:
    return lim.fit(_projected(s, d), "mode", "sample_idx", 0.25, "score")


@query("SELECT 0 AS i, 0 AS j, r{g11} AS g FROM g UNION ALL SELECT 0, 1, r{g12} FROM g UNION ALL SELECT 1, 0, r{g21} FROM g UNION ALL SELECT 1, 1, r{g22} FROM g", **_MODEL)
def lim_fit_projected(s, d):
    m = _projected_lim(s, d)
    return s.createDataFrame([(i, j, float(m.g[i, j])) for i in range(2) for j in range(2)], "i int, j int, g double")


_STEPS = {"f0": "SELECT 1e0 AS a, 1e0 AS b"} | {f"f{k}": f"SELECT g11 * a + g12 * b AS a, g21 * a + g22 * b AS b FROM f{k - 1}, g" for k in range(1, 5)}


@query(" UNION ALL ".join(f"SELECT 0 AS state, {k} AS step, r{{a}} AS x FROM f{k} UNION ALL SELECT 1, {k}, r{{b}} FROM f{k}" for k in range(5)), **_MODEL, **_STEPS)
def lim_forecast_projected(s, d):
    f = _projected_lim(s, d).forecast(np.ones(2), 4)
    return s.createDataFrame([(i, k, float(f[i, k])) for i in range(2) for k in range(5)], "state int, step int, x double")


_AHEAD = {"h0": "SELECT sample_idx, a, b FROM z"} | {f"h{k}": f"SELECT sample_idx, g11 * a + g12 * b AS a, g21 * a + g22 * b AS b FROM h{k - 1}, g" for k in range(1, 5)}


@query(
    " UNION ALL ".join(f"SELECT {k} AS step, 0 AS mode, r{{sqrt(avg((h{k}.a - z.a) ** 2))}} AS rmse FROM h{k} JOIN z ON z.sample_idx = h{k}.sample_idx + {k} UNION ALL SELECT {k}, 1, r{{sqrt(avg((h{k}.b - z.b) ** 2))}} FROM h{k} JOIN z ON z.sample_idx = h{k}.sample_idx + {k}" for k in range(1, 5)),
    **_MODEL,
    **_AHEAD,
)
def forecast_verification_projected(s, d):
    return lim.verify(_projected_lim(s, d), _projected(s, d), "mode", "sample_idx", 4, "score")


# -- correlations, members -----------------------------------------------------


@query("SELECT lat, lon, CASE WHEN count(a) = count(*) AND count(b) = count(*) THEN r{corr(a, b)} END AS corr FROM pr GROUP BY 1, 2", pr=_PAIR)
def corr_field(s, d):
    """The correlations whose significance ``corr_significance`` draws."""
    return regress.correlation_significance(_pair(s, d).withColumn("t", F.col("year") * 12 + F.col("month")), ["lat", "lon"], "t").select("lat", "lon", "corr")


_PARTS = "SELECT (year - 1995)::INT AS iteration, month, lat, lon, ens, value AS x FROM cells_ens WHERE value IS NOT NULL"


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Members of monthly fields as iterations of an ensemble."""
    return v.cells_ens(s, d).where("value is not null").select((F.col("year") - 1995).cast("int").alias("iteration"), "month", "lat", "lon", "ens", F.col("value").alias("x"))


@query("SELECT iteration, month, lat, lon, (iteration * 3 + CASE ens WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END)::INT AS ens, r{x} AS x FROM parts WHERE ens IN (0, 2, 4)", parts=_PARTS)
def collate_members(s, d):
    return postprocess.collate(_parts(s, d), [0, 2, 4], 3)


@query("SELECT iteration, month, lat * 1000 + lon AS state, r{avg(x)} AS x FROM parts GROUP BY 1, 2, 3", parts=_PARTS)
def reduced_ensemble_mean(s, d):
    return postprocess.ensemble_mean(_parts(s, d).withColumn("state", F.col("lat") * 1000 + F.col("lon")), ["iteration", "month"])


# -- sources and sinks ---------------------------------------------------------


def _folder(s: SparkSession) -> str:
    """A new folder that all can write to: under ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="isobar-")
    return f"{base}/written/{uuid.uuid4().hex}"


@query("SELECT field, lat, lon, year, month, r{value::FLOAT::DOUBLE} AS value FROM cells")
def sink_years(s, d):
    path = _folder(s)
    io.save_years(v.cells(s, d), path, 3)
    return s.read.parquet(path).select("field", "lat", "lon", "year", "month", F.col("value").cast("double").alias("value"))


@query("SELECT field, lat, lon, year, month, r{value} AS value, TRUE AS first, FALSE AS again FROM cells")
def sink_once(s, d):
    """What is written stays; the second table is not written."""
    path = _folder(s)
    first, again = io.save_once(v.cells(s, d), path), io.save_once(v.tas(s, d), path)
    return s.read.parquet(path).select("*", F.lit(first).alias("first"), F.lit(again).alias("again"))


@query("SELECT iteration, century, year, month, lat, lon, ens, r{x} AS x FROM (SELECT *, (iteration + 1995)::INT AS year, ((iteration + 1995) // 100)::INT AS century FROM parts)", parts=_PARTS)
def sink_states(s, d):
    path = _folder(s)
    io.save_states(_parts(s, d).withColumn("year", F.col("iteration") + 1995), path)
    return s.read.parquet(path)


def _archive(s: SparkSession, d: str) -> str:
    """Monthly fields as files of a catalogue, in degrees Celsius."""
    root = _folder(s)
    for name, table, df in (("tas", "Amon", v.tas(s, d)), ("tos", "Omon", v.tos(s, d))):
        rows = df.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "year", "month", "value", F.lit("degC").alias("units"))
        rows.coalesce(1).write.parquet(f"{root}/M/historical/r1/{table}/{name}/gn/v1")
    return root


@query(
    "SELECT replace(r_name, ' ', '-') AS source_id, 'historical' AS experiment_id, 'r' || (n_nationkey % 3 + 1) || 'i1p1f1' AS member_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Amon' ELSE 'Omon' END AS table_id, CASE WHEN n_nationkey % 2 = 0 THEN 'tas' ELSE 'tos' END AS variable_id, 'gn' AS grid_label, 'v' || (20190000 + n_nationkey) AS version, count(*) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"
)
def source_catalog(s, d):
    """An archive with a dataset for every nation that has customers: which there are, and what they hold, follows from the tables."""
    root = _folder(s)
    n, r = v.read(s, d, "nation"), v.read(s, d, "region")
    k = F.col("n_nationkey")
    path = F.concat_ws("/", F.translate("r_name", " ", "-"), F.lit("historical"), F.concat(F.lit("r"), k % 3 + 1, F.lit("i1p1f1")), F.when(k % 2 == 0, "Amon/tas").otherwise("Omon/tos"), F.lit("gn"), F.concat(F.lit("v"), k + 20_190_000))
    rows = v.read(s, d, "customer").join(F.broadcast(n.join(r, F.col("r_regionkey") == F.col("n_regionkey"))), F.col("c_nationkey") == k)  # 25 nations
    keys = [x["p"] for x in rows.select(path.alias("p")).distinct().collect()]
    kept = rows.select(path.alias("p"), "c_acctbal").persist()
    for p in keys:
        kept.where(F.col("p") == p).select("c_acctbal").coalesce(1).write.parquet(f"{root}/{p}")
    kept.unpersist()
    found = io.build_catalog(s, root)
    held = s.read.parquet(*[r["path"] for r in found.select("path").collect()]).groupBy(F.input_file_name().alias("file")).count()
    names = ["source_id", "experiment_id", "member_id", "table_id", "variable_id", "grid_label", "version"]
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    return found.join(held, tail(F.col("path")) == tail(F.col("file"))).groupBy(*names).agg(F.sum("count").alias("customers"))


@query("SELECT field, lat, lon, year, month, r{value + 273.15e0} AS value, 'K' AS units FROM cells WHERE year BETWEEN 1996 AND 1999")
def source_fields(s, d):
    out = io.load_fields(io.build_catalog(s, _archive(s, d)), "M", "historical", ["tas", "tos"], (1996, 1999))
    return out.select("field", "lat", "lon", "year", "month", "value", "units")


@query("SELECT year, month, CASE WHEN month = 2 AND year = 1997 THEN NULL ELSE r{avg(value)} END AS value FROM tas GROUP BY 1, 2")
def source_monthly_csv(s, d):
    """Twelve files, one a month; -9999 stands for a missing value."""
    path = _folder(s)
    mean = v.tas(s, d).groupBy("year", "month").agg(F.round(F.avg("value"), 9).alias("value")).withColumn("value", F.when((F.col("month") == 2) & (F.col("year") == 1997), -9999.0).otherwise(F.col("value")))
    mean.select("year", F.col("month").alias("mo"), F.col("value").alias("index"), F.col("month").alias("file")).repartition(1).write.partitionBy("file").option("header", "true").csv(path)
    return io.load_monthly_csv(s, [f"{path}/file={m}" for m in range(1, 13)], "index")


@query("SELECT n_nationkey::DOUBLE AS nation, n_regionkey::DOUBLE AS region, CASE WHEN n_nationkey % 7 > 0 THEN n_nationkey / 4 END AS share FROM nation")
def source_fixed_text(s, d):
    path = _folder(s)
    k, or_none = F.col("n_nationkey"), lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    lines = v.read(s, d, "nation").select(F.lit(2).alias("at"), k.alias("k"), F.concat_ws("\t", or_none(k), or_none(F.col("n_regionkey")), or_none(F.when(k % 7 > 0, k / 4))).alias("value"))
    head = s.createDataFrame([(0, None, "# a table"), (1, None, "nation region share")], lines.schema)
    # One file, its head first: the task that writes it sorts, as a shuffle keeps no order.
    head.unionByName(lines).repartition(1).sortWithinPartitions("at", "k").select("value").write.text(path)
    return io.load_fixed_text(s, path, ["nation", "region", "share"], skip=2, sep="\t")


@query("SELECT field, lat, lon, year, month, r{CASE field WHEN 'tas' THEN 2 * value ELSE value END} AS value FROM (SELECT field, lat, (lon + 180) % 360 AS lon, year + 1 AS year, month, value FROM cells) WHERE year BETWEEN 1997 AND 2000")
def source_dataset(s, d):
    """A product by its specification: names, scale, years and longitudes."""
    root = _folder(s)
    wide = _pair(s, d).select(F.col("lat").alias("nlat"), (F.col("lon") - 180).alias("nlon"), "year", "month", F.col("a").alias("T2M"), F.col("b").alias("tos"))
    wide.write.parquet(f"{root}/product")
    spec = io.DatasetSpec("product", renames={"T2M": "tas"}, scale={"tas": 2.0}, fields=("tas", "tos"), year_offset=1, wrap_lon=True, keep_years=(1997, 2000))
    return io.load_dataset(s, root, "product", spec).select("field", "lat", "lon", "year", "month", "value")


@query("SELECT lat, lon, year, month, r{a} AS a, r{b} AS b FROM pr", pr=_PAIR)
def merge_exact(s, d):
    keys = ["lat", "lon", "year", "month"]
    return io.merge_exact(v.tas(s, d).select(*keys, F.col("value").alias("a")), v.tos(s, d).select(*keys, F.col("value").alias("b")), keys)


_ERUPTIONS = "SELECT event_id, day(ts)::INT AS year, value AS vssi FROM events"


@query("SELECT event_id, year, r{vssi} AS vssi FROM er WHERE vssi >= 20 AND (event_id % 2 = 0 AND year < 15 OR event_id % 2 = 1 AND year >= 15)", er=_ERUPTIONS)
def combined_eruptions(s, d):
    e = v.read(s, d, "events").select("event_id", F.dayofmonth("ts").alias("year"), F.col("value").alias("vssi"))
    return io.combined_eruptions(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), 20.0, 15)


@query("SELECT path, year FROM (SELECT 'run.cam.h0.' || y || '-01.nc' AS path, y::INT AS year FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) WHERE year BETWEEN 1996 AND 1998")
def source_files_of_years(s, d):
    y = v.read(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return io.files_of_years(y.select(F.concat(F.lit("run.cam.h0."), F.col("year"), F.lit("-01.nc")).alias("path"), "year"), 1996, 1998)
