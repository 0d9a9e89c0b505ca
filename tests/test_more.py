import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import harmonics, linear
from isobar.operators.lim import Lim
from isobar.operators.mapper import Mapper
from isobar.plans import assimilate
from isobar.streaming import seasonal


def grid(n=12):
    lat, lon = np.meshgrid(np.arange(-90 + 90 / n, 90, 180 / n), np.arange(0, 360, 180 / n), indexing="ij")
    return lat.ravel(), lon.ravel()


def test_harmonics_are_orthonormal():
    x, w = np.polynomial.legendre.leggauss(20)
    lon = np.arange(40) * 9.0
    lat = np.degrees(np.arcsin(x))
    y, degree = harmonics.basis(np.repeat(lat, 40), np.tile(lon, 20), 6)
    gram = y.T @ (y * (np.repeat(w, 40) * 2 * np.pi / 40)[:, None])
    assert np.allclose(gram, np.eye(len(degree)), atol=1e-10) and len(degree) == 49


def test_truncation_keeps_low_degrees_and_spectrum_sees_them(spark):
    lat, lon = grid()
    v = 2 * np.sin(np.radians(lat)) + np.cos(np.radians(lat)) * np.cos(np.radians(lon))
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(lat, lon, v, strict=True)], "t int, lat double, lon double, value double")
    out = harmonics.truncate(df, ["t"], 5).toPandas()
    assert len(out) == 6 * 9
    assert np.allclose(out["value"], 2 * np.sin(np.radians(out["lat"])) + np.cos(np.radians(out["lat"])) * np.cos(np.radians(out["lon"])), atol=1e-8)
    power = harmonics.spectrum(df, ["t"], 5).orderBy("degree").toPandas()["power"]
    assert power[1] == pytest.approx(4 / 3 + 1 / 3) and power.drop(1).abs().max() < 1e-12
    with pytest.raises(Exception, match="gaps"):
        harmonics.spectrum(df.withColumn("value", F.when(F.col("lat") > 0, F.col("value"))), ["t"], 5).collect()


@pytest.mark.parametrize("options", [{}, {"k_direct": {"b": 4}, "separate_mean": True}])
def test_matrices_equal_the_tables(spark, options):
    rng = np.random.default_rng(6)
    rows = [(f, lat, lon, y, float(rng.normal() + 0.3 * y)) for f in ("a", "b") for lat in (-40.0, 0.0, 40.0) for lon in (0.0, 120.0) for y in range(15)]
    df = spark.createDataFrame(rows, "field string, lat double, lon double, year int, value double")
    m = Mapper(k=3, l=3, **options).fit(df, ["year"])
    places, forward, backward = m.matrices()
    x = df.toPandas().set_index(["field", "lat", "lon", "year"])["value"].unstack("year").loc[places].to_numpy()
    red = m.forward(df, ["year"]).toPandas().pivot(index="state", columns="year", values="x").to_numpy()
    assert np.allclose(forward @ x, red)
    back = m.backward(m.forward(df, ["year"]), ["year"]).toPandas().set_index(["field", "lat", "lon", "year"])["value"].unstack("year").loc[places].to_numpy()
    assert np.allclose(backward @ red, back)


@pytest.mark.parametrize("mode", ["instantaneous", "average", "stack"])
def test_physical_space_cycle_localises(spark, mode):
    n = 4
    space = assimilate.Physical(np.eye(n), np.eye(n), np.array([0.0, 1.0, 60.0, -60.0]), np.array([0.0, 0.0, 180.0, 180.0]), 2000.0)
    lim = Lim.from_covariances(np.eye(n), 0.95 * np.eye(n), 0.25)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1, 30))
    x0 = np.repeat(base, n, axis=0) + 0.01 * rng.normal(size=(n, 30))  # all rows vary together
    due = spark.createDataFrame([(0, 1, 5.0, 1.0, 0.0, 0.01, 0, [0])], "step int, pid long, obs double, slope double, intercept double, err_std double, at int, back array<int>")
    out = assimilate.reconstruct(due, 1, x0, lim, 0, 0, mode=mode, substeps=5, space=space)
    m = {r["state"]: r["m"] for r in out.where("season = 0").groupBy("state").agg(F.avg("posterior").alias("m")).collect()}
    assert m[0] == pytest.approx(5, abs=0.1) and m[1] == pytest.approx(5, abs=0.2) and abs(m[2] - x0[2].mean()) < 1e-6 and abs(m[3] - x0[3].mean()) < 1e-6
    with pytest.raises(Exception, match="seasonal"):
        annual = due.withColumn("back", F.array(F.lit(0), F.lit(1))).withColumn("step", F.lit(2))
        assimilate.reconstruct(annual, 1, x0, lim, 0, 0, mode="instantaneous", substeps=5, space=space).collect()


def test_streamed_means_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = seasonal.seasonal_means(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["year"], r["season"]): (round(r["value"], 6), r["n"]) for r in seasonal.means(spark.table("sums"), ["event_type"]).collect()}
    want = {(r["event_type"], 2024, 0): (round(r["v"], 6), r["n"]) for r in events.groupBy("event_type").agg(F.avg("value").alias("v"), F.count("value").alias("n")).collect()}
    assert got == want


def test_states_may_be_many_where_samples_are_few(spark):
    """A grid of two degrees and 40 samples: modes, scores and the way back, against NumPy."""
    rng = np.random.default_rng(2)
    lat, lon, t = np.meshgrid(np.arange(-89.0, 90, 2), np.arange(0.0, 360, 2), np.arange(40), indexing="ij")
    x = (rng.normal(size=(90 * 180, 3)) @ rng.normal(size=(3, 40))).reshape(lat.shape) + 0.01 * rng.normal(size=lat.shape)
    x -= x.mean(2, keepdims=True)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        df = spark.createDataFrame(pd.DataFrame({"lat": lat.ravel(), "lon": lon.ravel(), "year": t.ravel(), "value": x.ravel()})).repartition(8).persist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    fit = linear.eof_fit(df, ["lat", "lon"], ["year"], 3, "value")
    u, s, _ = np.linalg.svd(x.reshape(-1, 40), full_matrices=False)
    assert fit.u.shape == (16_200, 3) and np.allclose(fit.s, s[:3]) and np.allclose(np.abs((fit.u * u[:, :3]).sum(0)), 1)
    cells = df.withColumn("field", F.lit("tas")).withColumn("season", F.lit(0))
    m = Mapper(k=3, l=3, by_season=True).fit(cells, ["year", "season"])
    back = m.backward(m.forward(cells, ["year", "season"]), ["year", "season"]).join(cells.withColumnRenamed("value", "truth"), ["field", "lat", "lon", "year", "season"])
    r = back.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("value") - F.col("truth"))).alias("e")).first()
    assert r["n"] == 16_200 * 40 and r["e"] < 0.2
    df.unpersist()
