import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import scalar as sc
from isobar.functions import timeaxis as ta
from isobar.operators import enkf, indices, lim, linear, proxies, reduce, regress, resample, signal, spatial, vertical
from isobar.operators.mapper import Mapper


def seasonal(spark, values, y0=0):
    return spark.createDataFrame([("f", 0.0, 0.0, y0 + k // 4, k % 4, float(v)) for k, v in enumerate(values)], "field string, lat double, lon double, year int, season int, value double")


def by_year(df):
    return [(r["year"], r["value"]) for r in df.orderBy("year").collect()]


def values(df):
    return [v for _, v in by_year(df)]


# -- the seasonal fixtures --------------------------------------------------


@pytest.mark.parametrize(("seasons", "want"), [([0], [1] * 3), ([1], [2] * 3), ([2], [3] * 3), ([3], [4] * 3), ([0, 1], [1.5] * 3), ([1, 2], [2.5] * 3), ([2, 3], [3.5] * 3), ([3, 0], [2.5] * 2)])
def test_annualize_constant_cycle(spark, seasons, want):
    assert values(resample.annualize(seasonal(spark, [1, 2, 3, 4] * 3), seasons)) == want


@pytest.mark.parametrize(("seasons", "want"), [([1, 2, 3, 0], [3.5, 7.5]), ([2, 3, 0, 1], [4.5, 8.5]), ([3, 0], [4.5, 8.5])])
def test_annualize_across_years(spark, seasons, want):
    assert values(resample.annualize(seasonal(spark, range(1, 13)), seasons)) == want


@pytest.mark.parametrize("bad", [[0, 2], [1, 3], [0, 0], [3, 2], [2, 0]])
def test_annualize_rejects_gaps(spark, bad):
    with pytest.raises(ValueError):
        resample.annualize(seasonal(spark, range(12)), bad)


def months(spark, n=60, y0=10, f=lambda t: math.cos(t) + 3 * math.cos(11 * t)):
    return spark.createDataFrame([("f", 0.0, 0.0, y0 + k // 12, k % 12 + 1, f(k / 12)) for k in range(n)], "field string, lat double, lon double, year int, month int, value double")


def test_annual_of_monthly_is_annual_of_seasonal(spark):
    m = months(spark)
    direct = dict(by_year(resample.average_annually_monthly(m)))
    through = dict(by_year(resample.average_annually_seasonal(resample.average_seasonally(m))))
    assert direct and all(abs(direct[y] - through[y]) < 0.02 for y in direct.keys() & through.keys())


def test_incomplete_ends_go_and_gaps_stay(spark):
    m = months(spark, 30).where("not (year = 11 and month = 4)")
    got = [(r["year"], r["season"]) for r in resample.average_seasonally(m).orderBy("year", "season").collect()]
    assert got[0] == (10, 1) and (11, 1) in got and got[-1] == (12, 1)


def test_missing_months_keep_their_weight(spark):
    m = months(spark, 12, 2001, lambda t: 1.0).withColumn("value", F.when(F.col("month") != 4, F.col("value")))
    got = {r["season"]: r["value"] for r in resample.average_seasonally(m).collect()}
    assert got[2] == pytest.approx(1.0) and got[1] == pytest.approx(31 / (92 / 3))


def test_anomalies_have_no_mean_and_given_climatology_is_used(spark):
    s = seasonal(spark, np.random.default_rng(0).normal(size=40))
    a = resample.anomalize(s, "season")
    assert all(abs(r["m"]) < 1e-12 for r in a.groupBy("season").agg(F.avg("value").alias("m")).collect())
    given = spark.createDataFrame([("f", 0.0, 0.0, q, 1.0) for q in range(4)], "field string, lat double, lon double, season int, climatology double")
    assert resample.anomalize(s, "season", given=given).agg(F.sum("value")).first()[0] == pytest.approx(s.agg(F.sum("value")).first()[0] - 40)


def test_period_is_half_open_unless_closed(spark):
    s = seasonal(spark, range(16)).where("season = 0")
    half = resample.climatology(s, None, period=(0, 2)).first()["climatology"]
    closed = resample.climatology(s, None, period=(0, 2), closed=True).first()["climatology"]
    assert (half, closed) == (2.0, 4.0)


def test_stitch_fills_a_gap_and_rejects_a_long_one(spark):
    s = seasonal(spark, range(40))
    early, late = s.where("year < 5"), s.where("year * 4 + season > 20")
    out = resample.stitch(early, late, ["field", "lat", "lon"], shift=False)
    assert out.count() == 40 and out.where("year = 5 and season = 0").first()["value"] == 20.0
    with pytest.raises(Exception, match="gap"):
        resample.stitch(early, s.where("year > 7"), ["field", "lat", "lon"]).collect()


# -- detrending and regression ----------------------------------------------


def test_detrend_lines(spark):
    df = spark.createDataFrame([(i, float(t), (i + 1) * t + 2.0) for i in range(4) for t in range(10)], "state int, t double, value double")
    assert all(abs(r["value"]) < 1e-9 for r in regress.detrend(df, "t", ["state"]).collect())
    quad = df.withColumn("value", F.col("t") ** 2)
    assert all(abs(r["value"]) < 1e-6 for r in regress.detrend(quad, "t", ["state"], degree=2).collect())


def test_detrend_by_season(spark):
    s = seasonal(spark, [v for k in range(10) for v in (0, 0, 0, k + 1)]).withColumn("t", ta.season_to_decimal(F.col("year"), F.col("season")))
    assert all(abs(r["value"]) < 1e-9 for r in regress.detrend(s, "t", ["season"]).collect())


def test_weighted_mean_of_a_constant(spark):
    df = spark.createDataFrame([(float(a), float(b), 7.0 if a != 30 else None) for a in (-60, 0, 30, 60) for b in (0, 90)], "lat double, lon double, value double")
    assert reduce.area_weighted_mean(df, []).first()[0] == pytest.approx(7.0)
    assert {r["region"]: round(r["value"], 9) for r in reduce.regional_means(df.withColumn("k", F.lit(1)), ["k"]).collect()} == {"global": 7.0, "nh": 7.0, "sh": 7.0}


def test_empty_and_all_missing_tables(spark):
    df = seasonal(spark, [1, 2, 3, 4]).withColumn("value", F.lit(None).cast("double"))
    assert reduce.area_weighted_mean(df, ["year"]).first()["value"] is None
    assert resample.average_annually_seasonal(df).first()["value"] is None
    assert resample.annualize(df.limit(0), [0, 1]).count() == 0
    assert vertical.sea_ice(df, ["year"], 2, 2).first()["area_n"] == 0.0


# -- space ------------------------------------------------------------------


@pytest.mark.parametrize(("at", "want"), [((30.0, 45.0), (30.0, 45.0)), ((27.0, 50.0), (30.0, 45.0)), ((30.0, 14.999), (30.0, 15.0)), ((-29.0, 22.0), (-30.0, 15.0))])
def test_nearest_gridpoint(spark, at, want):
    grid = spark.createDataFrame([(float(a), float(b)) for a in (-30, 0, 30, 60) for b in (15, 30, 45, 60)], "lat double, lon double")
    site = spark.createDataFrame([(1, *at)], "pid int, lat double, lon double")
    r = spatial.nearest_gridpoint(site, grid).first()
    assert (r["grid_lat"], r["grid_lon"]) == want


def test_gaspari_cohn(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 500, 1000, 1500, 2000, 3000)], "d double")
    got = [r[0] for r in df.select(sc.gaspari_cohn(F.col("d"), 2000.0)).collect()]
    assert got[0] == 1 and got[2] == pytest.approx(5 / 24) and got[4] == pytest.approx(0, abs=1e-12) and got[5] == 0
    assert (np.diff(got) < 1e-12).all()


def test_conservative_weights_keep_the_mean(spark):
    src = spatial.regular_grid(spark, -90, 90, 30, 0, 360, 45)
    dst = spatial.regular_grid(spark, -90, 90, 20, 0, 360, 30)
    field = src.withColumn("value", F.col("lat") + F.cos(F.radians("lon")))
    out = spatial.regrid(field, spatial.conservative_weights(src, dst, 30, 45, 20, 30), [])
    mean = lambda df, h: df.agg(F.sum(F.col("value") * (F.sin(F.radians(F.col("lat") + h)) - F.sin(F.radians(F.col("lat") - h)))) / F.sum(F.sin(F.radians(F.col("lat") + h)) - F.sin(F.radians(F.col("lat") - h)))).first()[0]
    assert out.count() == dst.count() and mean(out, 10) == pytest.approx(mean(field, 15), abs=1e-9)


def test_bilinear_weights_reproduce_a_plane(spark):
    src = spatial.regular_grid(spark, -90, 90, 10, 0, 360, 10)
    at = spark.createDataFrame([(12.0, 33.0), (-41.0, 200.5)], "lat double, lon double")
    out = spatial.regrid(src.withColumn("value", F.col("lat") + 0.1 * F.col("lon")), spatial.bilinear_weights(src, at, 10, 10), [])
    assert all(r["value"] == pytest.approx(r["lat"] + 0.1 * r["lon"]) for r in out.collect())


def test_regular_grid_checks_its_arguments(spark):
    assert spatial.regular_grid(spark, -90, 90, 2, -1, 359, 2).count() == 16_200
    with pytest.raises(ValueError):
        spatial.regular_grid(spark, -90, 90, 7, 0, 360, 2)


# -- signal -----------------------------------------------------------------


def response(sections, f, fs):
    z = np.exp(2j * np.pi * f / fs)
    return np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections])


@pytest.mark.parametrize(("kind", "cut", "passes", "stops"), [("low", 0.1, 0.01, 0.4), ("high", 0.1, 0.4, 0.01), ("band", (0.05, 0.2), 0.1, 0.45)])
def test_butterworth_response(kind, cut, passes, stops):
    s = signal.butterworth(3, cut, 1.0, kind)
    assert abs(response(s, passes, 1.0)) == pytest.approx(1, abs=2e-2) and abs(response(s, stops, 1.0)) < 0.02
    for c in np.atleast_1d(cut):
        assert abs(response(s, c, 1.0)) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert all(np.abs(np.roots(a[: np.flatnonzero(a)[-1] + 1])).max() < 1 for _, a in s)


def test_zero_phase_keeps_a_slow_wave_and_drops_a_fast_one():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 80), np.sin(2 * np.pi * t / 4)
    y = signal.zero_phase(signal.butterworth(3, 1 / 20, 1.0, "low"), slow + fast)
    assert np.abs(y - slow)[60:-60].max() < 1e-3
    assert np.allclose(signal.zero_phase(signal.butterworth(3, 0.1, 1.0, "low"), np.full(50, 3.0)), 3.0)


def test_multitaper_finds_the_peak_and_keeps_the_variance():
    x = signal.ar1_sinusoid(1024, 0.0, 16, 3.0, 1)
    f, p = signal.multitaper(x, 1.0)
    assert abs(f[p.argmax()] - 1 / 16) < 0.006 and p.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=0.15)
    tapers, lam = signal.slepian_tapers(128, 4.0, 7)
    assert np.allclose(tapers @ tapers.T, np.eye(7), atol=1e-8) and lam[0] > 0.999 and (np.diff(lam) < 0).all()


@pytest.mark.parametrize("n", [16, 127, 400])
def test_tapers_are_the_eigenvectors(n):
    k = np.arange(n)
    off = k[1:] * (n - k[1:]) / 2.0
    value, vec = np.linalg.eigh(np.diag(((n - 1 - 2 * k) / 2.0) ** 2 * math.cos(8 * math.pi / n)) + np.diag(off, 1) + np.diag(off, -1))
    tapers, _ = signal.slepian_tapers(n, 4.0, 7)
    assert np.allclose(np.abs(tapers), np.abs(vec[:, ::-1][:, :7].T), atol=1e-9)


def test_tapers_of_a_long_series():
    tapers, lam = signal.slepian_tapers(13_944, 4.0, 7)
    assert np.allclose(tapers @ tapers.T, np.eye(7), atol=1e-7) and (np.diff(lam) < 1e-9).all()
    assert signal.slepian_tapers(13_944, 4.0, 7)[0] is tapers


def test_adaptive_weights_keep_leakage_out():
    t = np.arange(512)
    x = 1e3 * np.sin(2 * np.pi * 0.1 * t) + np.random.default_rng(0).normal(size=512)
    f, even = signal.multitaper(x, 1.0, adaptive=False)
    far = (f > 0.3) & (f < 0.5)
    truth = 2.0
    assert abs(np.median(signal.multitaper(x, 1.0)[1][far]) - truth) < abs(np.median(even[far]) - truth)
    assert np.allclose(signal.multitaper(np.full(64, 2.0), 1.0)[1], 0)


@pytest.mark.parametrize("n", [1, 5, 64, 65, 300])
def test_filter_blocks_equal_the_recurrence(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in signal.butterworth(3, (0.05, 0.2), 1.0, "band"):
        z1, z2, out = 0.3, -0.2, []
        for v in x:
            y = b[0] * v + z1
            z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
            out.append(y)
        assert np.allclose(signal._run(b, a, x, [0.3, -0.2]), out, atol=1e-12)


def test_lanczos_filter(spark):
    t = np.arange(400)
    slow = np.sin(2 * np.pi * t / 80)
    assert np.abs(signal.lanczos(slow + np.sin(2 * np.pi * t / 4), 1 / 20) - slow)[60:-60].max() < 1e-3
    df = spark.createDataFrame([(1, float(k), 3.0) for k in range(50)], "k int, t double, value double")
    assert {round(r["value"], 9) for r in signal.lowpass_filter(df, ["k"], "t", 10.0, method="lanczos").collect()} == {3.0}
    with pytest.raises(ValueError, match="named"):
        signal.lowpass_filter(df, ["k"], "t", 10.0, method="other")


def test_f_quantile():
    x = signal.f_quantile_2(0.95, 14)
    assert 1 - (1 + 2 * x / 14) ** -7 == pytest.approx(0.95)


# -- columns ----------------------------------------------------------------


def fold(levels):
    total = block = 0.0
    for c in levels:
        if c is not None and c > 0:
            block = max(block, c)
        else:
            total, block = total + block - total * block, 0.0
    return total + block - total * block


@pytest.mark.parametrize("levels", [[0.2, 0.5, 0, 0.3], [0.0], [1.0, 0, 1.0], [0.1, None, 0.4, 0.4], [0.3] * 5])
def test_cloud_overlap(spark, levels):
    df = spark.createDataFrame([(1, 100_000.0 - 10_000 * k, None if c is None else float(c)) for k, c in enumerate(levels)], "cell int, lev double, value double")
    got = {o: vertical.cloud_fraction(df, ["cell"], o).first()["value"] for o in ("max", "min", "random", "maxrandom")}
    assert got["maxrandom"] == pytest.approx(fold(levels)) and got["max"] <= got["maxrandom"] + 1e-12 <= got["random"] + 2e-12 <= got["min"] + 3e-12


def test_vertical_interpolation(spark):
    df = spark.createDataFrame([(1, p, math.log(p)) for p in (100_000.0, 50_000.0, 10_000.0)], "cell int, p double, value double")
    got = {r["lev"]: r["value"] for r in vertical.interpolate_log_pressure(df, ["cell"], [100_000, 70_000, 10_000, 5_000]).collect()}
    assert got[70_000.0] == pytest.approx(math.log(70_000)) and got[10_000.0] == pytest.approx(math.log(10_000)) and got[5_000.0] is None


# -- observation models -----------------------------------------------------


def test_calibration_recovers_a_line(spark):
    rng = np.random.default_rng(52_561_561)
    x = rng.uniform(0, 10, 1000)
    y = 3 + 5 * x + rng.normal(0, 0.8, 1000)
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "pid int, year int, x double, value double")
    r = proxies.calibrate(df, ["pid"], ["year"]).first()
    e = y - np.polyval(np.polyfit(x, y, 1), x)
    acor = (e[1:] * e[:-1]).sum() / 999 / e.var()
    assert round(r["intercept"], 0) == 3 and round(r["slope"], 1) == 5 and r["err_std"] == pytest.approx(e.std()) and r["acor"] == pytest.approx(acor)
    assert r["bic"] == pytest.approx(1000 * math.log(e.var()) + 3 * math.log(1000)) and r["corr"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_forward_model_values(spark):
    models = spark.createDataFrame([(1, 5.0, 3.0)], "pid int, slope double, intercept double")
    truth = spark.createDataFrame([(1, float(x)) for x in np.linspace(0, 10, 20)], "pid int, x double")
    got = [r["estimated"] for r in proxies.forward(models, truth, ["pid"]).orderBy("x").collect()]
    assert np.allclose(got, 3 + 5 * np.linspace(0, 10, 20))


def test_split_is_seeded_and_whole(spark):
    sites = spark.createDataFrame([(f"p{k}", k) for k in range(50)], "pid string, n int").repartition(4)
    draw = lambda seed=0: {r["pid"] for r in proxies.split_sites(sites, 0.8, seed).where("assimilated").collect()}
    assert proxies.split_sites(sites, 0.8).count() == 50
    assert len(draw()) == 40 and draw() == draw() != draw(1)
    assert proxies.split_sites(sites, 0.0).where("assimilated").count() == 0 and proxies.split_sites(sites, 1.0).where("assimilated").count() == 50
    members = spark.createDataFrame([(e, k) for e in range(9) for k in range(3)], "ens int, k int")
    some = [sorted({r["ens"] for r in proxies.subsample(members, 4, seed).collect()}) for seed in (0, 0, 1)]
    assert len(some[0]) == 4 and some[0] == some[1] != some[2] and proxies.subsample(members, 4).count() == 12


# -- linear models ----------------------------------------------------------


def matrix(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "state int, sample long, x double")


@pytest.mark.parametrize("shape", [(5, 40), (30, 8)])
def test_eof_equals_svd(spark, shape):
    m = np.random.default_rng(1).normal(size=shape)
    fit = linear.eof_fit(matrix(spark, m), ["state"], ["sample"], 4)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(fit.s, s[:4]) and np.allclose(np.abs(fit.u.T @ u[:, :4]), np.eye(4), atol=1e-8)
    assert fit.total_variance == pytest.approx(m.var(axis=1, ddof=1).sum())


def test_varimax_is_orthogonal_and_simplifies():
    rng = np.random.default_rng(0)
    load = rng.normal(size=(20, 3))
    out = linear.varimax(load)
    q = np.linalg.lstsq(load, out, rcond=None)[0]
    assert np.allclose(q.T @ q, np.eye(3), atol=1e-6) and (out**2).var(0).sum() >= (load**2).var(0).sum() - 1e-9


def var1(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    g = np.array([[0.8, 0.1, 0], [-0.1, 0.7, 0.1], [0, 0, 0.5]])
    x = np.zeros((3, n))
    for k in range(1, n):
        x[:, k] = g @ x[:, k - 1] + rng.normal(size=3)
    return g, x - x.mean(1, keepdims=True)


def test_lim_recovers_its_dynamics(spark):
    g, x = var1()
    m = lim.fit(matrix(spark, x), "state", "sample", 0.25)
    assert np.abs(m.g - g).max() < 0.06
    f = m.forecast(np.ones(3), 3)
    assert np.allclose(f[:, 3], np.linalg.matrix_power(m.g, 3) @ np.ones(3))
    sim = m.simulate(np.zeros((3, 4000)), 40, 90, np.random.default_rng(0))
    assert np.allclose(sim[:, :, -1].var(1), x.var(1), rtol=0.15)
    back = lim.Lim.from_json(m.to_json())
    assert np.allclose(back.l, m.l) and np.allclose(back.q_values, m.q_values)
    with pytest.raises(ValueError, match="grow"):
        lim.Lim.from_covariances(np.eye(2), 1.1 * np.eye(2), 0.25)


def test_ensrf_limits_and_table_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 30))
    y = x[1] + 0.5 * x[2]
    assert np.allclose(enkf.ensrf(x, 1.0, y, 1e9), x, atol=1e-6)
    assert np.allclose(enkf.ensrf(x, 1.0, y, 0.5, np.ones(5)), enkf.ensrf(x, 1.0, y, 0.5))
    exact = enkf.ensrf(x, 1.0, x[0], 1e-9)
    assert np.allclose(exact[0], 1.0, atol=1e-6)
    df = matrix(spark, x).withColumnRenamed("sample", "ens").withColumnRenamed("x", "value")
    est = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "ens long, y double")
    got = enkf.update(df, est, 1.0, 0.5, ["state"]).toPandas().pivot(index="state", columns="ens", values="value").to_numpy()
    assert np.allclose(got, enkf.ensrf(x, 1.0, y, 0.5))


def test_time_filters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 25, 3))
    one = lambda z: z[0]
    avg = enkf.assimilate_time_average(x, [0.7], [one], [0.4], [[0, 1, 2]])
    assert np.allclose(avg.mean(2), enkf.ensrf(x.mean(2), 0.7, x[0].mean(1), 0.4))
    assert np.allclose(avg - avg.mean(2, keepdims=True), x - x.mean(2, keepdims=True))
    single = enkf.assimilate_time_stack(x, [0.7], [one], [0.4], [[1]])
    assert np.allclose(single[:, :, 1], enkf.ensrf(x[:, :, 1], 0.7, x[0, :, 1], 0.4)) and np.allclose(single[:, :, [0, 2]], x[:, :, [0, 2]])
    assert np.allclose(enkf.inflate(x[:, :, 0], 4.0).std(1), 2 * x[:, :, 0].std(1))


@pytest.mark.parametrize("options", [{}, {"k_direct": {"b": 5}, "separate_mean": True}, {"by_season": True, "separate_mean": True}])
def test_mapper_projects(spark, options):
    rng = np.random.default_rng(6)
    rows = [(f, lat, lon, y, q, float(rng.normal() * (1 + q) + 0.3 * y)) for f in ("a", "b") for lat in (-40.0, 0.0, 40.0) for lon in (0.0, 120.0) for y in range(8) for q in range(4)]
    df = spark.createDataFrame(rows, "field string, lat double, lon double, year int, season int, value double")
    m = Mapper(k=3, l=3, **options).fit(df, ["year", "season"])
    red = m.forward(df, ["year", "season"])
    assert red.select("state").distinct().count() == m.n_reduced
    once = m.backward(red, ["year", "season"])
    twice = m.backward(m.forward(once, ["year", "season"]), ["year", "season"])
    a = {tuple(r)[:5]: r["value"] for r in once.select("field", "lat", "lon", "year", "season", "value").collect()}
    b = {tuple(r)[:5]: r["value"] for r in twice.select("field", "lat", "lon", "year", "season", "value").collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-8
    if not options:
        full = Mapper(k=6, l=12).fit(df, ["year", "season"])
        back = full.backward(full.forward(df, ["year", "season"]), ["year", "season"])
        assert back.join(df.withColumnRenamed("value", "v"), ["field", "lat", "lon", "year", "season"]).agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 1e-8


def test_indices_of_a_uniform_warming_are_flat(spark):
    rows = [(t, float(lat), float(lon), float(t)) for t in range(3) for lat in range(-60, 75, 15) for lon in range(0, 360, 30)]
    df = spark.createDataFrame(rows, "t int, lat double, lon double, value double")
    for f in (indices.amo, indices.ipo_tripole):
        assert all(abs(r[1]) < 1e-12 for r in f(df, ["t"]).collect())
