import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.functions.scalar import EARTH_RADIUS_M
from isobar.operators import proxies, reduce
from isobar.operators.lim import Lim
from isobar.plans import assimilate, postprocess
from isobar.sources import io


def still(n=3):
    """Dynamics that forget slowly, nearly without noise."""
    c0 = np.eye(n)
    return Lim.from_covariances(c0, 0.95 * c0, 0.25)


def due(spark, rows):
    return spark.createDataFrame(rows, "step int, pid long, obs double, slope double, intercept double, err_std double, row array<double>, back array<int>")


@pytest.mark.parametrize("mode", ["average", "stack"])
def test_cycle_follows_precise_observations(spark, mode):
    rng = np.random.default_rng(0)
    rows = [(k, 1, float(k), 1.0, 0.0, 1e-3, [1.0, 0.0, 0.0], [0]) for k in range(8)]
    out = assimilate.reconstruct(due(spark, rows), 2, rng.normal(size=(3, 20)), still(), 0, 1, mode=mode, substeps=10)
    assert out.count() == 2 * 8 * 3 * 20
    mean = out.where("state = 0").groupBy("iteration", "year", "season").agg(F.avg("posterior").alias("m")).orderBy("iteration", "year", "season").collect()
    assert all(abs(r["m"] - (4 * r["year"] + r["season"])) < 0.05 for r in mean)


def test_annual_records_update_their_seasons(spark):
    rng = np.random.default_rng(1)
    rows = [(3, 1, 9.0, 1.0, 0.0, 1e-3, [1.0, 0.0, 0.0], [3, 2, 1, 0])]
    out = assimilate.reconstruct(due(spark, rows), 1, rng.normal(size=(3, 20)), still(), 0, 0, substeps=10)
    m = out.where("state = 0").groupBy("season").agg(F.avg("posterior").alias("m")).agg(F.avg("m")).first()[0]
    assert m == pytest.approx(9.0, abs=0.1)


def test_iterations_are_reproducible_and_run_without_records(spark):
    x = np.random.default_rng(1).normal(size=(3, 5))
    none = due(spark, [(0, 1, 1.0, 1.0, 0.0, 1.0, [1.0, 0.0, 0.0], [0])]).limit(0)
    a = assimilate.reconstruct(none, 2, x, still(), 0, 0, substeps=5, inflation=1.1)
    assert a.count() == 2 * 4 * 3 * 5
    assert a.agg(F.sum("posterior")).first()[0] == pytest.approx(a.agg(F.sum("posterior")).first()[0])


def test_schedule(spark):
    obs = spark.createDataFrame([(1, 0, 2, 5.0), (2, 0, 3, 7.0), (3, 1, 0, 1.0)], "pid long, year int, season int, value double")
    seasonal = spark.createDataFrame([(1, 2, 1.0, 0.0, 0.1, [1.0])], "pid long, season int, slope double, intercept double, err_std double, row array<double>")
    annual = spark.createDataFrame([(2, 1, 1.0, 0.0, 0.1, [1.0]), (3, 1, 1.0, 0.0, 0.1, [1.0])], "pid long, seasonality int, slope double, intercept double, err_std double, row array<double>")
    got = {r["pid"]: (r["step"], r["back"]) for r in assimilate.schedule(obs, seasonal, annual, 0, 1).collect()}
    # Seasonality 1 begins in the autumn before: impossible in the first year.
    assert got == {1: (2, [0]), 3: (6, [3, 2, 1, 0])}
    twice = obs.unionByName(obs.where("pid = 1"))
    with pytest.raises(Exception, match="several values"):
        assimilate.schedule(twice, seasonal, None, 0, 1).collect()


def test_collate_and_mean(spark):
    rows = [(i, 0, 0, 0, e, float(10 * i + e)) for i in range(2) for e in range(4)]
    df = spark.createDataFrame(rows, "iteration int, year int, season int, state int, ens int, x double")
    out = postprocess.collate(df, [1, 3], 2)
    assert sorted((r["ens"], r["x"]) for r in out.collect()) == [(0, 1.0), (1, 3.0), (2, 11.0), (3, 13.0)]
    assert postprocess.ensemble_mean(out, ["year", "season"]).first()["x"] == 7.0


def test_duplicates_keep_the_longer(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=20)
    sites = spark.createDataFrame([(1, "coral", 1.0, 0.0, 0.0), (2, "coral", 1.0, 1.0, 1.0), (3, "coral", 1.0, 50.0, 0.0), (4, "tree", 1.0, 0.0, 0.0)], "pid long, ptype string, dt double, lat double, lon double")
    obs = spark.createDataFrame([(p, y, 0, float(v[y])) for p in (1, 2, 3, 4) for y in range(20 if p != 2 else 15)], "pid long, year int, season int, value double")
    assert [r["pid"] for r in proxies.duplicates(sites, obs).collect()] == [2]
    full = obs.unionByName(spark.createDataFrame([(2, y, 0, float(v[y])) for y in range(15, 20)], obs.schema))
    assert [r["pid"] for r in proxies.duplicates(sites, full).collect()] == [1]
    assert [r["pid"] for r in proxies.duplicates(sites, full, identical=True, prefer=F.col("pid") == 1).collect()] == [2]


@pytest.mark.parametrize("entries", [1 << 19, 400])
def test_duplicates_equal_all_pairs(spark, monkeypatch, entries):
    """Copies, noise, gaps, a pid listed at two places and near the date line; no join of observations by time."""
    monkeypatch.setattr(proxies, "ENTRIES", entries)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 30))
    sites = [(p, ("coral", "tree")[p % 2], 1.0, float(60 + p % 3), float(179.5 + p % 2 - (360 if p % 7 < 3 else 0))) for p in range(90)] + [(5, "coral", 1.0, 60.0, 179.5), (7, "coral", 1.0, 61.0, 180.0)]
    obs = [(p, y, 0, float(3.0 + base[p % 12, y] * (1 + p % 4) + rng.normal() * (0.0, 0.04, 0.2)[p // 12 % 3])) for p in range(90) for y in range(30) if rng.random() < 0.8 - 0.55 * (p % 5 == 0)]
    obs += [(p, y, 0, v + 0.01) for p, y, _, v in obs if p in (5, 30) and y % 2]
    st = spark.createDataFrame(sites, "pid long, ptype string, dt double, lat double, lon double").repartition(3)
    ob = spark.createDataFrame(obs, "pid long, year int, season int, value double").repartition(5)
    s, o = (pd.DataFrame(r, columns=c) for r, c in ((sites, ["pid", "ptype", "dt", "lat", "lon"]), (obs, ["pid", "year", "season", "value"])))
    n = o.groupby("pid").size()
    pairs = s.merge(s, on=["ptype", "dt"])
    h = np.sin(np.radians(pairs.lat_y - pairs.lat_x) / 2) ** 2 + np.cos(np.radians(pairs.lat_x)) * np.cos(np.radians(pairs.lat_y)) * np.sin(np.radians(pairs.lon_y - pairs.lon_x) / 2) ** 2
    pairs = pairs[(pairs.pid_x < pairs.pid_y) & (2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= 100)]
    want = set()
    for (a, b), g in pairs.groupby(["pid_x", "pid_y"]):
        both = g[["pid_x", "pid_y"]].merge(o.set_axis(["pid_x", "year", "season", "u"], axis=1), on="pid_x").merge(o.set_axis(["pid_y", "year", "season", "v"], axis=1), on=["pid_y", "year"])
        if len(both) >= 10 and np.corrcoef(both.u, both.v)[0, 1] > 0.99:
            want.add(b if n[a] > n[b] else a)
    found = proxies.duplicates(st, ob, min_corr=0.99, max_km=100.0)
    assert {r["pid"] for r in found.collect()} == want and 20 < len(want) < 90
    assert not re.search(r"Join.*year", found._jdf.queryExecution().toString())


# -- sources and sinks --------------------------------------------------------

NOAA = """# Site_Name: Somewhere
# Northernmost_Latitude: 10
# Southernmost_Latitude: 8
# Easternmost_Longitude: 21
# Westernmost_Longitude: 19
## age_CE\tage
## d18O\tisotope
age_CE\td18O
1900\t-4.5
1901\tNaN
1902\t-4.1
"""


def test_noaa_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(NOAA)
    got = [tuple(r)[1:] for r in io.load_noaa(spark, str(tmp_path), "d18O").orderBy("t").collect()]
    assert got == [(1900.0, -4.5, 9.0, 20.0), (1902.0, -4.1, 9.0, 20.0)]


def test_monthly_csv_and_fixed_text(spark, tmp_path):
    for m in (1, 2):
        (tmp_path / f"{m}.csv").write_text(f"year, mo, extent\n1980, {m}, {m}.5\n1981, {m}, -9999\n")
    got = io.load_monthly_csv(spark, [str(tmp_path / f"{m}.csv") for m in (1, 2)], "extent").collect()
    assert [tuple(r) for r in got] == [(1980, 1, 1.5), (1980, 2, 2.5), (1981, 1, None), (1981, 2, None)]
    (tmp_path / "t.txt").write_text("head\n# note\n 1  2.5\n2 x\n")
    assert [tuple(r) for r in io.load_fixed_text(spark, str(tmp_path / "t.txt"), ["a", "b"], 1).collect()] == [(1.0, 2.5), (2.0, None)]


def test_catalog(spark, tmp_path):
    root = tmp_path / "cat"
    df = spark.createDataFrame([(2000, 1, 0.0, 0.0, 10.0, "degC"), (2001, 1, 0.0, 0.0, float("nan"), "degC")], "year int, month int, latitude double, longitude double, value double, units string")
    for member in ("r1", "r2"):
        df.coalesce(1).write.parquet(f"{root}/M/past/{member}/Amon/tas/gn/v1")
    cat = io.build_catalog(spark, str(root))
    assert cat.select("member_id").distinct().count() == 2
    with pytest.raises(ValueError, match="several"):
        io.search_catalog(cat, "M", "past", ["tas"])
    got = io.load_fields(cat, "M", "past", ["tas", "tos"], (2000, 2001), member_id="r1").orderBy("year").collect()
    assert [(r["field"], r["lat"], r["value"], r["units"]) for r in got] == [("tas", 0.0, 283.15, "K"), ("tas", 0.0, None, "K")]
    with pytest.raises(ValueError, match="unknown"):
        io.variables(["nothing"])


def test_datasets(spark, tmp_path):
    depths = "OHC_300m double, OHC_700m double, OHC_2000m double, OHC_full_depth double"
    spark.createDataFrame([(k, 1.0, 2.0, 3.0, float(k) if k else None) for k in range(130)], f"`time (starting 1870)` int, {depths}").write.parquet(str(tmp_path / "zanna.parquet"))
    whole = {r["year"]: r["value"] for r in io.load_dataset(spark, str(tmp_path), "zanna", anomalies=False).where("field = 'ohc'").collect()}
    assert whole[1870] is None and whole[1871] == 1e21 and max(whole) == 1999
    mean = np.mean([(y - 1870) * 1e21 for y in range(1961, 1990)])
    got = {(r["field"], r["year"]): r["value"] for r in io.load_dataset(spark, str(tmp_path), "zanna").collect()}
    assert got["ohc", 1990] == pytest.approx(120e21 - mean) and got["ohc300", 1900] == pytest.approx(0, abs=1e9) and len(got) == 4 * 130
    assert len(io.DATASETS) == 36  # two more are tables of events
    rows = [(y, m, 0.0, -90.0, float(m)) for y in range(1960, 1965) for m in range(1, 13)]
    spark.createDataFrame(rows, "year int, month int, lat double, lon double, tas double").write.parquet(str(tmp_path / "hadcrut.parquet"))
    h = io.load_dataset(spark, str(tmp_path), "hadcrut")
    assert h.select("lon").distinct().first()[0] == 270.0 and abs(h.where("year > 1961").agg(F.avg("value")).first()[0]) < 1.0


def test_sea_ice_products(spark, tmp_path):
    grid = [(y, lat, lon, 100.0 if lat > 0 else 10.0) for y in (1700, 1701) for lat in (-45.0, 45.0) for lon in (0.0, 180.0)]
    spark.createDataFrame(grid, "year int, lat double, lon double, SIC double").write.parquet(str(tmp_path / "dalaiden2023.parquet"))
    got = io.load_dataset(spark, str(tmp_path), "dalaiden2023")
    half = 2 * np.pi * EARTH_RADIUS_M**2 / 1e6
    totals = {r["field"]: r["value"] for r in got.where("year = 1701 and lat is null").collect()}
    assert got.where("lat is not null").agg(F.max("value")).first()[0] == 1.0 and set(totals) == {"siarean", "siareas", "siextentn", "siextents"}
    assert totals["siarean"] == pytest.approx(half) and totals["siareas"] == pytest.approx(half / 10) and totals["siextentn"] == pytest.approx(half) and totals["siextents"] == 0
    for hemisphere, factor in (("north", 1), ("south", 2)):
        (tmp_path / "siindex" / hemisphere).mkdir(parents=True)
        for m in range(1, 13):
            (tmp_path / "siindex" / hemisphere / f"{m:02}.csv").write_text("year, mo, extent, area\n" + "".join(f"{y}, {m}, {factor * (y - 1978)}, -9999\n" for y in range(1979, 2003)))
    index = {(r["field"], r["year"], r["season"]): r["value"] for r in io.load_dataset(spark, str(tmp_path), "siindex").collect()}
    assert index["siextentn", 2000, 2] == pytest.approx(22 - 11.5) and index["siextents", 2000, 2] == pytest.approx(21) and index["siarean", 2000, 2] is None


def test_products_of_members_methods_and_versions(spark, tmp_path):
    spark.createDataFrame([(y, e, float(y), 2.0, 0.0) for y in range(1960, 1992) for e in (1, 2)], "year int, ens int, CPS double, PCR double, `LMRv2.1` double").write.parquet(str(tmp_path / "pages19.parquet"))
    pages = io.load_dataset(spark, str(tmp_path), "pages19")
    assert pages.select("ens").distinct().count() == 4 and pages.count() == 32 * 4 and pages.where("year = 1991").agg(F.max("value")).first()[0] == pytest.approx(1991 - 1975.5)
    for name, k in (("AR6_ERF_1750-2019", 2), ("AR6_ERF_1750-2019_pc05", 1), ("AR6_ERF_1750-2019_pc95", 3)):
        (tmp_path / f"{name}.csv").write_text(f"year,co2,total\n1750,{k}.5,0\n1751,x,1\n")
    erf = {(r["stat"], r["field"], r["year"]): r["value"] for r in io.load_dataset(spark, str(tmp_path), "ar6_erf").collect()}
    assert erf["p05", "co2", 1750] == 1.5 and erf["p95", "co2", 1751] is None and len(erf) == 12
    spark.createDataFrame([(y, 0, n, 50.0, 1.0, float(n)) for y in (1970, 1971) for n in (0, 1)], "year int, nens int, nit int, sic_lalo_ensemble_mean double, si_extent_anomalies double, si_area_anomalies double").write.parquet(str(tmp_path / "brennan22_MPI.parquet"))
    b = io.load_dataset(spark, str(tmp_path), "brennan22", prior="MPI")
    assert b.where("field = 'siconc'").agg(F.avg("value")).first()[0] == pytest.approx(0.5) and b.where("field = 'siarean'").agg(F.max("value")).first()[0] == 0.0
    names = "tas_sfc double, tos_sfc double, rlut_toa double, rsut_toa double, `ohc_0-700m` double"
    spark.createDataFrame([(y, 0.0, 0.0, 1.0, 1.0, 2.0, 1.0, y * 3.0) for y in range(1960, 1992)], f"year int, lat double, lon double, {names}").write.parquet(str(tmp_path / "lmronline/x/spatial_ens_mean"))
    lmr = {r["field"]: r["value"] for r in io.load_dataset(spark, str(tmp_path), "lmronline", anomalies=False, version="x").where("year = 1970").collect()}
    assert lmr["eei"] == -3.0 and lmr["ddtohc700"] == pytest.approx(3.0 / io.SECONDS_A_YEAR) and set(lmr) == set(io.DATASETS["lmronline"].fields)


def test_eruptions(spark, tmp_path):
    head = "".join(f"# {k}\n" for k in range(48)) + "names\n"
    row = lambda y, v: f"{y}\t{y}\t3\t1\t10.5\t1\t1\t{v}\t0.1\t0.5\tX\tno\tr\n"
    (tmp_path / "e.tab").write_text(head + row(1815, 28.1) + row(900, 0.4) + row(536, 18.0) + row(-426, 50.0))
    assert [r["year"] for r in io.load_evolv2k(spark, str(tmp_path / "e.tab")).orderBy("year").collect()] == [536, 900, 1815]
    late = [(1991, 6, 15, 15.0, 17e9 * 64.066 / 32.065), (1850, 1, 1, 0.0, 90e9), (1950, 1, 1, 0.0, 1e8)]
    spark.createDataFrame(late, "year int, month int, day int, lat double, utsvolcemis double").write.parquet(str(tmp_path / "late"))
    both = io.load_combined_eruptions(spark, str(tmp_path / "e.tab"), str(tmp_path / "late")).orderBy("year").collect()
    assert [(r["year"], round(r["vssi"], 6)) for r in both] == [(1815, 28.1), (1991, 17.0)]


def test_names_merge_and_stamp(spark):
    assert io.map_names(["TREFHT", ["SST", "other"]], io.CESM_TO_CF) == ["tas", ["tos", "other"]] and io.map_names("tas", io.CF_TO_CESM) == "TREFHT"
    a, b = spark.createDataFrame([(1, 2.0)], "k int, a double"), spark.createDataFrame([(1, 3.0)], "k int, b double")
    assert io.merge_exact(a, b, ["k"]).first()[:] == (1, 2.0, 3.0)
    with pytest.raises(Exception, match="coordinates"):
        io.merge_exact(a, b.withColumn("k", F.lit(2)), ["k"]).collect()
    t = spark.sql("select timestamp'2001-03-01' as t, timestamp'2001-02-01' as s")
    assert str(t.select(io.fixed_stamp(F.col("t"))).first()[0]) == "2001-02-15 00:00:00" == str(t.select(io.fixed_stamp(F.col("t"), F.col("s"), F.col("t"))).first()[0])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(y, 1.0) for y in range(850, 1100)], "year int, value double")
    io.save_years(df, str(tmp_path / "y"))
    back = spark.read.parquet(str(tmp_path / "y"))
    assert back.count() == 250 and back.select("span").distinct().count() == 3 and dict(back.dtypes)["value"] == "float"
    with pytest.raises(Exception, match="exist"):
        io.save_years(df, str(tmp_path / "y"))
    assert io.save_once(df, str(tmp_path / "o")) and not io.save_once(df, str(tmp_path / "o"))
    m = still()
    io.save_model(spark, str(tmp_path / "m"), m.to_json(), {"tau": 0.25, "state": 3})
    text, meta = io.load_model(spark, str(tmp_path / "m"))
    assert np.allclose(Lim.from_json(text).g, m.g) and meta["state"] == 3
    assert {r["key"] for r in io.describe_run(spark, str(tmp_path / "m")).collect()} == {"tau", "state"}


def test_interval_merge(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (7, 9), (9, 10), (20, 21)], "a int, z int")
    assert sorted(tuple(r) for r in reduce.merge_intervals(df, "a", "z").collect()) == [(1, 5), (7, 10), (20, 21)]


def test_model_output(spark, tmp_path):
    cols = [(2000, m, 10.0, 20.0, lev, c) for m in (1, 2) for lev, c in ((1000.0, 0.2), (800.0, 0.0), (300.0, 0.6))]
    spark.createDataFrame(cols, "year int, month int, lat double, lon double, lev double, value double").write.parquet(str(tmp_path / "atm/month/CLOUD"))
    import datetime

    days = [(datetime.date(2000, m, d), 10.0, 20.0, 1.0 * d, "degC") for m in (1, 2) for d in (1, 2, 3)]
    spark.createDataFrame(days, "date date, lat double, lon double, value double, units string").write.parquet(str(tmp_path / "ocn/day/SST"))
    got = {(r["field"], r["month"]): r["value"] for r in io.load_model_fields(spark, str(tmp_path), ["cldlow", "cldhigh", "tos"]).collect()}
    assert got == {(f, m): pytest.approx(v) for m in (1, 2) for f, v in (("cldlow", 0.2), ("cldhigh", 0.6), ("tos", 275.15))}
    with pytest.raises(ValueError, match="unknown"):
        io.load_model_fields(spark, str(tmp_path), ["nothing"])


def test_derived_fields_and_scaling(spark):
    rows = [(1, f, v) for f, v in (("SOLIN", 340.0), ("FSNT", 240.0), ("FLNT", 239.0), ("FSNTC", 290.0), ("FLNTC", 270.0), ("FLUT", 238.0), ("FSUTOA", 101.0))]
    got = {r["field"]: r["value"] for r in io.derived_fields(spark.createDataFrame(rows, "k int, field string, value double"), ["k"]).collect()}
    assert (got["FSUT"], got["RESTOM"], got["RESTOA"], got["RESTOMC"], got["CRE"], got["FLDT"]) == (100.0, 1.0, 1.0, 20.0, -19.0, 1.0) and "PREC" not in got
    out = io.scaled(spark.createDataFrame([("siconc", 0.5), ("tas", 2.0)], "field string, value double")).collect()
    assert [r["value"] for r in out] == [50.0, 2.0]
