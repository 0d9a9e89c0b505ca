"""Filters in blocks, resumable cycles and Zarr stores."""

import json
import os
import resource
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import enkf, enkf_blocks
from isobar.operators.lim import Lim
from isobar.plans import assimilate, cycle
from isobar.sources import zarr


def _state(rng, rows=60, members=7, steps=1):
    lat, lon = rng.uniform(-80, 80, rows), rng.uniform(0, 360, rows)
    x = rng.normal(size=(rows, members, steps)) + rng.normal(size=(1, members, 1))
    return lat, lon, x


def _frame(spark, lat, lon, x, parts=5):
    return spark.createDataFrame([(k, float(a), float(o), [float(v) for v in r.ravel()]) for k, (a, o, r) in enumerate(zip(lat, lon, x, strict=True))], "key bigint, lat double, lon double, x array<double>").repartition(parts)


def _models(spark, rng, lat, lon, m, times):
    rows = []
    for k in range(m):
        at = int(rng.integers(len(lat)))
        rows.append((k, at, float(rng.uniform(0.5, 2)), float(rng.normal()), float(rng.normal()), float(rng.uniform(0.3, 1)), times(k), float(lat[at]), float(lon[at])))
    return rows, spark.createDataFrame(rows, "k bigint, key bigint, slope double, intercept double, obs double, err_std double, times array<int>, lat double, lon double")


@pytest.mark.parametrize(("steps", "radius"), [(1, None), (1, 6000.0), (4, None), (4, 9000.0)])
def test_blocks_equal_the_serial_filter(spark, steps, radius):
    rng = np.random.default_rng(steps)
    lat, lon, x = _state(rng, steps=steps)
    rows, models = _models(spark, rng, lat, lon, 25, lambda k: [0] if steps == 1 else [[3], [1, 2, 3], [0, 1, 2, 3], [2, 3]][k % 4])
    got = {r["key"]: r["x"] for r in enkf_blocks.assimilate_blocks(_frame(spark, lat, lon, x), models, ["key"], 7, steps, radius).collect()}
    space = assimilate.Physical(None, None, lat, lon, radius)
    psms = [lambda s, r=r: r[3] + r[2] * s[r[1]] for r in rows]
    locs = [space.localization(r[1]) for r in rows] if radius else None
    want = enkf.assimilate_time_average(x, [r[4] for r in rows], psms, [r[5] for r in rows], [r[6] for r in rows], locs)
    for k in range(len(lat)):
        np.testing.assert_allclose(np.array(got[k]), want[k].ravel(), atol=1e-9)


def test_blocks_in_several_calls(spark):
    """A sequence cut in two is the sequence; observations of several rows; none at all."""
    rng = np.random.default_rng(9)
    lat, lon, x = _state(rng)
    rows, models = _models(spark, rng, lat, lon, 10, lambda k: [0])
    both = models.unionByName(models.select("k", ((F.col("key") + 7) % 60).alias("key"), (-F.col("slope") / 3).alias("slope"), *models.columns[3:]))
    state = _frame(spark, lat, lon, x)
    one = enkf_blocks.assimilate_blocks(state, both, ["key"], 7, radius_km=8000.0)
    half = enkf_blocks.assimilate_blocks(state, both.where("k < 4"), ["key"], 7, radius_km=8000.0)
    two = enkf_blocks.assimilate_blocks(half, both.where("k >= 4"), ["key"], 7, radius_km=8000.0)
    a, b = ({r["key"]: r["x"] for r in df.collect()} for df in (one, two))
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a) and len(a) == 60
    assert enkf_blocks.assimilate_blocks(state, both.limit(0), ["key"], 7).collect() == state.collect()
    with pytest.raises(ValueError, match="no row"):
        enkf_blocks.assimilate_blocks(state, models.withColumn("key", F.col("key") + 1000), ["key"], 7)


def test_blocks_of_a_large_state(spark):
    """129,600 rows of 100 members and 60 localised observations: blocks of a few MB, whatever the rows."""
    members = 100
    i = F.col("id")
    wave = [F.sin(i * 0.001 * (m + 1)) + F.cos(i * 0.017 + m) for m in range(members)]
    state = spark.range(129_600, numPartitions=24).select(i.alias("key"), (F.floor(i / 360) * 0.5 - 89.75).alias("lat"), ((i % 360) * 1.0).alias("lon"), F.array(*wave).alias("x"))
    models = spark.createDataFrame([(k, 2000 * k + 37, 1.0, 0.0, 0.4, 0.5, [0], (2000 * k + 37) // 360 * 0.5 - 89.75, (2000 * k + 37) % 360 * 1.0) for k in range(60)], "k bigint, key bigint, slope double, intercept double, obs double, err_std double, times array<int>, lat double, lon double")
    got = enkf_blocks.assimilate_blocks(state, models, ["key"], members, radius_km=5000.0).selectExpr("count(*) n", "sum(size(x)) m", "max(abs(x[0])) top").first()
    assert (got["n"], got["m"]) == (129_600, 12_960_000) and np.isfinite(got["top"])
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 3_000_000  # kB; no worker has more


# -- cycles -------------------------------------------------------------------


def _cycle(spark, path, seed=4, noise=True, inflation=None):
    rng = np.random.default_rng(seed)
    n, modes, members = 12, 3, 6
    lat, lon = np.linspace(-60, 60, n), np.linspace(0, 300, n)
    basis, _ = np.linalg.qr(rng.normal(size=(n, modes)))
    a = np.diag([-0.5, -1.0, -2.0]) + 0.1 * rng.normal(size=(modes, modes))
    lim = Lim(0.25, np.eye(modes), a.astype(complex), np.ones(modes) * (0.3 if noise else 0.0), np.eye(modes), 1.0)
    space = spark.createDataFrame([(k, float(lat[k]), float(lon[k]), basis[k].tolist(), basis[k].tolist()) for k in range(n)], "key bigint, lat double, lon double, f array<double>, b array<double>")
    due = []
    for step in range(9):
        for k in range(3):
            at = int(rng.integers(n))
            back = [0] if k < 2 else [0, 1, 2, 3]
            due.append((step, k, at, 1.0, 0.0, float(rng.normal()), 0.5, back, float(lat[at]), float(lon[at])))
    frame = spark.createDataFrame(due, "step int, k bigint, key bigint, slope double, intercept double, obs double, err_std double, back array<int>, lat double, lon double")
    x0 = rng.normal(size=(n, members))
    initial = spark.createDataFrame([(k, x0[k].tolist()) for k in range(n)], "key bigint, x array<double>")
    run = cycle.PhysicalCycle(spark, path, space, frame, lim, members, radius_km=9000.0, substeps=8, inflation=inflation)
    return run, initial, (x0, due, lim, basis, lat, lon)


def _states(run):
    return {(r["step"], r["key"]): np.array(r["x"]) for r in run.posterior().collect()}


def test_cycle_equals_the_cycle_of_one_task(spark, tmp_path):
    run, initial, (x0, due, lim, basis, lat, lon) = _cycle(spark, str(tmp_path / "a"), noise=False, inflation=1.1)
    run.run(7, initial)
    got = _states(run)
    by_step = {}
    for step, _, at, slope, intercept, obs, err, back, *_ in due:
        by_step.setdefault(step, []).append({"obs": obs, "slope": slope, "intercept": intercept, "err_std": err, "at": at, "back": back})
    space = assimilate.Physical(basis.T, basis, lat, lon, 9000.0)
    want = list(assimilate.run_cycle(x0, by_step, lim, 7, "average", np.random.default_rng(0), 1.1, 8, space))
    assert sorted({k[0] for k in got}) == list(range(7))
    for step, _, after in want:
        for k in range(len(lat)):
            np.testing.assert_allclose(got[step, k], after[k], rtol=2e-6, atol=2e-6)  # kept as floats


def test_cycle_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    whole, initial, _ = _cycle(spark, str(tmp_path / "whole"))
    whole.run(8, initial)
    cut, initial, _ = _cycle(spark, str(tmp_path / "cut"))
    finish = cycle.PhysicalCycle._finish

    def dies(self, step, z):
        if step == 4:
            raise KeyboardInterrupt
        finish(self, step, z)

    monkeypatch.setattr(cycle.PhysicalCycle, "_finish", dies)
    with pytest.raises(KeyboardInterrupt):  # after the state of step 4 is written, before the step is finished
        cut.run(8, initial)
    monkeypatch.setattr(cycle.PhysicalCycle, "_finish", finish)
    again, _, _ = _cycle(spark, str(tmp_path / "cut"))
    assert again.finished() == 3
    again.run(6)
    again.run(8)  # and a run that ended is extended
    a, b = _states(whole), _states(again)
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)
    with pytest.raises(ValueError, match="initial"):
        _cycle(spark, str(tmp_path / "new"))[0].run(3)


def test_states_are_written_once_and_in_order(spark, tmp_path):
    store = cycle.StateStore(spark, str(tmp_path), "posterior")
    rows = spark.createDataFrame([(1, [0.1, 0.2])], "key bigint, x array<double>")
    store.insert(3, rows)
    for step in (3, 2):
        with pytest.raises(ValueError, match="not newer"):
            store.insert(step, rows)
    os.makedirs(tmp_path / "posterior" / "step=00000005")  # an interrupted write
    assert store.steps() == [3] and store.last() == 3
    store.insert(5, rows)
    assert store.steps() == [3, 5] and store.get(5).schema["x"].dataType.simpleString() == "array<float>"
    with pytest.raises(ValueError, match="unknown"):
        store.get(4)


# -- Zarr ---------------------------------------------------------------------


def _fields(spark, years=range(2000, 2007)):
    rows = [(f, y, q, float(a), float(o), None if (y + q + a) % 7 == 0 else y + q / 10 + a + o / 1000) for f in ("tas", "tos") for y in years for q in range(4) for a in (-30, 0, 30) for o in (10, 100, 190, 280)]
    return spark.createDataFrame(rows, "field string, year int, season int, lat double, lon double, value double"), rows


def test_zarr_round_trip_and_layout(spark, tmp_path):
    df, rows = _fields(spark)
    path = str(tmp_path / "store")
    zarr.save_zarr(df.repartition(7), path, {"time": 5, "lat": 2}, double=True, attrs={"title": "t"})
    back = zarr.load_zarr(spark, path)
    assert back.columns == ["field", "year", "season", "lat", "lon", "value"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    meta = json.loads((tmp_path / "store" / "tas" / ".zarray").read_text())
    assert (meta["shape"], meta["chunks"], meta["zarr_format"]) == ([28, 3, 4], [5, 2, 4], 2)
    assert sorted(os.listdir(tmp_path / "store" / "tas")) == sorted([".zarray", ".zattrs"] + [f"{t}.{a}.0" for t in range(6) for a in range(2)])
    assert json.loads((tmp_path / "store" / "tas" / ".zattrs").read_text())["_ARRAY_DIMENSIONS"] == ["time", "lat", "lon"]
    first = np.frombuffer(zlib.decompress((tmp_path / "store" / "tas" / "0.0.0").read_bytes()), "<f8").reshape(5, 2, 4)
    assert first[1, 0, 2] == next(r[5] for r in rows if r[:5] == ("tas", 2000, 1, -30.0, 190.0))
    assert not [n for n in os.listdir(tmp_path / "store") if n.startswith(".staging")]
    with pytest.raises(ValueError, match="exists"):
        zarr.save_zarr(df, path)
    single = str(tmp_path / "single")
    zarr.save_zarr(df, single)
    assert {r["value"] for r in zarr.load_zarr(spark, single).collect()} == {None if r[5] is None else float(np.float32(r[5])) for r in rows}


def test_zarr_opens_only_the_chunks_asked_for(spark, tmp_path):
    df, rows = _fields(spark)
    path = tmp_path / "store"
    zarr.save_zarr(df, str(path), {"time": 4}, double=True)
    for f in ("tas", "tos"):
        for k in range(7):
            if (f, k) != ("tas", 3):  # 2003
                (path / f / f"{k}.0.0").write_bytes(b"broken")
    got = zarr.load_zarr(spark, str(path), ["tas"], (2003, 2003), lat=(0, 90))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[0] == "tas" and r[1] == 2003 and r[3] >= 0), key=str)
    assert got.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = zarr.load_zarr(spark, str(path)).where("field = 'tas' and year >= 2003 and year < 2004 and season = 2")
        assert sorted(map(tuple, pushed.collect()), key=str) == sorted((r for r in rows if r[:3] == ("tas", 2003, 2)), key=str)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="zlib|decompress"):
        zarr.load_zarr(spark, str(path)).collect()


def test_zarr_of_other_programs(spark, tmp_path):
    """Big-endian packed integers, column order, CF times, other names, absent chunks, no consolidated metadata."""

    def array(name, x, dims, chunks, attrs=None, write=True, **more):
        d = tmp_path / name
        d.mkdir()
        meta = {"zarr_format": 2, "shape": list(x.shape), "chunks": chunks, "dtype": x.dtype.str, "compressor": None, "fill_value": None, "order": "C", "filters": None} | more
        (d / ".zarray").write_text(json.dumps(meta))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | (attrs or {})))
        if write:
            full = np.zeros(chunks, x.dtype)
            full[tuple(slice(n) for n in x.shape)] = x
            (d / ".".join("0" * len(chunks))).write_bytes(full.tobytes(order=meta["order"]))

    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    x = np.arange(2 * 3 * 2, dtype=">i2").reshape(2, 3, 2)
    x[1, 2, 1] = -999
    array("tas", x, ["time", "latitude", "longitude"], [2, 4, 2], {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -999}, order="F")
    array("gone", x.astype("<f4"), ["time", "latitude", "longitude"], [2, 4, 2], write=False, fill_value="NaN")
    array("area", np.ones((3, 2)), ["y", "x"], [3, 2])  # not a field
    array("time", np.array([15.0, 45.0]), ["time"], [2], {"units": "days since 1999-12-01 00:00:00", "calendar": "noleap"})
    array("latitude", np.array([-1.0, 0.0, 1.0]), ["latitude"], [3])
    array("longitude", np.array([5, 6]), ["longitude"], [2])
    got = zarr.load_zarr(spark, str(tmp_path))
    assert got.columns == ["field", "year", "month", "lat", "lon", "value"]
    rows = {tuple(r)[:5]: r["value"] for r in got.collect()}
    assert len(rows) == 24 and all(v is None for k, v in rows.items() if k[0] == "gone")
    assert rows["tas", 1999, 12, 0.0, 6.0] == 11.5 and rows["tas", 2000, 1, 1.0, 6.0] is None and rows["tas", 2000, 1, -1.0, 5.0] == 13.0


def test_zarr_refuses(spark, tmp_path):
    df, _ = _fields(spark, range(2000, 2002))
    with pytest.raises(Exception, match="several values"):
        zarr.save_zarr(df.unionByName(df), str(tmp_path / "twice"))
    assert not (tmp_path / "twice" / ".zmetadata").exists()
    with pytest.raises(ValueError, match="nulls"):
        zarr.save_zarr(df.withColumn("lat", F.when(F.col("lat") > 0, F.col("lat"))), str(tmp_path / "null"))
    with pytest.raises(Exception, match="no Zarr group"):
        zarr.load_zarr(spark, str(tmp_path / "nothing")).collect()


def test_calendars():
    t = np.array([0.0, 59.0, 365.0])
    assert zarr.cf_months(t, "days since 2000-01-01", "noleap")["month"].tolist() == [1, 3, 1]
    assert zarr.cf_months(t, "days since 2000-01-01", "standard")["month"].tolist() == [1, 2, 12]
    assert zarr.cf_months(t, "days since 2000-01-01", "360_day")["year"].tolist() == [2000, 2000, 2001]
    assert zarr.cf_months(np.array([1500.0]), "hours since 2000-01-01 12:00:00", "noleap")["month"].tolist() == [3]
    with pytest.raises(ValueError, match="calendar"):
        zarr.cf_months(t, "days since 2000-01-01", "julian")
