"""Stochastic forecasts, their verification, and pseudo-records of a network."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from isobar.operators import proxies, verification
from isobar.operators.lim import Lim
from isobar.operators.mapper import Mapper


def _lim(rates, noise):
    n = len(rates)
    return Lim(0.25, np.diag(np.exp(-0.25 * np.array(rates))), np.diag(-np.array(rates, float)).astype(complex), np.array(noise, float), np.eye(n), 1.0)


def _reduced(spark, x):
    return spark.createDataFrame([(int(t), int(i), float(x[i, t])) for i in range(x.shape[0]) for t in range(x.shape[1])], "k bigint, state int, x double").repartition(5)


def test_starts_have_all_that_follows(spark):
    steps = [0, 1, 2, 3, 5, 6, 7, 8, 9]
    df = spark.createDataFrame([(k, 0, 1.0) for k in steps], "k bigint, state int, x double")
    assert sorted(r["case"] for r in verification.starts(df, "k", 2).collect()) == [0, 1, 5, 6, 7]
    some = [{r["case"] for r in verification.starts(df, "k", 2, 3, seed).collect()} for seed in (1, 1, 2, 3, 4)]
    assert len(some[0]) == 3 and some[0] == some[1] and len({frozenset(x) for x in some}) > 1


def test_spread_is_the_stationary_covariance(spark):
    """Long after the start the members' variance is q / 2a, and their mean is gone."""
    model = _lim([8.0, 12.0], [3.0, 0.5])
    x = _reduced(spark, np.full((2, 9), 5.0))
    fc = verification.stochastic_forecasts(model, x, "k", 8, 3000, 60)
    rows = {(r["lead"], r["state"]): r for r in verification.by_case(fc, ["state"]).collect()}
    assert {k[0] for k in rows} == set(range(9)) and rows[0, 0]["variance"] == 0
    for i, (a, q) in enumerate(((8.0, 3.0), (12.0, 0.5))):
        dt = 0.25 / 60
        want = q * dt / (1 - (1 - a * dt) ** 2) * (1 + (1 - a * dt)) / 2  # of the midpoints of the scheme
        assert abs(rows[8, i]["variance"] / want - 1) < 0.1 and abs(rows[8, i]["mean"]) < 4 * np.sqrt(want / 3000)


def test_streams_depend_on_keys_alone(spark):
    model = _lim([2.0, 1.0], [1.0, 1.0])
    x = np.random.default_rng(1).normal(size=(2, 8))
    a = verification.stochastic_forecasts(model, _reduced(spark, x), "k", 2, 30, 10).toPandas()
    b = verification.stochastic_forecasts(model, _reduced(spark, x).repartition(2), "k", 2, 30, 10, cases=3).toPandas()
    both = a.merge(b, on=["case", "lead", "ens", "state"])
    assert len(b) == 3 * 3 * 30 * 2 == len(both) and (both["x_x"] == both["x_y"]).all()
    one = a[(a["lead"] == 2) & (a["state"] == 0)].pivot(index="ens", columns="case", values="x")
    assert one.nunique().min() == 30 and np.abs(np.corrcoef(one.to_numpy() - one.to_numpy().mean(0), rowvar=False) - np.eye(one.shape[1])).max() < 0.7


def test_scores_in_the_task_are_those_of_the_forecasts(spark):
    """Gaps, an element that is not recorded, runs of starts that borders divide, drawn cases; no row for a member."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 170))
    df = _reduced(spark, x).where("k not in (40, 41, 130) and not (k = 70 and state = 1)").withColumn("k", F.col("k") - 60)
    for noise, cases, keep in (([1.0, 0.5, 2.0], None, True), ([1.0, 0.5, 2.0], 20, False), ([0.0] * 3, None, True)):
        model = _lim([2.0, 1.0, 0.5], noise)
        fc = verification.stochastic_forecasts(model, df, "k", 3, 30, 10, cases=cases, keep_initial=keep)
        want = verification.scores(verification.by_case(fc, ["state"]), df, "k", ["state"]).toPandas()
        got = verification.state_scores(model, df, "k", 3, 30, 10, cases=cases, keep_initial=keep)
        assert "posexplode(v" not in got._jdf.queryExecution().toString()
        order = ["lead", "state"]
        pd.testing.assert_frame_equal(got.toPandas().sort_values(order).reset_index(drop=True), want[got.columns].sort_values(order).reset_index(drop=True), check_dtype=False, rtol=1e-9, atol=1e-12)


def test_joint_substeps_are_the_substeps(monkeypatch):
    from isobar.operators import lim

    c0 = np.array([[1.0, 0.3], [0.3, 0.5]])
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(lim, "JOINT", size)
        model = Lim.from_covariances(c0, np.array([[0.7, -0.2], [0.3, 0.3]]), 0.25)
        got = model.simulate(np.ones((2, 4)), 3, 8, np.random.default_rng(1))
        gen, dt, x, want = np.random.default_rng(1), 0.25 / 8, np.ones((2, 4)), []
        for k in range(25):
            new = x + model.l.real @ x * dt + model.q_vectors * np.sqrt(model.q_values * dt) @ gen.normal(size=(len(model.q_values), 4))
            want += [(x + new) / 2] if k % 8 == 0 else []
            x = new
        np.testing.assert_allclose(got, np.stack(want, 2), atol=1e-12)


def test_physical_scores_equal_numpy(spark):
    rng = np.random.default_rng(3)
    lat, lon, times = [-30.0, 0.0, 30.0], [10.0, 100.0], 24
    base = rng.normal(size=(2, 3, 2, 3)) @ rng.normal(size=(3, times)) + 0.2 * rng.normal(size=(2, 3, 2, times))
    cells = spark.createDataFrame([(f, a, o, t // 4, t % 4, float(base[i, j, k, t])) for i, f in enumerate(("tas", "tos")) for j, a in enumerate(lat) for k, o in enumerate(lon) for t in range(times)], "field string, lat double, lon double, year int, season int, value double")
    time = ["year", "season"]
    mapper = Mapper(k=3, l=3).fit(cells, time)
    step = F.col("year") * 4 + F.col("season")
    reduced = mapper.forward(cells, time).withColumn("k", step.cast("bigint"))
    fc = verification.stochastic_forecasts(_lim([1.0, 1.5, 2.0], [0.0] * 3), reduced, "k", 2, 3, 40)
    got = verification.verify_physical(fc, mapper, cells, time, step, ["tas"]).toPandas()
    places, forward, back = mapper.matrices()
    order = [(("tas", "tos").index(f), lat.index(a), lon.index(o)) for f, a, o in places]
    x = np.array([base[p] for p in order])
    z = forward @ x
    move = np.eye(3) - np.diag([1.0, 1.5, 2.0]) * 0.25 / 40
    half = np.eye(3) - np.diag([1.0, 1.5, 2.0]) * 0.25 / 80
    held = back @ z
    assert len(got) == 6 * 3 and set(got["field"]) == {"tas"} and (got["spread"] < 1e-9).all() and (got["cases"] == times - 2).all()
    for r in got.itertuples():
        p = places.index((r.field, r.lat, r.lon))
        now = z if r.lead == 0 else half @ np.linalg.matrix_power(move, 40 * r.lead) @ z
        mine = (back @ now)[p, : times - 2]
        came = slice(r.lead, r.lead + times - 2)
        np.testing.assert_allclose(r.rmse, np.sqrt(np.mean((mine - x[p, came]) ** 2)), atol=1e-8)
        np.testing.assert_allclose(r.rmse_truncated, np.sqrt(np.mean((mine - held[p, came]) ** 2)), atol=1e-8)
    assert (got[got["lead"] == 0]["rmse_truncated"] < 1e-8).all() and (got[got["lead"] == 0]["rmse"] > 1e-3).all()


def test_pseudo_network_has_the_network_s_gaps_and_noise(spark):
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([("tas", 0.0, 10.0, y, q, float(rng.normal())) for y in range(1000, 1600) for q in range(4)], columns=["field", "lat", "lon", "year", "season", "value"])
    obs = pd.DataFrame([(1, y, q, 1.0) for y in range(1000, 1600) for q in (0, 2) if (y + q) % 5] + [(2, y, None, 1.0) for y in range(1100, 1500)], columns=["pid", "year", "season", "value"])
    obs.loc[3, "value"] = None
    rows = [(int(r.pid), int(r.year), None if pd.isna(r.season) else int(r.season), None if pd.isna(r.value) else float(r.value)) for r in obs.itertuples()]
    truth = spark.createDataFrame(cells)
    given = spark.createDataFrame(rows, "pid bigint, year int, season int, value double")
    seasonal = spark.createDataFrame([(1, 0, "tas", 0.0, 10.0, 2.0, 1.0, 0.5), (1, 2, "tas", 0.0, 10.0, -1.0, 0.0, 4.0)], "pid bigint, season int, field string, lat double, lon double, slope double, intercept double, snr double")
    annual = spark.createDataFrame([(2, 0, "tas", 0.0, 10.0, 3.0, 0.5, 1.0), (3, 0, "tas", 9.0, 9.0, 1.0, 0.0, 1.0)], "pid bigint, seasonality int, field string, lat double, lon double, slope double, intercept double, snr double")
    out, models = proxies.pseudo_network(given, seasonal, annual, truth, [[0, 1]], snr_scale=2.0)
    got = out.toPandas()
    want = {(1, r[1], r[2]) for r in rows if r[0] == 1 and r[3] is not None} | {(2, r[1], None) for r in rows if r[0] == 2}
    assert {(int(r.pid.removeprefix("pseudo_")), r.year, None if pd.isna(r.season) else int(r.season)) for r in got.itertuples()} == want
    assert {r["pid"] for r in models.select("pid").collect()} == {"pseudo_1", "pseudo_2"} and models.count() == 3
    x = cells.set_index(["year", "season"])["value"]
    for r in got.iloc[::37].itertuples():
        seen = 0.5 + 3 * (x[r.year, 0] + x[r.year, 1]) / 2 if r.pid == "pseudo_2" else (1 + 2 * x[r.year, 0] if r.season == 0 else -x[r.year, 2])
        assert abs(r.estimated - seen) < 1e-9
    for _, part in got.assign(season=got["season"].fillna(-1)).groupby(["pid", "season"]):
        std = part["estimated"].std(ddof=0)
        snr = {("pseudo_1", 0): 0.5, ("pseudo_1", 2): 4.0}.get((part["pid"].iloc[0], part["season"].iloc[0]), 1.0)
        np.testing.assert_allclose(part["noise_std"], std / snr / 2, rtol=1e-9)
        noise = (part["value"] - part["estimated"]) / part["noise_std"]
        assert abs(noise.mean()) < 0.2 and abs(noise.std() - 1) < 0.15
    again = proxies.pseudo_network(given.repartition(7), seasonal, annual, truth, [[0, 1]], snr_scale=2.0)[0].toPandas()
    both = got.merge(again, on=["pid", "year", "season"])
    assert len(both) == len(got) and np.allclose(both["value_x"], both["value_y"], atol=1e-9)
