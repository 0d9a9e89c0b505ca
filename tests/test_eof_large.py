"""Singular vectors of large matrices against NumPy, and at 20,000 x 20,000."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.operators import eof_large, linear


def _matrix(rng, n, m, rank=6):
    return rng.normal(size=(n, rank)) @ np.diag(2.0 ** -np.arange(rank)) @ rng.normal(size=(rank, m)) + 0.01 * rng.normal(size=(n, m))


def _long(spark, a):
    return spark.createDataFrame([(int(i // 7), f"s{i % 7}", int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "block int, part string, t int, x double").repartition(6)


@pytest.mark.parametrize("shape", [(63, 20), (21, 50)])
def test_large_fit_equals_svd(spark, shape):
    rng = np.random.default_rng(shape[0])
    a = _matrix(rng, *shape)
    fit = eof_large.eof_fit_large(_long(spark, a), ["block", "part"], ["t"], 4, oversample=6, tolerance=1e-13)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    np.testing.assert_allclose(fit.s, s[:4], rtol=1e-8)
    got = {(r["block"], r["part"]): r["u"] for r in fit.modes.collect()}
    mine = np.array([got[i // 7, f"s{i % 7}"] for i in range(shape[0])])
    for k in range(4):
        assert mine[np.abs(mine[:, k]).argmax(), k] > 0
        np.testing.assert_allclose(np.abs(mine[:, k] @ u[:, k]), 1, atol=1e-8)
    assert fit.samples == shape[1]
    np.testing.assert_allclose(fit.total_variance, a.var(axis=1, ddof=1).sum())
    exact = linear.eof_fit(_long(spark, a), ["block", "part"], ["t"], 4)
    np.testing.assert_allclose(fit.variance, exact.variance, rtol=1e-8)


def test_stacked_rows_and_missing_entries(spark):
    rng = np.random.default_rng(2)
    a = _matrix(rng, 40, 25)
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "k int, values array<double>").repartition(5)
    fit = eof_large.eof_fit_rows(rows, ["k"], 3, tolerance=1e-13)
    np.testing.assert_allclose(fit.s, np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-8)
    np.testing.assert_allclose(fit.total_variance, a.var(axis=1, ddof=1).sum())
    a[3, 4] = a[10, 20] = 0
    gaps = _long(spark, a[:21]).withColumn("x", F.when(F.col("x") != 0, F.col("x")))
    got = eof_large.eof_fit_large(gaps, ["block", "part"], ["t"], 2, tolerance=1e-13)
    np.testing.assert_allclose(got.s, np.linalg.svd(a[:21], compute_uv=False)[:2], rtol=1e-8)


def test_numbers_follow_the_order_of_labels(spark):
    df = spark.createDataFrame([(f"b{k % 3}", k // 3) for k in range(60)], "a string, n int").repartition(7)
    got = [(r["a"], r["n"]) for r in eof_large.numbered(df.unionByName(df), ["a", "n"]).orderBy("_i").collect()]
    assert got == sorted(got) and len(got) == 60
    assert sorted(r["_i"] for r in eof_large.numbered(df, ["a", "n"]).collect()) == list(range(60))


def test_a_flat_spectrum_is_refused(spark):
    a = np.linalg.qr(np.random.default_rng(1).normal(size=(60, 60)))[0] + 1e-3 * np.random.default_rng(2).normal(size=(60, 60))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "k int, values array<double>")
    with pytest.raises(ValueError, match="still change"):
        eof_large.eof_fit_rows(rows, ["k"], 5, oversample=2, most=3, tolerance=1e-12)


def test_a_flat_spectrum_widens_the_frame(spark):
    """Many samples of noise: a frame of 30 of 40 columns would not settle in 60 passes."""
    a = np.random.default_rng(4).normal(size=(6000, 40))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "k int, values array<double>").repartition(5)
    fit = eof_large.eof_fit_rows(rows, ["k"], 3, oversample=27, tolerance=1e-14)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    np.testing.assert_allclose(fit.s, s[:3], rtol=1e-12)
    first = fit.modes.select("k", F.col("u")[0].alias("u")).toPandas().set_index("k")["u"].sort_index().to_numpy()
    assert fit.passes < 10 and abs(abs(first @ u[:, 0]) - 1) < 1e-9


def test_twenty_thousand_squared(spark):
    """A known product of 20 modes and noise; 3.2 GB that are never in one place."""
    n, rank = 20_000, 20
    rng = np.random.default_rng(0)
    left, right = np.linalg.qr(rng.normal(size=(n, rank)))[0], np.linalg.qr(rng.normal(size=(n, rank)))[0]
    size = 1000 * 0.8 ** np.arange(rank)
    shared = spark.sparkContext.broadcast(((left * size).astype(np.float32), right.astype(np.float32)))

    def rows(batches):
        a, b = shared.value
        for rb in batches:
            ids = rb.column(0).to_numpy()
            for s in range(0, len(ids), 100):
                part = ids[s : s + 100]
                x = (a[part] @ b.T).astype(float)
                yield pa.record_batch([pa.array(part), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n, dtype=np.int32)), pa.array(x.ravel()))], names=["k", "values"])

    df = spark.range(n, numPartitions=32).mapInArrow(rows, "k long, values array<double>")
    fit = eof_large.eof_fit_rows(df, ["k"], rank, tolerance=1e-6)
    np.testing.assert_allclose(fit.s, size, rtol=1e-4)
    first = fit.modes.select("k", F.col("u")[0].alias("u")).toPandas().set_index("k")["u"].sort_index().to_numpy()
    assert abs(first @ left[:, 0]) > 1 - 1e-5


def test_products_meet_in_strips(spark, monkeypatch):
    """Gram matrices and lagged covariances from strips of few rows are those of NumPy."""
    from isobar.operators import sums

    monkeypatch.setattr(linear, "STRIP", 40)
    monkeypatch.setattr(sums, "FAN", 2)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(9, 30))
    df = spark.createDataFrame([(i, t, float(a[i, t])) for i in range(9) for t in range(30)], "state int, t bigint, x double").repartition(9)
    fit = linear.eof_fit(df, ["state"], ["t"], 3)
    np.testing.assert_allclose(fit.s, np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-9)
    cov = linear.lag_covariance(df, "state", "t", 2).toPandas().sort_values(["i", "j"])
    np.testing.assert_allclose(cov["c0"].to_numpy().reshape(9, 9), a[:, :-2] @ a[:, :-2].T / 27, atol=1e-12)
    np.testing.assert_allclose(cov["ct"].to_numpy().reshape(9, 9), a[:, 2:] @ a[:, :-2].T / 27, atol=1e-12)


def test_states_that_exist_are_refused(spark, tmp_path):
    from isobar.sources import io

    rows = spark.createDataFrame([(0, y, q, 1.5) for y in (1, 2) for q in range(4)], "iteration int, year int, season int, x double")
    io.save_states(rows, str(tmp_path / "s"))
    io.save_states(rows.withColumn("year", F.col("year") + 2), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="already"):
        io.save_states(rows.where("year = 2").withColumn("x", F.lit(0.0)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 16
