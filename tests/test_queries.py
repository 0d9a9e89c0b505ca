"""Every query with SQL gives the rows of its SQL (on the smallest tables)."""

import inspect
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from isobar.operators import enkf, lim, regress
from isobar.plans import assimilate, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    out = {}
    for d in (data, data.replace("0.001", "0.01")):
        out[d] = duckdb.connect()
        for t in TABLES:
            out[d].execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, data, duck, name):
    # In the smallest tables a cell has one site, which its own mean fits without error.
    d = data.replace("0.001", "0.01") if name.startswith(("psm", "verification", "pseudo_obs_network")) else data
    got, want = registry.QUERIES[name](spark, d).toPandas(), duck[d].execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (d[cols].sort_values(cols, na_position="first").reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=0)


def test_fixed_text_keeps_its_head_first(spark, data, duck, monkeypatch):
    """Lists are collected in the order of arrival, which is open; here it is turned round."""
    from pyspark.sql import functions as F

    collected = F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: F.reverse(collected(c)))
    got = registry.QUERIES["source_fixed_text"](spark, data).toPandas().sort_values("nation").reset_index(drop=True)
    want = duck[data].execute(registry.ORACLE_SQL["source_fixed_text"]).df().sort_values("nation").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_corpus_operators():
    code = "import sys\nsys.modules['public_tokenizers'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert set(e.queries()) and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    for absent in ("corpus_pipeline", "public_tokenizers"):
        one = code.replace("sys.modules['public_tokenizers'] = sys.modules['corpus_pipeline']", f"sys.modules['{absent}']")
        subprocess.run([sys.executable, "-W", "ignore", "-c", one], check=True, cwd=os.path.dirname(entry.__file__))


def test_sql_is_given_for_known_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def state(data):
    """The whole state matrix, state element by sample."""
    e = pd.read_parquet(f"{data}/embeddings.parquet").sort_values("vec_id")
    x = np.vstack(e["embedding"].to_numpy()).astype(float).T
    return x - x.mean(1, keepdims=True)


def propagator(x):
    return x[:, 1:] @ x[:, :-1].T @ np.linalg.inv(x[:, :-1] @ x[:, :-1].T)


def test_every_start_and_state_element_is_verified(spark, data):
    x = state(data)
    g = propagator(x)
    got = registry.QUERIES["forecast_verification"](spark, data).toPandas().pivot(index="state_idx", columns="step", values="rmse")
    assert got.shape == (64, 4)
    for k in range(1, 5):
        error = np.linalg.matrix_power(g, k) @ x[:, :-k] - x[:, k:]
        assert np.allclose(got[k], np.sqrt((error**2).mean(1)), rtol=0, atol=2e-6)


def test_every_sample_is_filtered(spark, data):
    x = state(data).reshape(64, -1, 4)
    want = enkf.assimilate_time_average(x, [0.5, -0.2], [lambda z: z[0], lambda z: z[1] + z[2]], [0.3, 0.4], [[0, 1, 2, 3], [3]])
    got = registry.QUERIES["enkf_time_average"](spark, data).toPandas().sort_values(["state", "ens", "step"])
    assert len(got) == x.size and np.allclose(got["x"].to_numpy().reshape(x.shape), want, rtol=0, atol=2e-6)


def test_linear_models_hold_the_whole_state(spark, data):
    g = propagator(state(data))
    fit = registry.QUERIES["lim_fit"](spark, data).toPandas().pivot(index="i", columns="j", values="g").to_numpy()
    assert fit.shape == g.shape == (64, 64) and np.allclose(fit, g, rtol=0, atol=2e-6)
    cast = registry.QUERIES["lim_forecast"](spark, data).toPandas().pivot(index="state", columns="step", values="x").to_numpy()
    assert np.allclose(cast, np.stack([np.linalg.matrix_power(g, k) @ np.ones(64) for k in range(5)], axis=1), rtol=0, atol=2e-6)
    drawn = registry.QUERIES["lim_forecast_stochastic"](spark, data).toPandas()
    assert len(drawn) == 64 * 5 and np.isfinite(drawn[["mean", "std"]]).all(axis=None)


def test_significance_is_of_a_thousand_surrogates(spark, data, monkeypatch):
    seen = []
    usual = inspect.signature(regress.correlation_significance)
    monkeypatch.setattr(regress, "correlation_significance", lambda *args, **more: (seen.append(bound := usual.bind(*args, **more)), bound.apply_defaults(), args[0])[2])
    registry.QUERIES["corr_significance"](spark, data)
    assert seen[0].arguments["surrogates"] == 1000


def test_integration_takes_all_substeps(spark, data, monkeypatch):
    seen = []
    simulate = lim.Lim.simulate
    monkeypatch.setattr(lim.Lim, "simulate", lambda self, x0, steps, substeps, *rest, **more: (seen.append(substeps), simulate(self, x0, steps, substeps, *rest, **more))[1])
    registry.QUERIES["lim_forecast_stochastic"](spark, data)
    assert seen == [360]

    class Stop(Exception):
        pass

    def stop(*args, substeps=None, **more):
        assert substeps is None
        raise Stop

    monkeypatch.setattr(assimilate, "reconstruct", stop)
    for name in ("reconstruction_cycle", "reconstruction_physical_window"):
        with pytest.raises(Stop):
            registry.QUERIES[name](spark, data)
