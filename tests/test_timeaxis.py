import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import timeaxis as ta


def ask(spark, values, *exprs, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_season_and_decimal_are_inverse(spark):
    mids = [2000 + (3 * q + 0.5) / 12 for q in range(4)]
    assert [r[0] for r in ask(spark, mids, ta.decimal_to_season(F.col("t")))] == [0, 1, 2, 3]
    df = spark.createDataFrame([(2000, q) for q in range(4)], "y int, q int")
    assert np.allclose([r[0] for r in df.select(ta.season_to_decimal(F.col("y"), F.col("q"))).collect()], mids)


def test_rounding_of_jittered_months(spark):
    rng = np.random.default_rng(0)
    months = [(100 + k // 12, k % 12) for k in range(36)]
    t = [y + (m + 0.5) / 12 + 0.001 * rng.normal() for y, m in months]
    got = ask(spark, t, *ta.round_to_season(F.col("t")))
    assert got == [(y + (m == 11), (m + 1) % 12 // 3) for y, m in months]


def test_borders(spark):
    assert ask(spark, [2000 + 2 / 12, 2000 + 0.999], ta.decimal_to_season(F.col("t")))[1] == (0,)
    assert ask(spark, [2000 + 11.5 / 12], *ta.round_to_season(F.col("t"))) == [(2001, 0)]


@pytest.mark.parametrize(
    ("t", "leap", "noleap"),
    [(2000.0, "2000-01-01", "2000-01-01"), (2000 + 59 / 366, "2000-02-29", "2000-02-28"), (2001 + 59 / 365, "2001-03-01", "2001-03-01"), (1900 + 364 / 365, "1900-12-31", "1900-12-31"), (1.5, "0001-07-02", "0001-07-02")],
)
def test_dates(spark, t, leap, noleap):
    got = ask(spark, [t], F.date_format(ta.decimal_to_date(F.col("t")), "yyyy-MM-dd"), ta.decimal_to_date(F.col("t"), False))
    assert got == [(leap, noleap)]


def test_labels_order_and_months(spark):
    assert ta.SEASONS == ("DJF", "MAM", "JJA", "SON")
    df = spark.createDataFrame([(850, 2)], "y int, q int")
    assert df.select(ta.format_tuple(F.col("y"), F.col("q")), ta.format_tuple(F.col("y"), F.col("q"), False)).first()[:] == ("0850-JJA", "JJA 0850")
    assert ask(spark, [2000 + (m + 0.5) / 12 for m in range(12)], ta.decimal_to_month(F.col("t"))) == [(m,) for m in range(1, 13)]
    assert ask(spark, range(1, 13), ta.season_of_month(F.col("t")), kind="int") == [(0,), (0,), (1,), (1,), (1,), (2,), (2,), (2,), (3,), (3,), (3,), (0,)]


def test_split_seasonality():
    assert ta.split_seasonality([2, 3, 0, 1]) == ([2, 3], [0, 1])
    assert ta.split_seasonality([1, 2]) == ([], [1, 2])
    for bad in ([], [0, 0], [0, 2], [1, 0], [3, 0, 1, 2, 3], [7]):
        with pytest.raises(ValueError):
            ta.split_seasonality(bad)


@pytest.mark.parametrize(("step", "name"), [(1.0, "annual"), (0.25, "seasonal"), (1 / 12, "monthly"), (0.4, "other")])
def test_resolution(spark, step, name):
    df = spark.createDataFrame([(float(1000 + k * step),) for k in range(20)], "t double")
    assert ta.time_resolution(df).first()["resolution"] == name
