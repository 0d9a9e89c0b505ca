"""Detrending, regression and windows along time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detrend(df: DataFrame, t: str | Column, by: list[str], value: str = "value", degree: int = 1) -> DataFrame:
    """Values minus their least-squares polynomial in time, intercept included; add the season to ``by`` to detrend each alone."""
    tc = F.col(t) if isinstance(t, str) else t
    if degree == 1:
        w = Window.partitionBy(*by)
        d = df.withColumn("_t", tc)
        return d.withColumn(value, F.col(value) - (F.regr_intercept(F.col(value), F.col("_t")).over(w) + F.regr_slope(F.col(value), F.col("_t")).over(w) * F.col("_t"))).drop("_t")
    base = df.withColumn("_t", tc.cast("double"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf[value].notna()
        if has.sum() > degree:
            mid = pdf["_t"].mean()
            pdf[value] = pdf[value] - np.polyval(np.polyfit(pdf["_t"][has] - mid, pdf[value][has], degree), pdf["_t"] - mid)
        return pdf

    return base.groupBy(*by).applyInPandas(run, base.schema).drop("_t")


def regress_field(field: DataFrame, index: DataFrame, time: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Slope of each cell on an index over the times both have; cells with a gap have none.

    ``index`` is one row for each time step, bounded by the calendar.
    """
    joined = field.join(F.broadcast(index.where("x is not null").select(*time, "x")), time)
    return joined.groupBy(*by).agg(F.when(F.count(value) == F.count(F.lit(1)), F.regr_slope(F.col(value), F.col("x"))).alias("slope"))


def regress_scalar(a: DataFrame, index: DataFrame, time: list[str], value: str = "value") -> DataFrame:
    return a.join(index.where("x is not null"), time).agg(F.regr_slope(F.col(value), F.col("x")).alias("slope"))


def sliding_trend(df: DataFrame, order: list[str], by: list[str], window: int, center: bool = True, value: str = "value") -> DataFrame:
    """Slope by window position (per step) over full windows, labelled at the centre or the right edge."""
    w = Window.partitionBy(*by).orderBy(*order)
    lo, hi = (-(window // 2), window - 1 - window // 2) if center else (-(window - 1), 0)
    span = w.rowsBetween(lo, hi)
    d = df.withColumn("_i", F.row_number().over(w).cast("double"))
    d = d.withColumn("_n", F.count(value).over(span)).withColumn("trend", F.regr_slope(F.col(value), F.col("_i")).over(span))
    return d.where(F.col("_n") == window).drop("_i", "_n", value)


def rolling_mean(df: DataFrame, order: list[str], by: list[str], window: int, center: bool = True, value: str = "value") -> DataFrame:
    """Mean over full windows."""
    w = Window.partitionBy(*by).orderBy(*order)
    lo, hi = (-(window // 2), window - 1 - window // 2) if center else (-(window - 1), 0)
    span = w.rowsBetween(lo, hi)
    return df.withColumn("_n", F.count(value).over(span)).withColumn("mean", F.avg(value).over(span)).where(F.col("_n") == window).drop("_n", value)


def time_derivative(df: DataFrame, t: str, by: list[str], value: str = "value") -> DataFrame:
    """Second-order central difference on uneven steps, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(t)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    d = df.withColumns({"_a": a, "_b": b, "_h": F.col(t) - F.lag(t).over(w), "_k": F.lead(t).over(w) - F.col(t)})
    v, h, k = F.col(value), F.col("_h"), F.col("_k")
    inner = (h * h * F.col("_b") + (k * k - h * h) * v - k * k * F.col("_a")) / (h * k * (h + k))
    return d.withColumn("derivative", F.when(h.isNull(), F.try_divide(F.col("_b") - v, k)).when(k.isNull(), F.try_divide(v - F.col("_a"), h)).otherwise(inner)).drop("_a", "_b", "_h", "_k")


def _surrogates(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Series with the spectrum of ``x`` and random phases."""
    spec = np.fft.rfft(x - x.mean())
    phase = np.exp(2j * np.pi * rng.random((count, len(spec))))
    phase[:, 0] = 1
    if len(x) % 2 == 0:
        phase[:, -1] = 1
    return np.fft.irfft(np.abs(spec) * phase, len(x), axis=1)


def correlation_significance(df: DataFrame, by: list[str], order: str, a: str = "a", b: str = "b", surrogates: int = 1000, threshold: float | None = None, seed: int = 41_561_564) -> DataFrame:
    """``corr, p``: share of phase-randomised pairs that correlate at least as strongly.

    Null where a series has a gap, or where the correlation reaches ``threshold``.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[a].to_numpy(float), pdf[b].to_numpy(float)
        r = p = None
        if len(x) > 3 and not (np.isnan(x).any() or np.isnan(y).any()) and x.std() > 0 and y.std() > 0:
            r = float(np.corrcoef(x, y)[0, 1])
            if threshold is None or r < threshold:
                rng = np.random.default_rng(seed)
                sx, sy = _surrogates(x, surrogates, rng), _surrogates(y, surrogates, rng)
                rs = (sx * sy).sum(1) / np.sqrt((sx**2).sum(1) * (sy**2).sum(1))
                p = float((np.abs(rs) >= abs(r)).mean())
        return pd.DataFrame([[*key, r, p]], columns=[*by, "corr", "p"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, order, a, b).groupBy(*by).applyInPandas(run, f"{fields}, corr double, p double")
