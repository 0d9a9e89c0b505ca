"""Spherical harmonics of fields on regular grids: truncation and spectra.

A grid of at most a few ten thousand cells is one vector; the transform of a
sample is a product with matrices that every task builds from the grid's
latitudes, so samples are independent and nothing but them is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SIDE


def legendre(x: np.ndarray, top: int) -> np.ndarray:
    """Normalised associated Legendre functions ``[m, l, x]`` (their squares integrate to 1 with the circle), by upward recurrence."""
    out = np.zeros((top + 1, top + 1, len(x)))
    s = np.sqrt(np.maximum(1 - x**2, 0))
    p = np.full(len(x), math.sqrt(1 / (4 * math.pi)))
    for m in range(top + 1):
        if m:
            p = p * s * math.sqrt((2 * m + 1) / (2 * m))
        out[m, m] = p
        if m < top:
            out[m, m + 1] = math.sqrt(2 * m + 3) * x * p
        for l in range(m + 2, top + 1):
            a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            b = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
            out[m, l] = a * (x * out[m, l - 1] - b * out[m, l - 2])
    return out


def basis(lat: np.ndarray, lon: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """``(Y, degree)``: real harmonics up to degree ``top`` at the points, one column each."""
    p = legendre(np.sin(np.radians(lat)), top)
    lam = np.radians(lon)
    cols, degree = [], []
    for m in range(top + 1):
        for l in range(m, top + 1):
            for part in ([1.0] if m == 0 else [math.sqrt(2) * np.cos(m * lam), math.sqrt(2) * np.sin(m * lam)]):
                cols.append(p[m, l] * part)
                degree.append(l)
    return np.column_stack(cols), np.array(degree)


def analysis(lat: np.ndarray, lon: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """``(A, degree)``: coefficients of a field as ``A @ values``, by weighted least squares on the grid."""
    y, degree = basis(lat, lon, top)
    w = np.sqrt(np.maximum(np.cos(np.radians(lat)), 1e-6))
    return np.linalg.pinv(y * w[:, None]) * w[None, :], degree


def _per_sample(df: DataFrame, sample: list[str], fn, columns: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in sample)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > SIDE * 4:
            raise ValueError("too many cells for one sample")
        pdf = pdf.sort_values(["lat", "lon"])
        if pdf["value"].isna().any():
            raise ValueError("spherical harmonics need fields without gaps")
        out = fn(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["value"].to_numpy())
        for k, c in enumerate(sample):
            out.insert(k, c, key[k])
        return out

    return df.select(*sample, "lat", "lon", F.col("value").cast("double").alias("value")).groupBy(*sample).applyInPandas(run, f"{kinds}, {columns}")


def truncate(df: DataFrame, sample: list[str], top: int) -> DataFrame:
    """Triangular truncation at degree ``top``, on a grid of ``top + 1`` (made even) rows and 1.5 times as many columns."""
    nlat = (top + 1) + (top + 1) % 2
    nlon = int(nlat * 1.5)
    lat, lon = (g.ravel() for g in np.meshgrid(-90 + 180 / nlat * (np.arange(nlat) + 0.5), np.arange(nlon) * 360 / nlon, indexing="ij"))

    def run(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"lat": lat, "lon": lon, "value": basis(lat, lon, top)[0] @ (analysis(a, b, top)[0] @ v)})

    return _per_sample(df, sample, run, "lat double, lon double, value double")


def spectrum(df: DataFrame, sample: list[str], top: int) -> DataFrame:
    """``degree, power``: sum of squared coefficients of each degree over the area of the sphere."""

    def run(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        m, degree = analysis(a, b, top)
        power = np.bincount(degree, weights=(m @ v) ** 2) / (4 * math.pi)
        return pd.DataFrame({"degree": np.arange(top + 1, dtype=np.int32), "power": power})

    return _per_sample(df, sample, run, "degree int, power double")
