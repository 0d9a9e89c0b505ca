"""Indices of climate variability from sea-surface temperature anomalies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import area_weight
from .linear import eof_fit, eof_project

Box = tuple[float, float, float, float]  # latitudes, longitudes; borders included
NINO34: Box = (-5, 5, 190, 240)
AMO: Box = (0, 60, 280, 360)
TRIPOLE: tuple[Box, Box, Box] = ((25, 45, 140, 215), (-10, 10, 170, 270), (-50, -15, 150, 200))
PDO: Box = (20, 70, 110, 260)


def inside(box: Box) -> Column:
    return F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3])


def box_mean(box: Box | None, value: str = "value") -> Column:
    """Aggregate: cos(lat)-weighted mean over a box."""
    here = F.col(value).isNotNull() if box is None else inside(box) & F.col(value).isNotNull()
    w = F.when(here, area_weight(F.col("lat")))
    return F.try_divide(F.sum(w * F.col(value)), F.sum(w))


def nino34(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(box_mean(NINO34).alias("nino34"))


def ipo_tripole(df: DataFrame, by: list[str]) -> DataFrame:
    t1, t2, t3 = (box_mean(b) for b in TRIPOLE)
    return df.groupBy(*by).agg((t2 - (t1 + t3) / 2).alias("ipo_tpi"))


def amo(df: DataFrame, by: list[str]) -> DataFrame:
    """North Atlantic mean of what differs from the mean between 60S and 60N.

    The mean subtracted is the same for all cells of a time, so it comes off
    the weighted mean: one aggregation instead of a join.
    """
    return df.groupBy(*by).agg((box_mean(AMO) - box_mean((-60, 60, -1e9, 1e9))).alias("amo"))


def pdo(df: DataFrame, by: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Leading mode of North Pacific anomalies about the global mean, weighted by cos(lat), standardised.

    The sign makes the mean of the mode not positive. Returns the index and the mode.
    """
    mean = df.groupBy(*by).agg(box_mean(None).alias("_g"))
    box = df.where(inside(PDO)).join(mean, by).select(*by, "lat", "lon", F.when(F.col("value").isNotNull(), (F.col("value") - F.col("_g")) * area_weight(F.col("lat"))).alias("x")).persist()
    full = box.groupBy("lat", "lon").agg(F.count("x").alias("_n"), F.count(F.lit(1)).alias("_m")).where("_n = _m").select("lat", "lon")
    # Cells of one box of a grid; read by the fit and the projection.
    rows = box.join(F.broadcast(full), ["lat", "lon"]).persist()
    fit = eof_fit(rows, state=["lat", "lon"], sample=by, rank=1)
    if fit.u[:, 0].mean() > 0:
        fit.u = -fit.u
    scores = eof_project(rows, fit, sample=by)
    # Population standard deviation of the index over the fitted samples.
    std = scores.agg(F.stddev_pop(F.col("score"))).first()[0] or 1.0
    return scores.select(*by, (F.col("score") / F.lit(float(std))).alias("pdo")), fit.u[:, 0]
