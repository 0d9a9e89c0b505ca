"""Vertical columns: cloud overlap, ocean heat content, interpolation, sea ice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import RHO_CP, cell_area_m2

#: Pressure bands in Pa, from the lower to the upper border.
BANDS = {"low": (120_000.0, 70_000.0), "medium": (70_000.0, 40_000.0), "high": (40_000.0, 5_000.0), "total": (120_000.0, 5_000.0)}


def _max_random(levels: Column) -> Column:
    """Neighbouring cloudy levels overlap most, separate blocks at random; missing counts as clear."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("block"))

    def closed(a: Column) -> Column:
        return a["total"] + a["block"] - a["total"] * a["block"]

    def step(a: Column, c: Column) -> Column:
        cloudy = F.coalesce(c > 0, F.lit(False))
        return F.when(cloudy, F.struct(a["total"].alias("total"), F.greatest(a["block"], c).alias("block"))).otherwise(F.struct(closed(a).alias("total"), F.lit(0.0).alias("block")))

    return F.aggregate(levels, zero, step, closed)


def cloud_fraction(df: DataFrame, by: list[str], overlap: str, band: str = "total", lev: str = "lev", value: str = "value") -> DataFrame:
    """Cloud fraction seen from above a pressure band (borders included), levels ordered from the ground up."""
    lo, hi = BANDS[band]
    inside = df.where(F.col(lev).between(hi, lo))
    c = F.col(value)
    if overlap == "max":
        agg = F.coalesce(F.max(c), F.lit(0.0))
    elif overlap == "min":
        agg = F.least(F.lit(1.0), F.coalesce(F.sum(c), F.lit(0.0)))
    elif overlap == "random":
        # A product of clear shares; an overcast level leaves none.
        agg = F.when(F.max(c) >= 1, 1.0).otherwise(1 - F.exp(F.coalesce(F.sum(F.log1p(-F.when(c < 1, c))), F.lit(0.0))))
    elif overlap == "maxrandom":
        ordered = F.array_sort(F.collect_list(F.struct((-F.col(lev)).alias("o"), c.alias("c"))))
        return inside.groupBy(*by).agg(ordered.alias("_l")).select(*by, _max_random(F.transform("_l", lambda x: x["c"])).alias(value))
    else:
        raise ValueError(f"unknown overlap {overlap}")
    return inside.groupBy(*by).agg(agg.alias(value))


def ohc(df: DataFrame, by: list[str], depth: float, lev: str = "lev", thickness: str = "dz", value: str = "value") -> DataFrame:
    """Heat content per area of the whole levels down to ``depth``; null for columns without a value."""
    inside = df.where(F.col(lev) <= depth)
    return inside.groupBy(*by).agg((F.lit(RHO_CP) * F.sum(F.col(value) * F.col(thickness))).alias(value))


def ohc_from_layer_mean(theta: Column, depth: float) -> Column:
    return RHO_CP * theta * depth


def level_thickness(df: DataFrame, by: list[str], lev: str = "lev") -> DataFrame:
    """Thickness of levels whose borders are halfway between them, the first at the surface."""
    w = Window.partitionBy(*by).orderBy(lev)
    up = F.coalesce((F.lag(lev).over(w) + F.col(lev)) / 2, F.lit(0.0))
    low = F.coalesce((F.lead(lev).over(w) + F.col(lev)) / 2, F.col(lev) + (F.col(lev) - up))
    return df.withColumn("dz", low - up)


def interpolate_log_pressure(df: DataFrame, by: list[str], targets: list[float], pressure: str = "p", value: str = "value") -> DataFrame:
    """Linear in log pressure between the levels around each target; null outside the column.

    Each pair of neighbouring levels answers the targets between them, so the
    column is read once and nothing is joined.
    """
    w = Window.partitionBy(*by).orderBy(F.col(pressure).desc())
    pairs = df.where(F.col(value).isNotNull()).select(*by, F.col(pressure).alias("p0"), F.col(value).alias("v0"), F.lead(pressure).over(w).alias("p1"), F.lead(value).over(w).alias("v1"), F.row_number().over(w).alias("_k"))
    each = pairs.withColumn("lev", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    between = (F.col("lev") <= F.col("p0")) & (F.col("lev") > F.col("p1"))
    exact = (F.col("p1").isNull()) & (F.col("lev") == F.col("p0"))
    share = F.try_divide(F.log(F.col("p0")) - F.log(F.col("lev")), F.log(F.col("p0")) - F.log(F.col("p1")))
    v = F.when(exact, F.col("v0")).when(between, F.col("v0") + share * (F.col("v1") - F.col("v0")))
    return each.groupBy(*by, "lev").agg(F.max(v).alias(value))


def sea_ice(df: DataFrame, by: list[str], dlat: float, dlon: float, threshold: float = 0.15, value: str = "value") -> DataFrame:
    """Area and extent (km2) of both hemispheres; the equator is in neither, all missing gives 0."""
    area = cell_area_m2(F.col("lat"), dlat, dlon) / 1e6
    c, lat = F.col(value), F.col("lat")
    total = lambda x, here: F.coalesce(F.sum(F.when(here, x)), F.lit(0.0))
    return df.groupBy(*by).agg(
        total(c * area, lat > 0).alias("area_n"),
        total(c * area, lat < 0).alias("area_s"),
        total(area, (lat > 0) & (c >= threshold)).alias("extent_n"),
        total(area, (lat < 0) & (c >= threshold)).alias("extent_s"),
    )
