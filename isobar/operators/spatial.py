"""Grids, nearest cells and regridding as joins with small weight tables.

Grids are tables of at most a few ten thousand cells (16,200 at 2 degrees);
they are broadcast only after their rows are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km

#: Bytes of a grid or weight table that may be broadcast.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame) -> DataFrame:
    """``df``, of plain columns, marked for broadcast if its rows are few enough."""
    limit = BROADCAST_BYTES // (8 * (2 + len(df.columns)))
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def regular_grid(spark: SparkSession, lat0: float, lat1: float, dlat: float, lon0: float, lon1: float, dlon: float) -> DataFrame:
    """Cell centres between the given edges."""
    if not (-90 <= lat0 < lat1 <= 90 and dlat > 0 and dlon > 0 and lon0 < lon1 and lon1 - lon0 <= 360):
        raise ValueError("not a grid on the globe")
    rows, cols = (lat1 - lat0) / dlat, (lon1 - lon0) / dlon
    if abs(rows - round(rows)) > 1e-9 or abs(cols - round(cols)) > 1e-9:
        raise ValueError("steps do not divide the range")
    n = round(cols)
    k = F.col("id")
    return spark.range(round(rows) * n).select((lat0 + dlat / 2 + F.floor(k / n) * dlat).cast("double").alias("lat"), (lon0 + dlon / 2 + (k % n) * dlon).cast("double").alias("lon"))


def nearest_gridpoint(sites: DataFrame, grid: DataFrame, key: str = "pid") -> DataFrame:
    """Nearest cell (great circle) of each site; the first by latitude, then longitude, on ties."""
    g = sized(grid.select(F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon")).distinct())
    d = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("grid_lat"), F.col("grid_lon")), 6)
    pairs = sites.select(key, "lat", "lon").join(g, F.lit(True)).select(key, F.struct(d.alias("distance"), "grid_lat", "grid_lon").alias("g"))
    return pairs.groupBy(key).agg(F.min("g").alias("g")).select(key, "g.grid_lat", "g.grid_lon", "g.distance")


def nearest_gridpoint_with_data(sites: DataFrame, field: DataFrame, key: str = "pid", value: str = "value") -> DataFrame:
    """Nearest cell that has any value."""
    return nearest_gridpoint(sites, field.where(F.col(value).isNotNull()).select("lat", "lon").distinct(), key)


def nearest_per_dimension(sites: DataFrame, grid: DataFrame, key: str = "pid") -> DataFrame:
    """Nearest latitude, then nearest longitude, each alone."""
    out = sites.select(key, "lat", "lon")
    for c in ("lat", "lon"):
        axis = F.broadcast(grid.select(F.col(c).alias(f"grid_{c}")).distinct())  # one coordinate of a grid
        best = out.select(key, c).join(axis, F.lit(True)).groupBy(key).agg(F.min(F.struct(F.abs(F.col(c) - F.col(f"grid_{c}")).alias("d"), f"grid_{c}"))[f"grid_{c}"].alias(f"grid_{c}"))
        out = out.join(best, key)
    return out.select(key, "grid_lat", "grid_lon")


def conservative_weights(source: DataFrame, target: DataFrame, slat: float, slon: float, tlat: float, tlon: float) -> DataFrame:
    """``lat, lon, to_lat, to_lon, w``: shared area of source and target cells (in sin(lat) x degrees), longitudes periodic."""
    s = source.select("lat", "lon").distinct()
    t = target.select(F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")).distinct()
    up = F.least(F.col("lat") + slat / 2, F.col("to_lat") + tlat / 2)
    low = F.greatest(F.col("lat") - slat / 2, F.col("to_lat") - tlat / 2)
    apart = F.pmod(F.col("to_lon") - F.col("lon") + 180, F.lit(360.0)) - 180
    wide = F.least(F.lit(slon / 2), apart + tlon / 2) - F.greatest(F.lit(-slon / 2), apart - tlon / 2)
    pairs = s.join(sized(t), (F.abs(F.col("lat") - F.col("to_lat")) < (slat + tlat) / 2) & (F.abs(apart) < (slon + tlon) / 2))
    return pairs.withColumn("w", (F.sin(F.radians(up)) - F.sin(F.radians(low))) * wide).where("w > 1e-12")


def bilinear_weights(source: DataFrame, target: DataFrame, dlat: float, dlon: float) -> DataFrame:
    """Weights of the four cells around a target point on a regular source grid, longitudes periodic.

    Beyond the outermost row of cells that row is used.
    """
    s = source.select("lat", "lon").distinct()
    edge = F.broadcast(s.agg(F.min("lat").alias("_lo"), F.max("lat").alias("_hi")))
    t = target.select(F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")).distinct().crossJoin(edge)
    inside = F.least(F.greatest(F.col("to_lat"), F.col("_lo")), F.col("_hi"))
    apart = F.pmod(F.col("to_lon") - F.col("lon") + 180, F.lit(360.0)) - 180
    pairs = s.join(sized(t), (F.abs(F.col("lat") - inside) < dlat) & (F.abs(apart) < dlon))
    w = (1 - F.abs(F.col("lat") - inside) / dlat) * (1 - F.abs(apart) / dlon)
    return pairs.withColumn("w", w).drop("_lo", "_hi").where("w > 1e-12")


def regrid(field: DataFrame, weights: DataFrame, by: list[str], missing_limit: float = 0.75, value: str = "value") -> DataFrame:
    """Weighted mean of the source cells with a value; null where more than ``missing_limit`` of the weight is missing."""
    joined = field.select(*by, "lat", "lon", value).join(sized(weights), ["lat", "lon"])
    w = F.col("w")
    have = F.sum(F.when(F.col(value).isNotNull(), w))
    out = joined.groupBy(*by, F.col("to_lat").alias("lat_t"), F.col("to_lon").alias("lon_t")).agg(F.when(1 - F.coalesce(have, F.lit(0.0)) / F.sum(w) <= missing_limit, F.try_divide(F.sum(w * F.col(value)), have)).alias(value))
    return out.withColumnRenamed("lat_t", "lat").withColumnRenamed("lon_t", "lon")


def mask_cells(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Drops the cells of a mask table, such as ice sheets."""
    return field.join(sized(mask.select("lat", "lon").distinct()), ["lat", "lon"], "left_anti")


def lattice(spark: SparkSession, dlat: float, dlon: float, multiplicity: int = 1) -> DataFrame:
    """An equator-symmetric lattice of sites, each ``multiplicity`` times: ``pid, lat, lon``."""
    nlat = 2 * math.floor((90 - dlat / 2) / dlat) + 1
    half = (nlat - 1) // 2
    nlon = round(360 / dlon)
    k = F.floor(F.col("id") / multiplicity)
    return spark.range(nlat * nlon * multiplicity).select(F.col("id").alias("pid"), ((F.floor(k / nlon) - half) * dlat).cast("double").alias("lat"), ((k % nlon) * dlon).cast("double").alias("lon"))
