"""Weighted means, errors and ensemble statistics of long field tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import area_weight


def weighted_mean(df: DataFrame, by: list[str], weight: Column, value: str = "value") -> DataFrame:
    """``sum(w v) / sum(w)`` over rows with a value."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(weight * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), weight))).alias(value))


def area_weighted_mean(df: DataFrame, by: list[str], squared: bool = False, value: str = "value") -> DataFrame:
    """Mean over space with weight cos(lat) (or its square); keep ``lat`` in ``by`` for zonal means, ``lon`` for meridional ones."""
    return weighted_mean(df, by, area_weight(F.col("lat"), squared), value)


def plain_mean(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def regional_means(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Area-weighted means of the globe and both hemispheres (the equator is in both), in one pass."""
    w, lat = area_weight(F.col("lat")), F.col("lat")

    def mean(inside: Column) -> Column:
        here = F.when(inside & F.col(value).isNotNull(), w)
        return F.try_divide(F.sum(here * F.col(value)), F.sum(here))

    wide = df.groupBy(*by).agg(mean(F.lit(True)).alias("global"), mean(lat >= 0).alias("nh"), mean(lat <= 0).alias("sh"))
    return wide.unpivot(by, ["global", "nh", "sh"], "region", value)


def hemisphere_split(df: DataFrame, value: str = "value") -> DataFrame:
    """``north`` and ``south`` parts; the equator is in neither."""
    return df.withColumns({"north": F.when(F.col("lat") > 0, F.col(value)), "south": F.when(F.col("lat") < 0, F.col(value))})


def errors(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str = "value") -> DataFrame:
    """``mse, rmse`` over the rows that both tables have."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return both.groupBy(*by).agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def area_weighted_errors(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Mean squared error of each cell over time, then its area-weighted mean, and the root."""
    cell = errors(a, b, keys, [*by, "lat", "lon"], value)
    return area_weighted_mean(cell.drop("rmse"), by, value="mse").withColumn("rmse", F.sqrt("mse"))


def coefficient_of_efficiency(test: DataFrame, truth: DataFrame, keys: list[str], by: list[str], value: str = "value") -> DataFrame:
    """``1 - sum((v - x)^2) / sum((v - mean v)^2)`` over the times that both have."""
    both = test.select(*keys, F.col(value).alias("x")).join(truth.select(*keys, F.col(value).alias("v")), keys)
    # Sums about the mean from one pass: n * var_pop.
    return both.groupBy(*by).agg((1 - F.try_divide(F.sum((F.col("v") - F.col("x")) ** 2), F.var_pop("v") * F.count("v"))).alias("ce"))


def field_std(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Root of the area-weighted *sum* over cells of the variance in time."""
    var = df.groupBy(*by, "lat", "lon").agg(F.var_samp(value).alias("v"))
    return var.groupBy(*by).agg(F.sqrt(F.sum(area_weight(F.col("lat")) * F.col("v"))).alias("std"))


def effective_dof(df: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Samples left after lag-1 autocorrelation (mean over series): ``n (1 - r^2) / (1 + r^2)``; series without gaps."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(w))
    lagged = d.withColumn("_p", F.lag("_d").over(w.orderBy(*order)))
    each = lagged.groupBy(*by).agg(F.count("_d").alias("n"), F.avg(F.col("_d") * F.col("_p")).alias("c"), F.avg(F.col("_d") * F.col("_d")).alias("v"))
    return each.agg(F.max("n").alias("n"), F.avg(F.try_divide(F.col("c"), F.col("v"))).alias("r")).select("n", "r", (F.col("n") * (1 - F.col("r") ** 2) / (1 + F.col("r") ** 2)).alias("dof"))


def ensemble_stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def ensemble_quantiles(df: DataFrame, by: list[str], level: float = 0.9, value: str = "value") -> DataFrame:
    """Central interval of the given mass (linear interpolation between members)."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit((1 - level) / 2)).alias("lower"), F.percentile(value, F.lit((1 + level) / 2)).alias("upper"))


def ensemble_hdi(df: DataFrame, by: list[str], level: float = 0.6, value: str = "value") -> DataFrame:
    """Narrowest interval that holds ``floor(level n)`` steps between ordered members; the lowest on ties."""
    members = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    k = F.floor(F.lit(level) * F.size("v")).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.size("v") - 1 - F.col("k")), lambda i: F.struct((F.col("v")[i + F.col("k")] - F.col("v")[i]).alias("w"), i.alias("i")))
    best = members.withColumn("k", k).withColumn("best", F.array_min(spans)["i"])
    return best.select(*by, F.col("v")[F.col("best")].alias("lower"), F.col("v")[F.col("best") + F.col("k")].alias("upper"))


def multimodel_mean(models: list[DataFrame], keys: list[str], time: list[str], value: str = "value") -> DataFrame:
    """Mean over models (missing ones skipped) at the times that all have."""
    rows = None
    for k, m in enumerate(models):
        own = m.select(*keys, value, F.lit(k).alias("_m"))
        rows = own if rows is None else rows.unionByName(own)
    common = rows.groupBy(*time).agg(F.countDistinct("_m").alias("_n")).where(F.col("_n") == len(models)).select(*time)
    return rows.join(F.broadcast(common), time, "left_semi").groupBy(*keys).agg(F.avg(value).alias(value))


def land_mask(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Cells of an ocean field that never have a value are land."""
    return df.groupBy(*by).agg((F.count(value) == 0).alias("land"))


def inflate(df: DataFrame, by: list[str], factor: float, value: str = "value") -> DataFrame:
    """Ensemble perturbations times the root of ``factor``."""
    mean = F.avg(value).over(Window.partitionBy(*by))
    return df.withColumn(value, mean + (F.col(value) - mean) * F.lit(factor**0.5))


def add_climatology_clipped(df: DataFrame, clim: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0, value: str = "value") -> DataFrame:
    return df.join(clim, keys, "left").withColumn(value, F.least(F.greatest(F.col(value) + F.col("climatology"), F.lit(low)), F.lit(high))).drop("climatology")


def hybrid_climatology(a: DataFrame, b: DataFrame, end_year: int, by: list[str], step: str, value: str = "value") -> DataFrame:
    """Climatology of source ``a`` before ``b`` begins, then of ``b`` up to ``end_year`` (exclusive)."""
    start = F.broadcast(b.agg(F.min(F.struct("year", step)).alias("_s")))
    early = a.crossJoin(start).where(F.struct("year", step) < F.col("_s")).drop("_s")
    both = early.unionByName(b.where(F.col("year") < end_year))
    return both.groupBy(*by, step).agg(F.avg(value).alias("climatology"))


def merge_intervals(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """Overlapping or touching intervals become one (gaps and islands)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(start, end) if by else Window.partitionBy(F.lit(0)).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_r", reach).withColumn("_new", F.when(F.col("_r").isNull() | (F.col(start) > F.col("_r")), 1).otherwise(0))
    return new.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def energy_imbalance(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``eei = rsdt - rsut - rlut`` from long fields."""
    wide = df.groupBy(*keys).pivot("field", ["rsdt", "rsut", "rlut"]).agg(F.first(value))
    return wide.withColumn("eei", F.col("rsdt") - F.col("rsut") - F.col("rlut"))
