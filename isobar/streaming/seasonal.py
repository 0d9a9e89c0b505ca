"""Seasonal means of an unbounded stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeaxis as ta


def seasonal_means(stream: DataFrame, by: list[str], time: str = "ts", value: str = "value", late: str = "30 days") -> DataFrame:
    """``by, year, season, sum, n`` of a stream; update or complete mode.

    Sums and counts (not means) are the state, so batches can be added up; the
    watermark bounds how long a season is kept for late rows.
    """
    y, m = F.year(time), F.month(time)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(value).isNotNull())
    return rows.groupBy(*by, F.window(time, "92 days").alias("span"), ta.season_year(y, m).alias("year"), ta.season_of_month(m).alias("season")).agg(F.sum(value).alias("sum"), F.count(value).alias("n")).drop("span")


def means(parts: DataFrame, by: list[str]) -> DataFrame:
    """Means of the sums a sink has gathered; a season's parts from several spans are one."""
    return parts.groupBy(*by, "year", "season").agg((F.sum("sum") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
