"""Products of a reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indices, reduce, resample
from ..operators.mapper import Mapper

STEP = ["year", "season"]


def ensemble_mean(reduced: DataFrame, by: list[str]) -> DataFrame:
    """Mean in reduced space: mapping back is linear, so members need not be mapped first."""
    return reduced.groupBy(*by, "state").agg(F.avg("x").alias("x"))


def collate(parts: DataFrame, members: list[int], ens_per_iteration: int) -> DataFrame:
    """Chosen members of all iterations under disjoint numbers."""
    k = F.create_map(*[F.lit(v) for i, m in enumerate(members) for v in (m, i)])
    return parts.where(F.col("ens").isin(*members)).withColumn("ens", F.col("iteration") * ens_per_iteration + k[F.col("ens")])


def physical(reduced: DataFrame, mapper: Mapper, by: list[str], places: DataFrame | None = None) -> DataFrame:
    return mapper.backward(reduced, by, places)


def products(cells: DataFrame, reference: tuple[float, float], ens: bool = True) -> dict[str, DataFrame]:
    """Anomalies and what is derived from them: regional and zonal means, indices, ensemble statistics."""
    members = ["ens"] if ens else []
    t = F.col("year") + (F.col("season") * 3 + 0.5) / 12
    anom = resample.anomalize(cells, "season", ["field", *members, "lat", "lon"], period=reference, t=t, ensemble_mean="ens" if ens else None)
    step = [*members, *STEP]
    tos = anom.where("field = 'tos'")
    regional = reduce.regional_means(anom, ["field", *step])
    return {
        "anomalies": anom,
        "regional": regional,
        "zonal": reduce.plain_mean(anom, ["field", *step, "lat"]),
        "nino34": indices.nino34(tos, step),
        "amo": indices.amo(tos, step),
        "ipo_tpi": indices.ipo_tripole(tos, step),
    } | ({"statistics": reduce.ensemble_stats(regional, ["field", *STEP, "region"])} if ens else {})
