"""Calendar-aware resampling, climatologies and anomalies of long field tables.

Missing values are null.  Weighted means follow one rule: values are
multiplied by their step's weight relative to the mean weight of the group
(which counts steps with missing values too) before the mean skips nulls.

Incomplete groups are dropped at the two ends of the *global* time axis only;
gaps inside are kept.  The distinct steps of the axis are a few thousand rows
at most (12 a year), whatever the size of the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeaxis as ta

CELL = ["field", "lat", "lon"]


def _trimmed(df: DataFrame, label: list[str], step: list[str], least: int) -> DataFrame:
    """Drops the first and last group of the axis if it has fewer than ``least`` distinct source steps."""
    axis = df.groupBy(*label).agg(F.countDistinct(*step).alias("_steps"))
    ends = axis.agg(F.min(F.struct(*label)).alias("_lo"), F.max(F.struct(*label)).alias("_hi"))
    # One row for each time step of the axis, bounded by the calendar.
    good = axis.crossJoin(F.broadcast(ends)).where(~((F.struct(*label) == F.col("_lo")) | (F.struct(*label) == F.col("_hi"))) | (F.col("_steps") >= least)).select(*label)
    return df.join(F.broadcast(good), label, "left_semi")


def _weighted(df: DataFrame, keys: list[str], weight: Column | None, value: str) -> DataFrame:
    v = F.avg(value) if weight is None else F.avg(F.col(value) * weight) / F.avg(weight)
    return df.groupBy(*keys).agg(v.alias(value))


def average_seasonally(df: DataFrame, by: list[str] | None = None, value: str = "value", weight_months: bool = True, trim: bool = True) -> DataFrame:
    """Monthly to ``year, season``; months weighted by their days."""
    by = CELL if by is None else by
    y, m = F.col("year"), F.col("month")
    s = df.select(*by, ta.season_year(y, m).alias("year"), ta.season_of_month(m).alias("season"), y.alias("_y"), m.alias("_m"), value)
    if trim:
        s = _trimmed(s, ["year", "season"], ["_y", "_m"], 3)
    return _weighted(s, [*by, "year", "season"], ta.days_in_month(F.col("_y"), F.col("_m")) if weight_months else None, value)


def average_annually_monthly(df: DataFrame, by: list[str] | None = None, value: str = "value", first_month: int | None = None, weight_months: bool = True, trim: bool = True) -> DataFrame:
    """Monthly to years that begin in ``first_month``; without it, December counts to the next year."""
    by = CELL if by is None else by
    y, m = F.col("year"), F.col("month")
    year = ta.season_year(y, m) if first_month is None else (y - (m < first_month).cast("int")).cast("int")
    s = df.select(*by, year.alias("year"), y.alias("_y"), m.alias("_m"), value)
    if trim:
        s = _trimmed(s, ["year"], ["_y", "_m"], 12)
    return _weighted(s, [*by, "year"], ta.days_in_month(F.col("_y"), F.col("_m")) if weight_months else None, value)


def average_annually_seasonal(df: DataFrame, by: list[str] | None = None, value: str = "value", weight_months: bool = True, trim: bool = True) -> DataFrame:
    """Seasons to years (DJF counts to its own year), weighted by the average lengths of the seasons."""
    by = CELL if by is None else by
    s = df.select(*by, "year", "season", value)
    if trim:
        s = _trimmed(s, ["year"], ["season"], 4)
    days = F.element_at(F.array(*map(F.lit, ta.SEASON_DAYS)), F.col("season") + 1)
    return _weighted(s, [*by, "year"], days if weight_months else None, value)


def annualize(df: DataFrame, seasonality: list[int], by: list[str] | None = None, value: str = "value", trim: bool = True) -> DataFrame:
    """Unweighted mean over the seasons of a seasonality; seasons before a DJF in it count to the next year."""
    by = CELL if by is None else by
    before, own = ta.split_seasonality(list(seasonality))
    s = df.where(F.col("season").isin(*seasonality)).select(*by, (F.col("year") + F.col("season").isin(*before).cast("int") if before else F.col("year")).cast("int").alias("label"), "season", value)
    s = s.withColumnRenamed("label", "year")
    if trim:
        s = _trimmed(s, ["year"], ["season"], len(seasonality))
    return _weighted(s, [*by, "year"], None, value)


def climatology(df: DataFrame, step: str | None, by: list[str] | None = None, value: str = "value", period: tuple[float, float] | None = None, t: Column | None = None, closed: bool = False) -> DataFrame:
    """Mean over ``period`` (``[start, end)``, or ``[start, end]`` if ``closed``) for each group and calendar step."""
    by = CELL if by is None else by
    t = F.col("year") if t is None else t
    if period:
        df = df.where((t >= period[0]) & ((t <= period[1]) if closed else (t < period[1])))
    return df.groupBy(*by, *([step] if step else [])).agg(F.avg(value).alias("climatology"))


def anomalize(df: DataFrame, step: str | None, by: list[str] | None = None, value: str = "value", period: tuple[float, float] | None = None, t: Column | None = None, closed: bool = False, given: DataFrame | None = None, ensemble_mean: str | None = None) -> DataFrame:
    """Values minus the climatology of their group and calendar step.

    The climatology is ``given`` or computed over ``period``; with
    ``ensemble_mean`` (a column of ``by``) it is shared by all members.
    """
    by = CELL if by is None else by
    over = [c for c in by if c != ensemble_mean]
    clim = given if given is not None else climatology(df, step, over, value, period, t, closed)
    return df.join(clim, [*over, *([step] if step else [])], "left").withColumn(value, F.col(value) - F.col("climatology")).drop("climatology")


def daily_to_monthly(df: DataFrame, by: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """Calendar-month means, stamped with the month's first day."""
    return df.groupBy(*by, F.trunc(date, "month").alias("month_start")).agg(F.avg(value).alias(value))


def stitch(early: DataFrame, late: DataFrame, by: list[str], value: str = "value", overlap_years: int = 5, shift: bool = True, max_gap: int = 2) -> DataFrame:
    """One seasonal series from an earlier and a later run.

    The later run's start ends the earlier.  With ``shift`` the later run is
    moved by the difference of the groups' means over the earlier run's last
    and the later run's first ``overlap_years`` years.  Missing seasons between
    them (at most ``max_gap``, else an error at run time) are the mean of the
    values four seasons before and after.
    """
    start = late.agg(F.min(F.struct("year", "season"))["year"].alias("y0"), F.min(F.struct("year", "season"))["season"].alias("s0"))
    k = lambda d: d["year"] * 4 + d["season"]
    cut = early.crossJoin(F.broadcast(start)).where(F.col("year") * 4 + F.col("season") < F.col("y0") * 4 + F.col("s0")).drop("y0", "s0")
    if shift:
        last = F.broadcast(cut.agg(F.max(F.col("year")).alias("e")))
        first = F.broadcast(late.agg(F.min("year").alias("b")))
        a = cut.crossJoin(last).where(F.col("year") > F.col("e") - overlap_years).groupBy(*by).agg(F.avg(value).alias("a"))
        b = late.crossJoin(first).where(F.col("year") < F.col("b") + overlap_years).groupBy(*by).agg(F.avg(value).alias("b"))
        late = late.join(a.join(b, by), by, "left").withColumn(value, F.col(value) + F.coalesce(F.col("a") - F.col("b"), F.lit(0.0))).drop("a", "b")
    both = cut.select(*by, "year", "season", value).unionByName(late.select(*by, "year", "season", value)).withColumn("k", k({"year": F.col("year"), "season": F.col("season")}))
    span = F.broadcast(cut.agg((F.max(F.col("year") * 4 + F.col("season")) + 1).alias("from")).crossJoin(start.select((F.col("y0") * 4 + F.col("s0") - 1).alias("to"))))
    gap = span.where(F.col("from") <= F.col("to")).withColumn("_ok", F.when(F.col("to") - F.col("from") >= max_gap, F.raise_error(F.lit("the gap between the runs is too long"))))
    missing = gap.where(F.col("_ok").isNull()).select(F.explode(F.sequence("from", "to")).alias("k"))
    around = both.select(*by, F.explode(F.array(F.col("k") - 4, F.col("k") + 4)).alias("k"), value).join(F.broadcast(missing), "k")
    filled = around.groupBy(*by, "k").agg(F.avg(value).alias(value)).select(*by, F.floor(F.col("k") / 4).cast("int").alias("year"), F.pmod("k", F.lit(4)).cast("int").alias("season"), value)
    return both.drop("k").unionByName(filled)
