"""Time-axis algebra as column expressions.

A season is a number (0 DJF, 1 MAM, 2 JJA, 3 SON) with a year; December
belongs to the next year's DJF.  Decimal years stand at the middle of a month
or season.  Rows are joined on (year, season) or (year, month), never on
decimal years.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class TimeAxis(Enum):
    """What one step of a table's time is."""

    MONTHLY_DATE = "monthly"
    SEASONAL = "seasonal"
    ANNUAL = "annual"
    SUBSEASONAL_DECIMAL = "subseasonal"


SEASONS = ("DJF", "MAM", "JJA", "SON")
ANNUAL = (0, 1, 2, 3)
#: Days of each season in an average year.
SEASON_DAYS = (90.25, 92.0, 92.0, 91.0)


def season_of_month(month: Column) -> Column:
    return F.floor((month % 12) / 3).cast("int")


def season_year(year: Column, month: Column) -> Column:
    return (year + (month == 12).cast("int")).cast("int")


def season_to_decimal(year: Column, season: Column) -> Column:
    """The middle of the season's middle month."""
    return year + (season * 3 + 0.5) / 12


def _twelfths(t: Column) -> Column:
    return (t - F.floor(t)) * 12


def decimal_to_season(t: Column) -> Column:
    """Season of a decimal year; null exactly on a border (2, 5, 8, 11 twelfths)."""
    d = _twelfths(t)
    return F.when(d.isin(2.0, 5.0, 8.0, 11.0), None).otherwise(F.when((d < 2) | (d > 11), 0).when(d < 5, 1).when(d < 8, 2).otherwise(3)).cast("int")


def round_to_season(t: Column) -> tuple[Column, Column]:
    """(year, season) of the nearest season; from 11 twelfths on it is the next year's DJF."""
    d = _twelfths(t)
    year = F.floor(t).cast("int") + (d >= 11).cast("int")
    return year, F.when((d < 2) | (d >= 11), 0).when(d < 5, 1).when(d < 8, 2).otherwise(3).cast("int")


def decimal_to_month(t: Column) -> Column:
    """Month that holds the decimal year."""
    return (F.floor(_twelfths(t)) + 1).cast("int")


def decimal_to_tuple(t: Column) -> tuple[Column, Column]:
    """(year, season) by truncation and ``decimal_to_season``."""
    return t.cast("int"), decimal_to_season(t)


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def decimal_to_date(t: Column, leap_years: bool = True) -> Column:
    """Date of a decimal year (years 1 to 9999).

    With ``leap_years`` the fraction counts days of the year as it is;
    without, all years have 365 days and the result is ``yyyy-mm-dd`` as text,
    which may name no Gregorian date less than 29 February.
    """
    year = F.floor(t).cast("int")
    if leap_years:
        size = F.when(_leap(year), 366).otherwise(365)
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.floor((t - year) * size + F.lit(1e-9)).cast("int"))
    day = F.floor((t - year) * 365 + F.lit(1e-9)).cast("int")
    # Any year of 365 days names month and day.
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), day), "-MM-dd"))


def date_to_decimal(d: Column, equal_month_lengths: bool = True) -> Column:
    if equal_month_lengths:
        return F.year(d) + (F.month(d) - 0.5) / 12
    return F.year(d) + (F.dayofyear(d) - 1) / F.when(_leap(F.year(d)), 366).otherwise(365)


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def format_tuple(year: Column, season: Column, year_first: bool = True) -> Column:
    """``YYYY-DJF`` or ``DJF YYYY``."""
    label = season_label(season)
    y = F.lpad(year.cast("string"), 4, "0")
    return F.concat(y, F.lit("-"), label) if year_first else F.concat(label, F.lit(" "), y)


def season_label(season: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), season + 1)


def shift_to_year_middle(t: Column) -> Column:
    return F.floor(t) + 0.5


def time_resolution(df: DataFrame, t: str = "t", by: list[str] | None = None) -> DataFrame:
    """Median step of the distinct times (of each group) and its name: annual, seasonal, monthly or other (5 % tolerance)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(t) if by else Window.partitionBy(F.lit(0)).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    out = df.select(*by, t).distinct().withColumn("_d", step).groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("step"))
    near = lambda x: F.abs(F.col("step") - x) <= 0.05 * x
    return out.withColumn("resolution", F.when(near(1.0), "annual").when(near(0.25), "seasonal").when(near(1 / 12), "monthly").otherwise("other"))


def split_seasonality(seasons: list[int]) -> tuple[list[int], list[int]]:
    """(seasons counted to the year before, seasons of the labelled year) of a contiguous list; a DJF inside starts the year."""
    if not seasons:
        raise ValueError("no seasons given")
    if len(set(seasons)) != len(seasons):
        raise ValueError("a season is given twice")
    if any(s not in ANNUAL for s in seasons):
        raise ValueError("unknown season")
    if any((b - a) % 4 != 1 for a, b in zip(seasons, seasons[1:], strict=False)):
        raise ValueError("seasons must follow one another")
    at = seasons.index(0) if 0 in seasons else 0
    return seasons[:at], seasons[at:]
