"""Field tables drawn from the star-schema tables, as DataFrames and as SQL.

25 cells (nation keys on a 5 by 5 grid), 80 months from January 1995, fields
``tas`` (orders by customer) and ``tos`` (line items by supplier), five members
(order priority); 30 "years" of site records (a day of events is a year, two
hours a month); a 64-element state with one sample a vector (embeddings).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import proxies, resample


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _latlon(cell: Column) -> tuple[Column, Column]:
    return (F.floor(cell / 5) * 30 - 60).cast("double").alias("lat"), ((cell % 5) * 72 + 10).cast("double").alias("lon")


def grid(s: SparkSession) -> DataFrame:
    return s.range(25).select(F.col("id").cast("int").alias("cell"), *_latlon(F.col("id")))


def _dense(s: SparkSession, values: DataFrame, field: str, extra: list[str] | None = None) -> DataFrame:
    """All cells and months, null where nothing was recorded."""
    m = s.range(80).select((F.floor(F.col("id") / 12) + 1995).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    full = F.broadcast(grid(s)).crossJoin(m)  # 2,000 rows, fixed
    if extra:
        full = full.crossJoin(s.range(5).select(F.col("id").cast("int").alias("ens")))
    keys = ["cell", "year", "month", *(extra or [])]
    return full.join(values, keys, "left").select(F.lit(field).alias("field"), *(extra or []), "lat", "lon", "year", "month", "value")


def tas(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy(F.col("c_nationkey").alias("cell"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 99991.0).alias("value"))
    return _dense(s, v, "tas")


def _lines(s: SparkSession, d: str, expr: Column, field: str) -> DataFrame:
    o = read(s, d, "lineitem").join(read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    v = o.groupBy(F.col("s_nationkey").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.avg(expr).alias("value"))
    return _dense(s, v, field)


def tos(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d, F.col("l_extendedprice") / 9973.0, "tos")


def cells(s: SparkSession, d: str) -> DataFrame:
    return tas(s, d).unionByName(tos(s, d))


def cells_ens(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ens = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("ens")
    v = o.groupBy(F.col("c_nationkey").alias("cell"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), ens).agg((F.avg("o_totalprice") / 99991.0).alias("value"))
    return _dense(s, v, "tas", ["ens"])


def seasonal(s: SparkSession, d: str) -> DataFrame:
    return resample.average_seasonally(cells(s, d))


def columns(s: SparkSession, d: str) -> DataFrame:
    """Seven levels a cell: ``cell, lev, c, theta``."""
    o = read(s, d, "lineitem").join(read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = o.groupBy(F.col("s_nationkey").alias("cell"), F.col("l_linenumber").alias("level")).agg(F.least(F.avg("l_discount") * 5, F.lit(1.0)).alias("c"), F.avg("l_quantity").alias("theta"))
    # Clear gaps in the columns, so that blocks form.
    return g.select("cell", "level", (110_000.0 - F.col("level") * 15_000).alias("lev"), F.when((F.col("level") + F.col("cell")) % 3 == 0, 0.0).otherwise(F.col("c")).alias("value"), "theta", (F.col("level") * 100.0).alias("depth"))


def sites(s: SparkSession, d: str) -> DataFrame:
    p = F.col("pid")
    lat, lon = _latlon(p % 25)
    kind = F.when(p % 3 == 0, "coral").when(p % 3 == 1, "tree").otherwise("ice")
    return read(s, d, "events").select(F.col("user_id").cast("bigint").alias("pid")).distinct().select("pid", kind.alias("ptype"), F.when(p % 2 == 0, 1.0).otherwise(0.25).alias("dt"), (lat + ((p * 7) % 10 - 5) * 0.3).alias("lat"), (lon + ((p * 3) % 10 - 5) * 0.3).alias("lon"))


def samples(s: SparkSession, d: str) -> DataFrame:
    """``pid, t, value`` as recorded."""
    t = F.dayofmonth("ts") + (F.floor(F.hour("ts") / 2) + 0.5) / 12
    return read(s, d, "events").select(F.col("user_id").cast("bigint").alias("pid"), t.alias("t"), (F.col("value") / 100).alias("value"))


def site_obs(s: SparkSession, d: str) -> DataFrame:
    return proxies.seasonalize(samples(s, d))


def site_cells(s: SparkSession, d: str) -> DataFrame:
    """Fields on the sites' time axis: ``field, lat, lon, year, season, value``."""
    e = read(s, d, "events")
    slot = F.floor(F.hour("ts") / 2)
    month = (slot + 1).cast("int")
    lat, lon = _latlon(F.col("user_id") % 25)
    rows = e.select(F.explode(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("tas"), F.lit("tos"))).otherwise(F.array(F.lit("tas")))).alias("field"), lat, lon, (F.dayofmonth("ts") + (month == 12).cast("int")).alias("year"), F.floor((month % 12) / 3).cast("int").alias("season"), "value")
    return rows.groupBy("field", "lat", "lon", "year", "season").agg((F.avg("value") / 100).alias("value"))


def state_matrix(s: SparkSession, d: str) -> DataFrame:
    """``state_idx, sample_idx, x`` with zero mean over samples."""
    e = read(s, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("sample_idx"), F.posexplode("embedding").alias("state_idx", "x"))
    m = e.groupBy("state_idx").agg(F.avg(F.col("x").cast("double")).alias("_m"))
    return e.join(F.broadcast(m), "state_idx").select("state_idx", "sample_idx", (F.col("x").cast("double") - F.col("_m")).alias("x"))  # one row a state element


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero, for comparison with SQL."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- the same as SQL ----------------------------------------------------------

CTE: dict[str, str] = {
    "grid": "SELECT i::INT AS cell, (i // 5 * 30 - 60)::DOUBLE AS lat, (i % 5 * 72 + 10)::DOUBLE AS lon FROM range(25) r(i)",
    "mon": "SELECT (1995 + i // 12)::INT AS year, (i % 12 + 1)::INT AS month FROM range(80) r(i)",
    "tas0": "SELECT c_nationkey::INT AS cell, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, avg(o_totalprice) / 99991e0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3",
    "tos0": "SELECT s_nationkey::INT AS cell, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, avg(l_extendedprice / 9973e0) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    "ens0": "SELECT c_nationkey::INT AS cell, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, (substr(o_orderpriority, 1, 1)::INT - 1)::INT AS ens, avg(o_totalprice) / 99991e0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4",
    "tas": "SELECT 'tas' AS field, lat, lon, year, month, value FROM grid CROSS JOIN mon LEFT JOIN tas0 USING (cell, year, month)",
    "tos": "SELECT 'tos' AS field, lat, lon, year, month, value FROM grid CROSS JOIN mon LEFT JOIN tos0 USING (cell, year, month)",
    "cells": "SELECT * FROM tas UNION ALL SELECT * FROM tos",
    "cells_ens": "SELECT 'tas' AS field, ens, lat, lon, year, month, value FROM grid CROSS JOIN mon CROSS JOIN (SELECT i::INT AS ens FROM range(5) r(i)) LEFT JOIN ens0 USING (cell, year, month, ens)",
    "seas0": "SELECT field, lat, lon, (year + (month = 12)::INT)::INT AS year, (month % 12 // 3)::INT AS season, year * 12 + month AS step, value, day(last_day(make_date(year, month, 1))) AS dim FROM cells",
    "seas_ends": "SELECT year, season, count(DISTINCT step) AS n FROM seas0 GROUP BY 1, 2",
    "seas_drop": "SELECT year, season FROM seas_ends WHERE n < 3 AND (year * 4 + season IN (SELECT min(year * 4 + season) FROM seas_ends) OR year * 4 + season IN (SELECT max(year * 4 + season) FROM seas_ends))",
    "seas": "SELECT field, lat, lon, year, season, avg(value * dim) / avg(dim) AS value FROM seas0 WHERE (year, season) NOT IN (SELECT year, season FROM seas_drop) GROUP BY 1, 2, 3, 4, 5",
    "clim": "SELECT field, lat, lon, season, avg(value) AS climatology FROM seas WHERE year + (season * 3 + 0.5e0) / 12 >= 1996 AND year + (season * 3 + 0.5e0) / 12 < 2000 GROUP BY 1, 2, 3, 4",
    "anom": "SELECT field, lat, lon, year, season, value - climatology AS value FROM seas LEFT JOIN clim USING (field, lat, lon, season)",
    "cols": "SELECT s_nationkey::INT AS cell, l_linenumber::INT AS level, 110000e0 - l_linenumber * 15000 AS lev, CASE WHEN (l_linenumber + s_nationkey) % 3 = 0 THEN 0e0 ELSE least(avg(l_discount) * 5, 1e0) END AS value, avg(l_quantity) AS theta, l_linenumber * 100e0 AS depth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_linenumber",
    "sites": "SELECT pid, CASE pid % 3 WHEN 0 THEN 'coral' WHEN 1 THEN 'tree' ELSE 'ice' END AS ptype, CASE WHEN pid % 2 = 0 THEN 1e0 ELSE 0.25e0 END AS dt, (pid % 25 // 5 * 30 - 60)::DOUBLE + (pid * 7 % 10 - 5) * 0.3e0 AS lat, (pid % 5 * 72 + 10)::DOUBLE + (pid * 3 % 10 - 5) * 0.3e0 AS lon FROM (SELECT DISTINCT user_id::BIGINT AS pid FROM events)",
    "samples": "SELECT user_id::BIGINT AS pid, day(ts) + (hour(ts) // 2 + 0.5e0) / 12 AS t, day(ts) AS d, hour(ts) // 2 + 1 AS month, value / 100 AS value FROM events",
    "so0": "SELECT pid, (d + (month = 12)::INT)::INT AS year, (month % 12 // 3)::INT AS season, avg(value) AS value, count(DISTINCT t) AS n FROM samples GROUP BY 1, 2, 3",
    "so1": "SELECT *, year * 4 + season AS k, min(year * 4 + season) OVER (PARTITION BY pid) AS a, max(year * 4 + season) OVER (PARTITION BY pid) AS z FROM so0",
    "site_obs": "SELECT pid, year, season, value FROM so1 WHERE NOT (k = a OR k = z) OR n >= 3",
    "site_cells": "SELECT f.field, (user_id % 25 // 5 * 30 - 60)::DOUBLE AS lat, (user_id % 5 * 72 + 10)::DOUBLE AS lon, (day(ts) + (hour(ts) // 2 = 11)::INT)::INT AS year, ((hour(ts) // 2 + 1) % 12 // 3)::INT AS season, avg(value) / 100 AS value FROM events JOIN (SELECT 'tas' AS field, 0 AS m UNION ALL SELECT 'tos', 2) f ON f.m = 0 OR event_id % 2 = 0 GROUP BY 1, 2, 3, 4, 5",
    "sm0": "SELECT vec_id::BIGINT AS sample_idx, (unnest(generate_series(1, len(embedding))) - 1)::INT AS state_idx, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "sm": "SELECT sample_idx, state_idx, x - avg(x) OVER (PARTITION BY state_idx) AS x FROM sm0",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the views it needs; ``r{expr}`` rounds to six digits."""
    views = CTE | (extra or {})
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                visit(views[name])

    visit(body)
    body = ", ".join(f"{n} AS ({views[n]})" for n in views if n in need) + ("\n" + body if need else body)
    body = ("WITH " if need else "") + body
    out, at = [], 0
    while (k := body.find("r{", at)) >= 0:
        depth, end = 1, k + 2
        while depth:
            depth += {"{": 1, "}": -1}.get(body[end], 0)
            end += 1
        out.append(body[at:k] + "(round(" + body[k + 2 : end - 1] + ", 6) + 0e0)")
        at = end
    return "".join(out) + body[at:]
