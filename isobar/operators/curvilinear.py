"""Regridding from curvilinear grids: bilinear in quadrilaterals, inverse-distance extrapolation.

A source grid is ``i, j, lat, lon``; four neighbouring points are a cell.  Points
are taken as unit vectors and put into cubes of space, so that neither a pole
nor a meridian is special: a cell is entered in every cube that its bounding box
touches, a target looks into its own cube, and they meet by an equi-join.  A
target's cell and place in it are found in the plane that touches the sphere at
the target: its corners are projected there, and the bilinear map of the cell is
inverted at the origin.

Targets in no cell may be extrapolated from their ``k`` nearest source points,
weighted by the inverse square of the distance.  The search looks into cubes of
growing size until a target's ``k`` points are surely among those seen.

Results are weights ``lat, lon, to_lat, to_lon, w`` for ``spatial.regrid``; a
target on an edge belongs to the cell that comes first by ``j, i``; a target
without a cell has no weights unless it is extrapolated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Slack of a place in its cell, so that a target on an edge has one in spite of rounding.
EDGE = 1e-9


def unit_vector(lat: Column, lon: Column) -> Column:
    a, o = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))


def quadrilaterals(grid: DataFrame, periodic: bool = True) -> DataFrame:
    """``i, j, corners``: cells with their four corners in turn, ``(lat, lon)``; with ``periodic`` the last column meets the first."""
    point = F.struct("lat", "lon").alias("p")
    points = grid.select("i", "j", point)
    if periodic:
        n = grid.agg((F.max("i") - F.min("i") + 1).alias("n"), F.min("i").alias("a")).first()
        points_right = points.select((F.pmod(F.col("i") - 1 - n["a"], F.lit(n["n"])) + n["a"]).cast("long").alias("i"), "j", F.col("p").alias("q"))
    else:
        points_right = points.select((F.col("i") - 1).alias("i"), "j", F.col("p").alias("q"))
    row = points.join(points_right, ["i", "j"])
    up = row.select("i", (F.col("j") - 1).alias("j"), F.col("p").alias("r"), F.col("q").alias("s"))
    return row.join(up, ["i", "j"]).select("i", "j", F.array("p", "q", "s", "r").alias("corners"))


def _cubes(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def place_in_cell(corners: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(inside, s, t)``: whether each target lies in its cell, and where along the cell's first and second direction.

    ``corners`` are ``[pair, corner, (lat, lon)]``, in turn.
    """
    a, o = np.radians(lat)[:, None], np.radians(lon)[:, None]
    ca, co = np.radians(corners[:, :, 0]), np.radians(corners[:, :, 1])
    v = np.cos(ca) * np.cos(co), np.cos(ca) * np.sin(co), np.sin(ca)
    front = v[0] * np.cos(a) * np.cos(o) + v[1] * np.cos(a) * np.sin(o) + v[2] * np.sin(a)
    with np.errstate(all="ignore"):  # what is not a number is in no cell
        flat = np.stack([(v[1] * np.cos(o) - v[0] * np.sin(o)) / front, (v[2] * np.cos(a) - v[0] * np.sin(a) * np.cos(o) - v[1] * np.sin(a) * np.sin(o)) / front], axis=2)
        p, b, c = flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 3] - flat[:, 0]
        d = flat[:, 0] - flat[:, 1] - flat[:, 3] + flat[:, 2]
        cross = lambda x, y: x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]
        # p + s b + t c + s t d = 0: p + t c and b + t d are parallel.
        k2, k1, k0 = cross(c, d), cross(p, d) + cross(c, b), cross(p, b)
        disc = k1 * k1 - 4 * k2 * k0
        q = -(k1 + np.where(k1 < 0, -1, 1) * np.sqrt(np.maximum(disc, 0))) / 2
        inside, at = np.zeros(len(p), bool), np.zeros((len(p), 2))
        for t in (k0 / q, q / k2):
            w = b + t[:, None] * d
            s = -((p + t[:, None] * c) * w).sum(axis=1) / (w * w).sum(axis=1)
            here = (front > 1e-6).all(axis=1) & (disc >= 0) & (np.minimum(s, t) >= -EDGE) & (np.maximum(s, t) <= 1 + EDGE) & ~inside
            at[here] = np.column_stack([s, t])[here]
            inside |= here
    return inside, *np.clip(at, 0, 1).T


def _placed(pairs: DataFrame) -> DataFrame:
    """``to_lat, to_lon, j, i, corners, s, t`` of the pairs whose target is in the cell."""
    names = ["to_lat", "to_lon", "j", "i", *[f"x{m}" for m in range(8)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                corners = np.column_stack([rb.column(4 + m).to_numpy(zero_copy_only=False) for m in range(8)]).reshape(-1, 4, 2)
                inside, s, t = place_in_cell(corners, *(rb.column(m).to_numpy(zero_copy_only=False) for m in (0, 1)))
                kept = rb.filter(pa.array(inside))
                yield pa.record_batch([*kept.columns, pa.array(s[inside]), pa.array(t[inside])], names=[*names, "s", "t"])

    schema = "to_lat double, to_lon double, j long, i long, " + ", ".join(f"x{m} double" for m in range(8)) + ", s double, t double"
    return pairs.select("to_lat", "to_lon", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), *[F.col("corners")[m // 2][("lat", "lon")[m % 2]].alias(f"x{m}") for m in range(8)]).mapInArrow(run, schema)


def curvilinear_weights(grid: DataFrame, target: DataFrame, periodic: bool = True, extrapolate: bool = False, k: int = 8) -> DataFrame:
    """``lat, lon, to_lat, to_lon, w`` of the target points ``(lat, lon)``; the weights of a target sum to 1."""
    vectors = F.transform("corners", lambda c: unit_vector(c["lat"], c["lon"]))
    cells = written(quadrilaterals(grid, periodic).select("*", vectors.alias("v")))
    axis = lambda m: F.transform("v", lambda x: x[m])
    boxed = written(cells.select("i", "j", "corners", *[f(axis(m)).alias(f"{n}{m}") for m in range(3) for n, f in (("lo", F.array_min), ("hi", F.array_max))]))
    # Cubes about as large as most cells; a larger cell is entered in more of them.
    extent = F.greatest(*[F.col(f"hi{m}") - F.col(f"lo{m}") for m in range(3)])
    size = max(boxed.agg(F.percentile_approx(extent, 0.9).alias("e")).first()["e"] or 0.0, 1e-6)
    entered = boxed.withColumn("e", extent)
    for m in range(3):
        # The sphere bulges out of the box of the corners by less than half the extent.
        entered = entered.withColumn(f"c{m}", F.explode(_cubes(F.col(f"lo{m}") - F.col("e") / 2, F.col(f"hi{m}") + F.col("e") / 2, size)))
    points = target.select(F.col("lat").cast("double").alias("to_lat"), F.col("lon").cast("double").alias("to_lon")).distinct()
    looking = points.withColumn("n", unit_vector(F.col("to_lat"), F.col("to_lon"))).select("to_lat", "to_lon", *[F.floor(F.col("n")[m] / size).cast("int").alias(f"c{m}") for m in range(3)])
    met = _placed(looking.join(entered.select("i", "j", "corners", "c0", "c1", "c2"), ["c0", "c1", "c2"]))
    whole = F.struct("s", "t", *[f"x{m}" for m in range(8)])
    found = written(met.groupBy("to_lat", "to_lon").agg(F.min_by(whole, F.struct("j", "i")).alias("x")).select("to_lat", "to_lon", "x.*"))
    s, t = F.col("s"), F.col("t")
    parts = [F.struct(F.col(f"x{2 * m}").alias("lat"), F.col(f"x{2 * m + 1}").alias("lon"), w.alias("w")) for m, w in enumerate(((1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t))]
    out = found.select("to_lat", "to_lon", F.explode(F.array(*parts)).alias("x")).groupBy(F.col("x.lat").alias("lat"), F.col("x.lon").alias("lon"), "to_lat", "to_lon").agg(F.sum("x.w").alias("w")).where("w > 1e-12")
    if extrapolate:
        outside = points.join(found.select("to_lat", "to_lon"), ["to_lat", "to_lon"], "left_anti")
        out = out.unionByName(inverse_distance_weights(grid, outside, size, k))
    return out


def inverse_distance_weights(grid: DataFrame, targets: DataFrame, size: float, k: int = 8) -> DataFrame:
    """Weights of the ``k`` nearest source points of ``targets(to_lat, to_lon)``; a point at the target itself has all the weight."""
    source = written(grid.select("lat", "lon").distinct().select("lat", "lon", unit_vector(F.col("lat"), F.col("lon")).alias("v")))
    left = written(targets.select("to_lat", "to_lon", unit_vector(F.col("to_lat"), F.col("to_lon")).alias("n")))
    k = min(k, source.count())
    out = None
    while k and not left.isEmpty():
        cube = lambda v, m, h=size: F.floor(v[m] / h).cast("int")
        around = left
        for m in range(3):
            around = around.withColumn(f"c{m}", F.explode(F.sequence(cube(F.col("n"), m) - 1, cube(F.col("n"), m) + 1)))
        held = source.select("*", *[cube(F.col("v"), m).alias(f"c{m}") for m in range(3)])
        pairs = around.join(held, ["c0", "c1", "c2"])
        chord = F.sqrt(F.aggregate(F.zip_with("n", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        whole = size >= 2.0  # neighbours of any cube are the sphere
        # Within a cube's size of the target nothing is missed.
        near = pairs.select("to_lat", "to_lon", F.struct(chord.alias("d"), "lat", "lon").alias("x")).where(F.lit(whole) | (F.col("x.d") <= size))
        top = near.groupBy("to_lat", "to_lon").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("x")).where(F.size("x") == k)
        done = written(top)
        out = done if out is None else out.unionByName(done)
        left = written(left.join(done.select("to_lat", "to_lon"), ["to_lat", "to_lon"], "left_anti"))
        size *= 2
    if out is None:
        return targets.limit(0).select(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), "to_lat", "to_lon", F.lit(0.0).alias("w"))
    # Great-circle distances; at a source point itself the others count nothing.
    arc = F.transform("x", lambda p: 2 * F.asin(F.least(p["d"] / 2, F.lit(1.0))))
    exact = out.select("to_lat", "to_lon", "x", arc.alias("arc")).withColumn("hit", F.col("arc")[0] < 1e-12)
    raw = F.when(F.col("hit"), F.transform("arc", lambda _, m: F.when(m == 0, 1.0).otherwise(0.0))).otherwise(F.transform("arc", lambda a: 1 / (a * a)))
    each = exact.withColumn("raw", raw).withColumn("sum", F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))
    return each.select("to_lat", "to_lon", "sum", F.explode(F.arrays_zip("x", "raw")).alias("p")).select(F.col("p.x.lat").alias("lat"), F.col("p.x.lon").alias("lon"), "to_lat", "to_lon", (F.col("p.raw") / F.col("sum")).alias("w")).where("w > 0")


def rotated(lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """Geographic place of a point of a rotated grid whose north pole is at ``pole_lat, pole_lon``."""
    a, o = F.radians(lat), F.radians(lon)
    p, q = math.radians(pole_lat), math.radians(pole_lon)
    x, y, z = F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)
    x1, z1 = math.sin(p) * x + math.cos(p) * z, -math.cos(p) * x + math.sin(p) * z
    x2, y2 = math.cos(q) * x1 - math.sin(q) * y, math.sin(q) * x1 + math.cos(q) * y
    return F.degrees(F.asin(F.greatest(F.least(z1, F.lit(1.0)), F.lit(-1.0)))), F.pmod(F.degrees(F.atan2(y2, x2)), F.lit(360.0))
