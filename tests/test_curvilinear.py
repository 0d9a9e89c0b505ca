"""Curvilinear regridding against a brute-force search and known fields."""

import numpy as np
from pyspark.sql import functions as F

from isobar.operators import curvilinear, spatial


def _vec(lat, lon):
    a, o = np.radians(lat), np.radians(lon)
    return np.array([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def _rotated(spark, ni=24, nj=11, pole=(60.0, 30.0), half=75.0):
    i, j = F.col("id") % ni, F.floor(F.col("id") / ni)
    lat, lon = curvilinear.rotated((j * (2 * half / (nj - 1)) - half).cast("double"), (i * (360.0 / ni)).cast("double"), *pole)
    return spark.range(ni * nj).select(i.cast("long").alias("i"), j.cast("long").alias("j"), lat.alias("lat"), lon.alias("lon"))


def _brute(grid, targets, ni, nj):
    """The first cell by (j, i) that holds a target, by Newton's method in the tangent plane of the target."""
    at = {(r.i, r.j): (r.lat, r.lon) for r in grid.itertuples()}
    out = {}
    for lat, lon in targets:
        a, o = np.radians(lat), np.radians(lon)
        n, e, u = _vec(lat, lon), np.array([-np.sin(o), np.cos(o), 0]), np.array([-np.sin(a) * np.cos(o), -np.sin(a) * np.sin(o), np.cos(a)])
        for j in range(nj - 1):
            for i in range(ni):
                corners = [at[i, j], at[(i + 1) % ni, j], at[(i + 1) % ni, j + 1], at[i, j + 1]]
                v = [_vec(*c) for c in corners]
                if min(x @ n for x in v) <= 1e-6:
                    continue
                p = np.array([[x @ e / (x @ n), x @ u / (x @ n)] for x in v])
                z = np.array([0.5, 0.5])
                for _ in range(40):
                    s, t = z
                    f = (1 - s) * (1 - t) * p[0] + s * (1 - t) * p[1] + s * t * p[2] + (1 - s) * t * p[3]
                    jac = np.array([(1 - t) * (p[1] - p[0]) + t * (p[2] - p[3]), (1 - s) * (p[3] - p[0]) + s * (p[2] - p[1])]).T
                    if abs(np.linalg.det(jac)) < 1e-14:
                        break
                    z = z - np.linalg.solve(jac, f)
                s, t = z
                if np.abs(f).max() < 1e-10 and -1e-9 <= min(s, t) and max(s, t) <= 1 + 1e-9 and (lat, lon) not in out:
                    out[lat, lon] = {c: w for c, w in zip(corners, [(1 - s) * (1 - t), s * (1 - t), s * t, (1 - s) * t], strict=True) if w > 1e-9}
    return out


def test_weights_equal_a_search_over_all_cells(spark):
    grid = _rotated(spark, 12, 7)
    rng = np.random.default_rng(3)
    targets = [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 60), rng.uniform(0, 360, 60), strict=True)] + [(90.0, 0.0), (-90.0, 0.0), (0.0, 0.0), (60.0, 30.0)]
    frame = spark.createDataFrame(targets, "lat double, lon double")
    got: dict = {}
    for r in curvilinear.curvilinear_weights(grid, frame).collect():
        got.setdefault((r["to_lat"], r["to_lon"]), {})[r["lat"], r["lon"]] = r["w"]
    want = _brute(grid.toPandas(), targets, 12, 7)
    assert got.keys() == want.keys() and 30 < len(got) < len(targets)  # the caps of the rotated grid hold no cells
    for p, w in want.items():
        assert abs(sum(got[p].values()) - 1) < 1e-9
        for c, x in w.items():
            assert abs(got[p].get(c, 0) - x) < 1e-7


def test_a_smooth_field_comes_through(spark):
    """Over the pole and the date line, and at source points themselves."""
    grid = _rotated(spark, 120, 61, half=88.0).persist()
    target = spatial.regular_grid(spark, -90, 90, 10, 0, 360, 20)
    weights = curvilinear.curvilinear_weights(grid, target, extrapolate=True)
    smooth = lambda: F.sin(F.radians("lat")) + F.cos(F.radians("lat")) * F.cos(F.radians("lon") * 1)
    field = grid.select(F.lit("tos").alias("field"), F.lit(1).alias("year"), "lat", "lon", smooth().alias("value"))
    out = spatial.regrid(field, weights, ["field", "year"])
    rows = out.withColumn("want", smooth()).select((F.abs(F.col("value") - F.col("want"))).alias("e")).collect()
    assert len(rows) == 18 * 18 and max(r["e"] for r in rows) < 5e-3
    own = grid.limit(5).select("lat", "lon")
    at = curvilinear.curvilinear_weights(grid, own).where("abs(lat - to_lat) < 1e-9 and abs(lon - to_lon) < 1e-9").collect()
    assert len(at) == 5 and all(abs(r["w"] - 1) < 1e-6 for r in at)


def test_extrapolation_takes_the_nearest_points(spark):
    grid = spark.createDataFrame([(i, j, 10.0 * j, 15.0 * i) for i in range(6) for j in range(4)], "i long, j long, lat double, lon double")
    targets = [(-40.0, 200.0), (5.0, 7.0), (35.0, 80.0), (30.0, 76.0), (-90.0, 0.0)]
    frame = spark.createDataFrame(targets, "lat double, lon double")
    got: dict = {}
    for r in curvilinear.curvilinear_weights(grid, frame, periodic=False, extrapolate=True, k=3).collect():
        got.setdefault((r["to_lat"], r["to_lon"]), {})[r["lat"], r["lon"]] = r["w"]
    assert got.keys() == set(targets) and len(got[5.0, 7.0]) == 4
    points = [(10.0 * j, 15.0 * i) for i in range(6) for j in range(4)]
    for t in (targets[0], targets[2], targets[3]):
        d = sorted((float(np.arccos(np.clip(_vec(*t) @ _vec(*p), -1, 1))), p) for p in points)[:3]
        total = sum(1 / x**2 for x, _ in d)
        assert {p: round(w, 6) for p, w in got[t].items()} == {p: round(1 / x**2 / total, 6) for x, p in d}
    assert len(curvilinear.curvilinear_weights(grid, frame, periodic=False).select("to_lat", "to_lon").distinct().collect()) == 1
