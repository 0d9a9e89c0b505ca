"""Clusters of integer vectors around centroids, by annulus search.

Components become ``floor(256 * x)``.  The first centroids are the vectors with
the smallest sha256 of ``<seed>:<vec_id>``; a round assigns every vector to its
nearest centroid (squared Euclidean distance, ties to the smaller number) and
moves each non-empty centroid to the floor of its vectors' mean.  All of it is
exact integer arithmetic, so a result depends neither on partitions nor order.

Annulus search: centroids are sorted by norm.  The distance of a vector to one
of its two neighbours in that order bounds the distance to the nearest one; by
the triangle inequality only centroids whose norm differs from the vector's by
no more than that bound can be as near.  Binary search finds this range (taken
a little wider than the rounding of the norms, so that ties on the border are
inside), and the distances to the centroids in it are compared exactly.

Vectors are written once as integers.  A round is one pass: a task holds the
centroids (``centroids`` x ``DIMENSIONS`` numbers, whatever the table) and hands
out the sums of its own vectors, at most that many numbers again; Spark adds
them up, and the new centroids are all that reaches the driver.

Results: vectors that are null, have not exactly ``DIMENSIONS`` components, or
hold a null or non-finite one are left out; fewer vectors than centroids give
as many centroids as vectors; an empty table gives no rows; repeated rows are
clustered each (of equal first centroids the later stays empty, as ties go to
the smaller number); rows without ``vec_id`` are clustered, but are never a
first centroid (where no row has an id nothing can be clustered: no rows); of
rows with one id the smaller components come first.  Integer components of 2**27
and more are refused with an error, as their distances would not fit a long.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

CENTROIDS, ROUNDS, SEED, DIMENSIONS, SCALE = 40, 5, 2, 64, 256
#: Below this size of components float64 products and their sums are exact.
EXACT, LARGEST = 1 << 22, 1 << 27


def finite(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)
    if x.size and max(int(x.max()), -int(x.min())) >= LARGEST:
        raise ValueError(f"integer components of {LARGEST} and more are not supported")
    return x


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cluster, squared distance)`` of each row of ``x``, and the number of distances that were computed."""
    small = max((int(np.abs(a).max()) for a in (x, centroids) if a.size), default=0) < EXACT
    kind = np.float64 if small else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    xx, cc = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
    far = np.sqrt(xx.astype(np.float64))
    order = np.argsort(cc, kind="stable")
    ring = np.sqrt(cc[order].astype(np.float64))

    def distance(rows: np.ndarray | slice, j: int) -> np.ndarray:
        return xx[rows] - 2 * (x[rows] @ c[j]) + cc[j]

    # The bound: the nearer of the two neighbours by norm.
    right = np.clip(np.searchsorted(ring, far), 0, len(c) - 1)
    bound = np.full(len(x), np.inf)
    made = 0
    for side in (right, np.maximum(right - 1, 0)):
        for p in np.unique(side):
            rows = np.flatnonzero(side == p)
            bound[rows] = np.minimum(bound[rows], distance(rows, order[p]))
            made += len(rows)
    reach = np.sqrt(np.maximum(bound, 0)) * (1 + 1e-9) + 1e-6 * (1 + far)
    first, last = np.searchsorted(ring, far - reach, side="left"), np.searchsorted(ring, far + reach, side="right")
    best, name = np.full(len(x), np.iinfo(np.int64).max, np.int64), np.full(len(x), len(c), np.int64)
    for p, j in enumerate(order):
        rows = np.flatnonzero((first <= p) & (p < last))
        if len(rows):
            d = distance(rows, j).astype(np.int64)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < name[rows]))
            best[rows[nearer]], name[rows[nearer]] = d[nearer], j
            made += len(rows)
    return name, best, made


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for rb in batches:
            if rb.num_rows:
                x = matrix(rb.column(0))
                name = nearest(x, centroids)[0]
                order = np.argsort(name, kind="stable")
                here, start = np.unique(name[order], return_index=True)
                total[here] += np.add.reduceat(x[order].astype(np.int64), start)
                count += np.bincount(name, minlength=len(count))
        full = np.flatnonzero(count)
        k = total.shape[1]
        yield pa.record_batch([pa.array(np.repeat(full, k).astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(full))), pa.array(total[full].ravel()), pa.array(np.repeat(count[full], k))], names=["cluster", "i", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                name, d, _ = nearest(matrix(rb.column(1)), centroids)
                yield pa.record_batch([rb.column(0), pa.array(name.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row for each vector that takes part; see the contract of the query."""
    v = F.col("embedding")
    rows = saved(vectors.where((F.size(v) == DIMENSIONS) & finite(v)).select(F.col("vec_id").cast("bigint").alias("vec_id"), integers(v).alias("v")))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(name.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()
    if not first:
        return rows.limit(0).selectExpr("vec_id", "cast(0 as int) as cluster", "cast(0 as bigint) as distance", "cast(0 as bigint) as cluster_inertia", "cast(0 as bigint) as inertia", "'' as centroid_sha256")
    c = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(c), "cluster int, i int, total bigint, n bigint").groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # one row for each component of a centroid
            c[r["cluster"], r["i"]] = r["total"] // r["n"]
    out = saved(rows.mapInArrow(_assigned(c), "vec_id bigint, cluster int, distance bigint"))
    dropped(rows)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(wide.alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    each = F.create_map(*[F.lit(x) for k, d in sorted(inertia.items()) for x in (k, F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(sha[k]).alias("sha")))]) if inertia else None
    if each is None:
        return out.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    found = out.withColumn("c", each[F.col("cluster")])
    return found.select("vec_id", "cluster", "distance", F.col("c.d").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), F.col("c.sha").alias("centroid_sha256"))


def sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same rounds over all pairs of vector and centroid; for small tables."""
    out = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids}))",
    ]
    for k in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c, {gap} AS d, row_number() OVER (PARTITION BY n ORDER BY d, c) AS r FROM (SELECT row_number() OVER () AS n, * FROM v), c{k}) WHERE r = 1)")
        if k < rounds:
            mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
            out.append(f"m{k} AS (SELECT c, list({mean} ORDER BY i) AS w FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{k}) GROUP BY 1, 2) GROUP BY 1)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c AS c, coalesce(m{k}.w, c{k}.w) AS w FROM c{k} LEFT JOIN m{k} USING (c))")
    return f"""
WITH {", ".join(out)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""
