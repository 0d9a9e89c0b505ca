"""Hard negatives by exact inner-product search over buckets of like norm.

Components become ``floor(256 * x)``; a score is the integer inner product.
For every anchor (``vec_id`` divisible by ``EVERY``) the best rows of its own
label are its positives; each positive opens a window of scores, from ``LOW``
percent of its own up to its own, in which the best rows of other labels are
its negatives.

Norm-bucketed search.  All rows are sorted by norm and packed into buckets of
``BUCKET`` neighbours, each with its largest norm.  By Cauchy-Schwarz an anchor
scores at most |anchor| x that norm in a bucket.  A block of anchors and a
bucket are joined only where that bound reaches the lower limit of one of the
block's windows; inside a task buckets come by falling norm, and an anchor
passes a bucket over when the bound is below the lower limits of its windows or
the kth score that they already have.  What is left is scored as a matrix
product.  Bounds are rounded up and equal scores are never pruned, so results
are exact; the pruning pays where norms differ, with unit vectors it prunes
next to nothing.

Anchors grow with the table, so they are dealt into rounds of about ``ROUND``
by a hash of their id; a round's blocks are broadcast (``ROUND`` vectors and
windows, some tens of MB whatever the table) and all buckets are read once for
positives and once for negatives.  A task keeps ``K`` rows for each window of
the round, and hands out no more; the last step takes the best ``K`` over tasks
with a window function over an anchor's few rows.

Results: rows with a null id or label, or a vector that is null or holds a null
or non-finite component, take no part; an empty table gives no rows, nor does an
anchor without positives or negatives; rows alike in id, label and vector count
once; of an id with unlike rows each is a candidate, never for its own id, and
the one with the smallest label, then vector, is the anchor; vectors of
unequal length are compared over the components that both have; integer
components of 2**27 and more are refused with an error, as a score would not fit
a long.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved
from .op13_clusters import EXACT, LARGEST, SCALE, finite, integers

#: Every which id is an anchor; positives and negatives kept; lower limit of a window in percent of the positive's score.
EVERY, K, LOW = 100, 5, 80
#: Labels of ids divisible by this move on by one, modulo the number of labels.
NOISE, LABELS = 7, 10
#: Rows of a bucket; anchors of a block and, about, of a round; buckets of a task, at least.
BUCKET, BLOCK, ROUND, TASK = 4096, 256, 32_768, 8
_NONE = np.iinfo(np.int64).min


def prepared(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v, norm)``: integer rows, each once; ``norm`` is rounded up a little."""
    n, v = F.col("vec_id"), F.col("embedding")
    label = F.when(n % NOISE == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = vectors.where(n.isNotNull() & F.col("label").isNotNull() & finite(v)).select(n.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), integers(v).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)) * (1 + 1e-12)
    return rows.distinct().withColumn("norm", norm)


# -- packing ------------------------------------------------------------------

_PACKED = "top double, n int, width int, ids binary, labels binary, norms binary, vectors binary, scores binary, positives binary, need double"


def _packing(size: int):
    """Packs ``size`` neighbouring rows into one; where rows bring positives, ``need`` is the smallest norm that reaches a window of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for rb in batches:
            while rb.num_rows:
                part, rb = rb.slice(0, size - count), rb.slice(size - count)
                held.append(part)
                count += part.num_rows
                if count == size:
                    yield _pack(held)
                    held, count = [], 0
        if count:
            yield _pack(held)

    return run


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    ids, labels, norms = (t.column(c).to_numpy().astype(k) for c, k in (("vec_id", np.int64), ("label", np.int64), ("norm", np.float64)))
    order = np.argsort(ids, kind="stable")
    lists = t.column("v").combine_chunks()
    flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    if flat.size and max(int(flat.max()), -int(flat.min())) >= LARGEST:
        raise ValueError(f"integer components of {LARGEST} and more are not supported")
    x = np.zeros((len(ids), int(size.max(initial=0))), np.int32)
    x[np.arange(x.shape[1]) < size[:, None]] = flat
    scores, positives, need = b"", b"", -np.inf
    if "positives" in t.column_names:
        s, p = np.full((len(ids), K), _NONE, np.int64), np.zeros((len(ids), K), np.int64)
        for k, found in enumerate(t.column("positives").to_pylist()):
            for i, one in enumerate(found):
                s[k, i], p[k, i] = one["score"], one["vec_id"]
        limit = np.where(s >= 0, lowest(s), np.inf).min(axis=1)
        need = float(np.divide(limit, norms, out=np.where(limit <= 0, 0.0, np.inf), where=norms > 0).min()) * (1 - 1e-9)
        scores, positives = s[order].tobytes(), p[order].tobytes()
    row = [[float(norms.max())], [len(ids)], [x.shape[1]], [ids[order].tobytes()], [labels[order].tobytes()], [norms[order].tobytes()], [x[order].tobytes()], [scores], [positives], [need]]
    kinds = [pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.float64()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])


def lowest(score: np.ndarray) -> np.ndarray:
    """The smallest integer that is ``LOW`` percent of ``score`` or more."""
    return -(-score * LOW // 100)


def packed(rows: DataFrame, size: int, partitions: int) -> DataFrame:
    """Rows of like norm packed together; equal norms are dealt by a hash of the id, so that no norm is too many rows for a task."""
    spread = F.xxhash64("vec_id")
    return rows.repartitionByRange(partitions, F.col("norm").desc(), spread).sortWithinPartitions(F.col("norm").desc(), spread).mapInArrow(_packing(size), _PACKED)


# -- search -------------------------------------------------------------------


class _Best:
    """The best ``K`` rows of each window of a block of anchors: higher scores first, then smaller ids."""

    def __init__(self, block: dict, windows: bool):
        self.n, self.ids, self.labels, self.norms = block["n"], *(np.frombuffer(block[c], k) for c, k in (("ids", np.int64), ("labels", np.int64), ("norms", np.float64)))
        self.v = np.frombuffer(block["vectors"], np.int32).reshape(self.n, block["width"])
        self.windows = windows
        self.slots = K if windows else 1
        top = np.frombuffer(block["scores"], np.int64).reshape(self.n, K) if windows else None
        self.high = top if windows else np.full((self.n, 1), np.iinfo(np.int64).max, np.int64)
        # A positive with a negative score has no window: 80 % of it is more than itself.
        self.low = np.where(top >= 0, lowest(top), np.iinfo(np.int64).max) if windows else np.full((self.n, 1), _NONE, np.int64)
        self.score, self.id = np.full((self.n, self.slots, K), _NONE, np.int64), np.full((self.n, self.slots, K), np.iinfo(np.int64).max, np.int64)
        self.scored = 0

    def meet(self, bucket: dict, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, biggest: int) -> None:
        bound = self.norms * bucket["top"] * (1 + 1e-9) + 1e-6
        floor = np.maximum(self.low, self.score[:, :, -1])
        some = np.flatnonzero((bound[:, None] >= floor).any(axis=1))
        if not len(some):
            return
        self.scored += len(some) * len(ids)
        width = min(v.shape[1], self.v.shape[1])
        a = self.v[some][:, :width]
        # Exact either way: float64 holds every partial sum where components are small.
        kind = np.float64 if max(biggest, int(np.abs(a, dtype=np.int64).max(initial=0))) < EXACT and width <= 1 << 9 else np.int64
        s = a.astype(kind) @ v[:, :width].astype(kind).T
        other = (self.labels[some][:, None] != labels) if self.windows else (self.labels[some][:, None] == labels)
        other &= self.ids[some][:, None] != ids
        for w in range(self.slots):
            worst, last = floor[some, w], self.score[some, w, -1]
            take = other & (s >= worst[:, None]) & (s <= self.high[some, w][:, None])
            if not take.any():
                continue
            # More than K left: their own Kth score is a limit too.
            many = np.flatnonzero(take.sum(axis=1) > 4 * K)
            if len(many):
                own = np.where(take[many], s[many], -np.inf if kind is np.float64 else _NONE)
                take[many] &= own >= np.partition(own, own.shape[1] - K, axis=1)[:, own.shape[1] - K, None]
            row, col = np.nonzero(take)
            score = s[row, col].astype(np.int64)
            better = (score > last[row]) | (ids[col] < self.id[some[row], w, -1])
            self._merge(w, some[row[better]], score[better], ids[col[better]])

    def _merge(self, w: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        rows = np.unique(row)
        who = np.concatenate([row, np.repeat(rows, K)])
        score, ids = np.concatenate([score, self.score[rows, w].ravel()]), np.concatenate([ids, self.id[rows, w].ravel()])
        order = np.lexsort((ids, ~score, who))  # ~score falls as score rises, and never overflows
        who, score, ids = who[order], score[order], ids[order]
        first = np.searchsorted(who, rows)
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = place < K
        self.score[rows, w], self.id[rows, w] = score[keep].reshape(len(rows), K), ids[keep].reshape(len(rows), K)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, w, k = np.nonzero(self.score > _NONE)
        return a, w, self.score[a, w, k], self.id[a, w, k]


_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def _searching(windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[_Best, dict]] = {}
        at, bucket = None, None
        for rb in batches:
            for k in range(rb.num_rows):
                row = {c: rb.column(i)[k].as_py() for i, c in enumerate(rb.schema.names)}
                block, it = {c: row["a_" + c] for c in ("n", "width", "ids", "labels", "norms", "vectors", "scores", "positives")}, row
                name = block["ids"]
                if name not in best:
                    best[name] = (_Best(block, windows), block)
                if it["vectors"] is not at:
                    at, n = it["vectors"], it["n"]
                    v = np.frombuffer(at, np.int32).reshape(n, it["width"])
                    bucket = (np.frombuffer(it["ids"], np.int64), np.frombuffer(it["labels"], np.int64), v, int(np.abs(v, dtype=np.int64).max(initial=0)))
                best[name][0].meet(it, *bucket)
        for found, block in best.values():
            a, w, score, ids = found.rows()
            own = found.ids[a]
            pos = np.frombuffer(block["positives"], np.int64).reshape(-1, K)[a, w] if windows else ids
            high = found.high[a, w] if windows else score
            yield pa.record_batch([pa.array(x) for x in (own, pos, high, ids, score)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _top(found: DataFrame, *by: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= K)


def _search(blocks: DataFrame, buckets: DataFrame, windows: bool) -> DataFrame:
    """The best rows of every task for each anchor (and window) of the blocks, which are few enough to broadcast."""
    small = F.broadcast(blocks.select(*[F.col(c).alias("a_" + c) for c in blocks.columns]))
    return buckets.join(small, F.col("top") >= F.col("a_need")).mapInArrow(_searching(windows), _FOUND)


def mined(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """One row for each negative; see the contract of the query."""
    rows = saved(prepared(vectors))
    total = rows.count()
    tasks = max(1, -(-total // (BUCKET * TASK)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET)))
    # Buckets are cut along the norm, then dealt to tasks in turn, so that each task has some of every norm.
    buckets = packed(rows, BUCKET, max(1, -(-total // (BUCKET * TASK))))
    buckets = saved(buckets.repartition(tasks).sortWithinPartitions(F.col("top").desc()), block_bytes=16 << 20)
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm")).alias("x")).select("vec_id", "x.*")
    number = rows.where(F.col("vec_id") % every == 0).count()
    rounds = max(1, -(-number // ROUND))
    anchors = saved(anchors.withColumn("round", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(rounds)), F.lit(rounds))))
    out = None
    for r in range(rounds):
        now = anchors.where(F.col("round") == r).drop("round")
        found = _search(packed(now, BLOCK, 4), buckets, False)
        best = _top(found.select("anchor_id", "vec_id", "score"), "anchor_id")
        positives = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
        with_windows = saved(now.join(positives, now["vec_id"] == positives["anchor_id"]).drop("anchor_id"))
        found = _top(_search(packed(with_windows, BLOCK, 4), buckets, True), "anchor_id", "positive_id", "positive_score")
        part = saved(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        dropped(with_windows)
        out = part if out is None else out.unionByName(part)
    for t in (rows, buckets, anchors):
        dropped(t)
    return out


SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % {NOISE} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS s FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {K}),
n AS (SELECT a, p, ps, b, s.s AS ns, row_number() OVER (PARTITION BY a, p ORDER BY s.s DESC, b) AS r FROM p JOIN s USING (a) WHERE NOT same AND {LOW} * ps <= 100 * s.s AND s.s <= ps)
SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, b AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= {K}
"""
