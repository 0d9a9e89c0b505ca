"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct word shingles.  Two collections of
``HALVES`` half keys are drawn, each half key made of ``ROWS`` minimum hashes.
A hash table is keyed by one half key of either collection, so
``HALVES ** 2`` tables of ``2 * ROWS`` hashes need only
``2 * HALVES * ROWS`` minimum hashes.  A pair of similarity s is missed only
if all half keys of one collection differ, with a probability of about
``2 * (1 - s ** ROWS) ** HALVES``: 5e-7 at 0.85, 2e-5 at 0.8.

1. Equal sets are one node (the smallest id stands for them).
2. Half keys that only one node has are dropped; the tables are built from
   what is left.  Each node is joined to the smallest node of its buckets: a
   star, never the pairs of a bucket.
3. The components of the stars hold all candidates.  Inside each, the full
   sets are compared: blocks of bounded size, intersections as products of
   0/1 matrices, and of the confirmed links a spanning forest is kept.  A
   component that needs several blocks is first compared block by block and
   with ``PIVOTS`` of its nodes; only nodes outside its largest group so far
   are then compared with all its blocks.
4. Components of the confirmed links are the result.

Keys that very many rows have (half keys, buckets, equal sets) are counted
before they are joined, and the largest are joined without a shuffle
(``common.joined``).

Results: a text without words or null has no shingles and is linked with
nothing; fewer words than a shingle are one shingle; rows that repeat an id
are one node, also where their texts differ; a null id belongs to no component
(null) and is kept, whatever its text; very long texts are one set like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import dropped, joined, saved
from .graph import components

HALVES, ROWS, SEED = 16, 3, 7_919
#: A block holds about so many nodes and shingles; nodes every block is compared with.
BLOCK_NODES, BLOCK_SHINGLES, PIVOTS = 768, 1_500_000, 64


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, edges)``: the sorted distinct shingle hashes of each text."""
    w = T.Words(raw, off)
    h = w.hashes(T.LOWER)
    at, win = w.windows(h, k)
    row = w.row()[at] if len(at) else at
    if len(short := np.flatnonzero((w.n > 0) & (w.n < k))):
        # A sequence of its own kind: it must not meet a shingle of the full length.
        own = T.ranges(T.prefix(h), w.first[short], w.first[short + 1]) ^ T.mix(w.n[short].astype(np.uint64))
        win, row = np.concatenate([win, own]), np.concatenate([row, short])
    order = np.lexsort((win, row))
    win, row = win[order], row[order]
    new = np.ones(len(win), dtype=bool)
    new[1:] = (win[1:] != win[:-1]) | (row[1:] != row[:-1])
    win, row = win[new], row[new]
    return win, np.searchsorted(row, np.arange(len(off)))


def half_keys(win: np.ndarray, edges: np.ndarray, halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """``[set, 2 * halves]`` half keys of non-empty sets."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(1, 1 << 63, size=2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(edges) - 1, 2 * halves), dtype=np.uint64)
    starts = edges[:-1]
    for c in range(2 * halves):
        for r in range(rows):
            f = factor[c * rows + r]
            # The upper halves of odd multiples order the hashes anew; the lower bits break ties.
            least = np.minimum.reduceat(win * f ^ (win >> np.uint64(29)) * f, starts)
            out[:, c] = T.mix(out[:, c] * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, c] += np.uint64(c)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, s1, s2, halves``: size and 128-bit hash of each set, and its half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            win, edges = shingles(*T.flat(rb.column(1)), k)
            n = np.diff(edges)
            full = np.flatnonzero(n)
            s = np.zeros((2, len(n)), dtype=np.uint64)
            keys = np.zeros((len(n), 2 * HALVES), dtype=np.uint64)
            if len(full):
                s[0, full] = np.add.reduceat(T.mix(win), edges[full])
                s[1, full] = np.add.reduceat(T.mix(win ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edges[full])
                keys[full] = half_keys(win, np.r_[edges[full], len(win)])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), 2 * HALVES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int64()), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), lists], ["doc_id", "n", "s1", "s2", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, halves array<long>")


def stars(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: each node with the smallest node of a bucket; ``nodes(node, halves)``."""
    half = nodes.select("node", F.posexplode("halves").alias("c", "h"))
    twice = half.groupBy("c", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c", "h")
    left = half.join(twice, ["c", "h"], "left_semi").groupBy("node").agg(F.collect_list(F.when(F.col("c") < HALVES, F.col("h"))).alias("x"), F.collect_list(F.when(F.col("c") >= HALVES, F.col("h"))).alias("y"))
    keys = left.where("size(x) > 0 and size(y) > 0").select("node", F.explode("x").alias("x"), "y").select("node", F.explode(F.transform("y", lambda y: F.xxhash64("x", y))).alias("key"))
    keys = saved(keys)
    least = saved(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("times")).where("least < most"))
    star = saved(joined(keys, least, ["key"], "times").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    dropped(keys)
    dropped(least)
    # A node has a star in each table it shares, mostly with the same few nodes:
    # it keeps the smallest, and that one takes over its ties to the others.
    best = star.select("b", "a", F.min("a").over(Window.partitionBy("b")).alias("m"))
    out = saved(best.select(F.col("m").alias("a"), "b").union(best.where("a <> m").select("m", "a")).distinct())
    dropped(star)
    return out


def _links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with ``side``, of those between its two values or within True."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    owner = np.repeat(np.arange(n), size)
    value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    column = np.cumsum(np.r_[False, code[1:] != code[:-1]]) if len(code) else code
    both = np.zeros((n, n), dtype=np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1, width)) if len(column) else []
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(column)
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], column[a:b] - k * width] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if side is not None:
        linked &= side[:, None] | side[None, :]
    np.fill_diagonal(linked, False)
    forest, seen = [], np.zeros(n, dtype=bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            forest += [(at, int(x)) for x in new]
            todo += new.tolist()
    return forest


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each ``part`` of a ``bucket``; rows(bucket, part, node, always, hashes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        pdf = pdf.sort_values(["part", "node"], kind="stable")
        node, hashes, always = pdf["node"].to_numpy(), pdf["hashes"].to_numpy(), pdf["always"].to_numpy(dtype=bool)
        part = pdf["part"].to_numpy()
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            at = np.arange(s, e)
            # A node may stand in a part twice, as a member and as a pivot.
            first = np.r_[True, node[s + 1 : e] != node[s : e - 1]]
            side = np.logical_or.reduceat(always[s:e], np.flatnonzero(first))
            at = at[first]
            if len(at) < 2:
                continue
            for x, y in _links([np.frombuffer(hashes[k], dtype=np.uint64) for k in at], percent, side):
                a.append(node[at[x]])
                b.append(node[at[y]])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return rows.groupBy("bucket").applyInPandas(run, "a long, b long")


def confirmed(docs: DataFrame, nodes: DataFrame, coarse: DataFrame, k: int, percent: int) -> DataFrame:
    """``(a, b)``: links confirmed on full sets that connect what is linked inside each component of ``coarse``."""
    member = coarse.join(nodes.select("node", "n", "s1", "s2"), "node")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int"))
    member = member.join(sizes, "component").select("node", "component", "blocks", "m", "n", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            win, edges = shingles(*T.flat(rb.column(rb.num_columns - 1)), k)
            n, full = np.diff(edges), np.flatnonzero(np.diff(edges))
            s1 = np.zeros(len(n), dtype=np.uint64)
            s1[full] = np.add.reduceat(T.mix(win), edges[full]) if len(full) else 0
            same = pa.array(s1.view(np.int64) == rb.column(4).to_numpy(zero_copy_only=False))  # of an id with several texts, the one that the node stands for
            sets = pa.array([win[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], sets], ["node", "component", "blocks", "n", "hashes"]).filter(same)

    texts = member.join(docs.select("doc_id", "text"), F.col("node") == F.col("doc_id")).select("node", "component", "blocks", "n", "s1", "text")
    sets = saved(texts.mapInArrow(run, "node long, component long, blocks int, n long, hashes binary"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, int(total // BLOCK_SHINGLES * 2), sets.sparkSession.sparkContext.defaultParallelism)

    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    small = sets.where("blocks = 1").select(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"), F.col("component").alias("part"), "node", F.lit(True).alias("always"), "hashes")
    large = sets.where("blocks > 1").withColumn("block", block)
    if large.isEmpty():
        out = saved(_compared(small, percent))
        dropped(sets)
        return out
    # Pivots: of each component the nodes whose hash falls under PIVOTS / m, to every block.
    pivot = large.join(sizes.select("component", "m"), "component").where(F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.lit(1 << 30)) < F.lit(PIVOTS << 30) / F.col("m"))
    pivot = pivot.select("component", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hashes")
    each = large.select("component", "node", "block", "hashes").unionByName(pivot)
    first = each.select(F.xxhash64("component", "block").alias("bucket"), F.xxhash64("component", "block").alias("part"), "node", F.lit(True).alias("always"), "hashes")
    links = saved(_compared(small.unionByName(first), percent))
    # Nodes outside the largest group of their component, against all blocks.
    group = components(links)
    placed = large.select("component", "node", "blocks").join(group.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    count = placed.groupBy("component", "g").agg(F.count(F.lit(1)).alias("c"))
    largest = count.groupBy("component").agg(F.max(F.struct("c", "g"))["g"].alias("top"))
    rest = placed.join(largest, "component").where("g <> top").select("component", "node")
    spare = saved(large.join(rest, ["component", "node"], "left_semi"))
    if spare.isEmpty():
        dropped(sets)
        return links
    pieces = spare.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("pieces"))
    ours = spare.join(pieces, "component").select("component", "node", F.pmod(F.xxhash64(F.lit("piece"), "node"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("always"), "hashes")
    theirs = large.join(pieces, "component").select("component", "node", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "block", F.lit(False).alias("always"), "hashes")
    key = F.xxhash64("component", "piece", "block")
    more = saved(_compared(ours.unionByName(theirs).select(key.alias("bucket"), key.alias("part"), "node", "always", "hashes"), percent))
    dropped(sets)
    dropped(spare)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; links: 100 * intersection >= percent * union."""
    sig = saved(signatures(docs, k))
    some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    nodes = saved(sig.where(some).groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "halves")).alias("x"), F.count(F.lit(1)).alias("times")).select(F.col("x.doc_id").alias("node"), "s1", "s2", "n", F.col("x.halves").alias("halves"), "times"))
    star = stars(nodes)
    coarse = components(star)
    links = confirmed(docs, nodes, coarse, k, percent)
    # An id with several texts ties their sets together.
    several = sig.where(some).groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc_id")
    tied = sig.join(several, "doc_id", "left_semi").join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    group = components(links.unionByName(tied))
    named = saved(nodes.select("s1", "s2", "n", "node", "times").join(group, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"), "times"))
    rows = sig.select("doc_id", "n", "s1", "s2")
    # Rows without a set or an id meet nothing: they stay out of the join, in which they would be one hot key.
    out = joined(rows.where(some), named, ["s1", "s2", "n"], "times").select("doc_id", F.col("n").alias("n_shingles"), F.least("component", "doc_id").alias("component_id"))
    out = out.unionByName(rows.where(~some).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    out = saved(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    for table in (sig, nodes, star, coarse, group, named):
        dropped(table)
    return out
