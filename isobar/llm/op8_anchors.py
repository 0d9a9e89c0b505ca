"""Substring deduplication over words with difference-cover anchors.

A repeated passage is a run of ``WINDOW`` words that also starts earlier (in a
document with a smaller id, or earlier in the same one).  The residues
``COVER`` modulo ``PERIOD`` are a difference cover: for any two starts some
shift below ``PERIOD`` takes both to covered positions.  So only windows of
``ANCHOR = WINDOW - PERIOD + 1`` words at covered positions are hashed, and
two equal runs of ``WINDOW`` words share an anchor at the same shift.

1. Chunks send the hashes of their anchors, once each; those of more than one
   chunk, counted by key before and after the shuffle, come back.
2. Around them every run of ``WINDOW`` words that holds one is named by the
   hashes of its two halves (128 bits) and sent once a chunk, with the first
   document and place that it has there; of a run that is not the first of all
   that place comes back.
   Runs that hold eight words of an anchor of very many chunks (which depends
   on the run alone) are counted before the shuffle and joined back; all
   others meet by one shuffle.
3. Words of the runs at such places, and of later ones around anchors that
   stand twice in the same chunk, are removed.

Results: null and empty texts have no words; of rows that repeat an id the one
in the earlier chunk or row counts as earlier; a null id counts as smaller than
any other; a very long text is one chunk; an empty table gives no rows;
``digests`` ignores other columns, ``deduplicated`` keeps them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from . import text as T
from .chunks import CHUNK_BYTES, Chunk, chunked, covered, each, member, twice
from .common import dropped, joined, saved

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_COVERED = np.isin(np.arange(PERIOD), COVER)


class _Cut:
    """Words of a chunk, with hashes of the runs asked for."""

    def __init__(self, c: Chunk):
        self.words = w = T.Words(c.raw, c.off)
        self.row = w.row()
        self.pre = T.prefix(w.hashes())
        self.at = np.arange(len(self.row)) - w.first[:-1][self.row] if len(self.row) else self.row
        self.left = w.n[self.row] - self.at if len(self.row) else self.row

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(_COVERED[self.at % PERIOD] & (self.left >= ANCHOR) & (self.words.n[self.row] >= WINDOW))
        return at, T.ranges(self.pre, at, at + ANCHOR)

    def runs(self, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the runs, and the hashes of their halves."""
        full = self.left >= WINDOW
        at = np.flatnonzero(full if mask is None else full & mask)
        middle = at + WINDOW // 2
        return at, T.ranges(self.pre, at, middle), T.ranges(self.pre, middle, at + WINDOW)

    def holds(self, at: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Which runs hold the words of one of ``anchors``, at any place."""
        if not len(anchors) or not len(at):
            return np.zeros(len(at), dtype=bool)
        places = np.arange(max(0, len(self.row) - ANCHOR + 1))
        n = np.r_[0, np.cumsum(member(T.ranges(self.pre, places, places + ANCHOR), anchors))]
        return n[at + WINDOW - ANCHOR + 1] > n[at]

    def near(self, anchors: np.ndarray) -> np.ndarray:
        """Starts whose run can hold one of the anchors in its first ``PERIOD`` places."""
        edge = np.zeros(len(self.row) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(anchors - PERIOD + 1, anchors - self.at[anchors]), 1)
        np.add.at(edge, anchors + 1, -1)
        return np.cumsum(edge[:-1]) > 0


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One name of a run, for use inside a chunk."""
    return T.mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _first(keys: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first occurrence (by rank, then place) of each distinct key."""
    order = np.lexsort((at, rank, keys))
    k = keys[order]
    return order[np.r_[True, k[1:] != k[:-1]]] if len(k) else order


def later_runs(chunks: DataFrame) -> DataFrame:
    """``chunk, later``: first places in the chunk (numbers of words) of runs whose first occurrence is in another."""

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            key = np.unique(_Cut(c).anchors()[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), c.id))], ["key", "chunk"])

    sent = chunks.select("chunk", "ids", "lens", "text").mapInArrow(send_anchors, "key long, chunk long")
    again = saved(sent.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    shared = saved(joined(sent, again, ["key"], "times").groupBy("chunk").agg(F.collect_list("key").alias("anchors")))
    # At most all anchors over HOT_ROWS.
    hot = np.sort(np.array([r["key"] for r in again.where(F.col("times") > common.HOT_ROWS).select("key").collect()], dtype=np.int64).view(np.uint64))
    dropped(again)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            cut = _Cut(c)
            at, key = cut.anchors()
            at, one, two = cut.runs(cut.near(at[member(key, c.keys("anchors"))]))
            own = np.sort(_first(_named(one, two), c.order()[cut.row[at]], at))
            docs = c.ids.take(pa.array(cut.row[at[own]]))
            yield pa.RecordBatch.from_arrays([pa.array(one[own].view(np.int64)), pa.array(two[own].view(np.int64)), pa.array(np.full(len(own), c.id)), docs, pa.array(at[own].astype(np.int32)), pa.array(cut.holds(at[own], hot))], ["one", "two", "chunk", "doc", "place", "hot"])

    # Written, so that the shuffle of texts is gone before the runs are shuffled.
    sent = saved(chunks.select("chunk", "ids", "lens", "text").join(shared, "chunk").mapInArrow(send_runs, "one long, two long, chunk long, doc long, place int, hot boolean"))
    dropped(shared)
    first = F.min(F.struct("doc", "chunk"))
    # First copies are found by an aggregate and met by a join: no run is gathered in a group.  Both sides take the
    # same columns and filters, so that they read one shuffle; what is asked for nulls and last holds for every row.
    dealt = sent.where("not hot and one is not null and two is not null and chunk is not null and place is not null")
    dealt = dealt.select("one", "two", "chunk", "doc", "place").repartition("one", "two")
    found = dealt.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times"), first.alias("first"), F.max("place").alias("last")).where("times > 1")
    always = F.col("place") <= F.col("last"), F.coalesce(F.col("doc") >= F.col("first.doc"), F.lit(True))
    later = dealt.join(found, ["one", "two"]).where((F.col("chunk") != F.col("first.chunk")) & always[0] & always[1]).select("chunk", "place")
    homes = None
    if len(hot):
        homes = saved(sent.where("hot").groupBy("one", "two").agg(F.count(F.lit(1)).alias("times"), first["chunk"].alias("home")).where("times > 1"))
        later = later.unionByName(joined(sent.where("hot"), homes, ["one", "two"], "times").where("chunk <> home").select("chunk", "place"))
    out = saved(later.groupBy("chunk").agg(F.collect_list("place").alias("later")))
    for table in (sent, homes):
        dropped(table)
    return out


def _removed(c: Chunk) -> tuple[_Cut, np.ndarray]:
    """The words of a chunk (with its ``later`` runs) and which of them go."""
    cut = _Cut(c)
    gone = np.zeros(len(cut.row), dtype=bool)
    anchor, key = cut.anchors()
    # Repeats in the chunk: around anchors that stand in it twice.
    at, one, two = cut.runs(cut.near(anchor[member(key, twice(key))]))
    run = _named(one, two)
    some = np.flatnonzero(member(run, twice(run)))
    go = np.zeros(len(at), dtype=bool)
    go[some] = True
    go[some[_first(run[some], c.order()[cut.row[at[some]]], at[some])]] = False
    gone |= covered(at[go], WINDOW, len(cut.row))
    # Repeats of other chunks: later copies of the same run are among those above.
    if (later := c.structs("later")) is not None:
        gone |= covered(later.to_numpy(zero_copy_only=False), WINDOW, len(cut.row))
    return cut, gone


def _over(docs: DataFrame, extra: bool, schema: Callable[[DataFrame], str | StructType], make: Callable[[Chunk, _Cut, np.ndarray], pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The made rows, and the tables that they are read from."""
    chunks = chunked(docs, extra, chunk_bytes)
    later = later_runs(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            yield make(c, *_removed(c))

    return chunks.join(later, "chunk", "left").mapInArrow(run, schema(chunks)), [chunks, later]


def digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""

    def make(c: Chunk, cut: _Cut, gone: np.ndarray) -> pa.RecordBatch:
        first = cut.words.first
        raw, keep = c.raw.tobytes(), ~gone
        sha = [hashlib.sha256(b" ".join(compress(raw[a:b].split(), keep[x:y]))).hexdigest() for a, b, x, y in zip(c.off[:-1], c.off[1:], first[:-1], first[1:], strict=True)]
        n_gone = np.diff(np.r_[0, np.cumsum(gone)][first])
        return pa.RecordBatch.from_arrays([c.ids, pa.array(cut.words.n.astype(np.int64)), pa.array(n_gone.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows, read = _over(docs, False, lambda _: "doc_id long, n_words long, n_removed long, kept_sha256 string", make, chunk_bytes)
    out = saved(rows)
    for table in read:
        dropped(table)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; white space after kept words stays, other columns are as they were."""

    def make(c: Chunk, cut: _Cut, gone: np.ndarray) -> pa.RecordBatch:
        w = cut.words
        stay = np.ones(len(c.raw), dtype=bool)
        if gone.any():
            edge = np.zeros(len(c.raw) + 1, dtype=np.int64)
            until = np.r_[w.start[1:], len(c.raw)]
            until = np.minimum(until, c.off[1:][cut.row])
            np.add.at(edge, w.start[gone], 1)
            np.add.at(edge, until[gone], -1)
            stay = np.cumsum(edge[:-1]) == 0
        kept = c.raw[stay].tobytes()
        cuts = np.r_[0, np.cumsum(stay)][c.off]
        texts = [None if none else kept[a:b].decode() for a, b, none in zip(cuts[:-1], cuts[1:], c.null, strict=True)]
        cols = [c.ids, pa.array(texts, pa.string())] + ([c.rest] if c.rest is not None else [])
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "rest"][: len(cols)])

    def schema(chunks: DataFrame) -> StructType:
        out = StructType().add("doc_id", "long").add("text", "string")
        return out.add("rest", chunks.schema["rest"].dataType.elementType) if "rest" in chunks.columns else out

    out, _ = _over(docs, True, schema, make)
    return out.select(*[F.col("rest")[c].alias(c) if c not in ("doc_id", "text") else F.col(f"`{c}`") for c in docs.columns])
