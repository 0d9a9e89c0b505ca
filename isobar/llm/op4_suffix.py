"""Exact substring deduplication over bytes with longest-previous-factor arrays.

Every 200-byte string that also starts anywhere else is repeated.  Texts are
cut so that equal strings meet:

1. The smallest of the 101 hashes of 100-byte strings inside a 200-byte string
   depends on that string alone.  Neighbouring 200-byte strings with the same
   smallest hash form a piece (at most 101 starts, 300 bytes); the hash is the
   piece's key.  Equal strings have equal keys.
2. Chunks send (key, hash of the piece), once each: together the 128 bits that
   name a piece.  A key that stands in two places, in one chunk or in several,
   is a candidate; of its pieces one copy each is sent as text, with the note
   whether the piece stands in several places.
3. The suffixes of those pieces that have 200 bytes are sorted on them; a piece
   that stands in several places is in the order twice.  In that order the
   previous and next smaller positions of a suffix give its longest previous
   factor: the longest match that starts earlier, with its length and place.
   Factors of 200 bytes mark the later copies, and their places the first
   ones.  What is marked goes back to all chunks that have the piece.
   A key with more than ``HOT`` distinct pieces is split by a longer prefix,
   all 200 bytes of a string: equal strings are counted on their bytes,
   before and after the shuffle, so no task holds more than one of each.

Results: null and empty texts have no bytes; texts under 200 bytes are never
touched; copies in the same text and overlapping ones count; rows that repeat
an id or a whole text are texts of their own, so both copies go; a very long
text is one chunk; removing bytes may cut a character, so results are bytes;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .chunks import CHUNK_BYTES, Chunk, chunked, covered, each, member, twice
from .common import dropped, joined, saved

LENGTH, GRAM = 200, 100
#: Distinct pieces of a key that are sorted together (1.2 MB); bytes of pieces sorted at a time.
HOT, TASK_BYTES = 4_000, 1 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``x[i : i + width]`` for each i with a full window."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Cut:
    """200-byte strings of a chunk (starts in ``at``) and the pieces they form."""

    def __init__(self, c: Chunk):
        size = np.diff(c.off)
        self.at = at = T.spread(c.off[:-1], np.maximum(size - LENGTH + 1, 0))
        if not len(at):
            self.begin = self.end = at
            self.key = self.piece = self.gram = np.zeros(0, np.uint64)
            self.pre = np.zeros(1, np.uint64)
            return
        self.pre = pre = T.prefix(T.BYTE_VALUE[c.raw])
        self.gram = T.every(pre, GRAM)
        least = sliding_min(self.gram, LENGTH - GRAM + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        first = np.cumsum(np.maximum(size - LENGTH + 1, 0))[:-1]
        new[first[first < len(at)]] = True  # a document's first
        k = np.flatnonzero(new)
        run = np.diff(np.r_[k, len(at)])
        # Long runs, as of one letter, are cut.
        many = -(-run // (LENGTH - GRAM + 1))
        self.begin = T.spread(np.zeros(len(k), np.int64), many) * (LENGTH - GRAM + 1) + np.repeat(k, many) if many.max() > 1 else k
        self.end = np.r_[self.begin[1:], len(at)]
        self.key = least[self.begin]
        self.piece = T.ranges(pre, at[self.begin], at[self.end - 1] + LENGTH)

    def starts(self, pieces: np.ndarray) -> np.ndarray:
        """Indexes of the starts of the chosen pieces."""
        return T.spread(self.begin[pieces], (self.end - self.begin)[pieces])

    def again(self) -> np.ndarray:
        """Which pieces have a key whose 100 bytes stand in two places of the chunk."""
        return member(self.key, twice(self.gram[member(self.gram, np.unique(self.key))]))


def heads(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The ``length`` bytes from each place on, a row each."""
    return np.lib.stride_tricks.sliding_window_view(raw, length)[at] if len(at) else np.zeros((0, length), np.uint8)


def suffix_order(head: np.ndarray) -> np.ndarray:
    """Order of the suffixes, compared on their heads; equal ones stand in the order of their places."""
    if not len(head):
        return np.zeros(0, np.int64)
    # Zero bytes at the end of a row compare as missing, in all rows of this length alike.
    return np.argsort(head.view(f"S{head.shape[1]}").ravel(), kind="stable")


def nearest_smaller(x: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, -1 where there is none.

    ``shared`` (what each shares with its left neighbour) becomes the least from there on.
    """
    at = np.arange(len(x)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[x[at[todo]] > x[todo]]
        j = at[todo]
        if shared is not None:
            shared[todo] = np.minimum(shared[todo], shared[j])
        at[todo] = at[j]
        todo = todo[at[todo] >= 0]
    return at


def common_prefix(head: np.ndarray) -> np.ndarray:
    """How many first bytes each head shares with the next."""
    out = np.full(len(head) - 1, head.shape[1], dtype=np.int64)
    wide = head.shape[1] % 8 == 0
    unit = head.view(np.uint64) if wide else head
    differs = unit[:-1] != unit[1:]
    some = np.flatnonzero(differs.any(axis=1))
    first = differs[some].argmax(axis=1)
    if wide:
        inside = head.reshape(len(head), -1, 8)
        first = 8 * first + (inside[some, first] != inside[some + 1, first]).argmax(axis=1)
    out[some] = first
    return out


def longest_previous_factors(head: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(length, place)`` of the longest match of each suffix that starts earlier; place -1 where there is none.

    Suffixes are numbered by place; lengths end at the length of the heads.
    With ``twice`` those marked have a second copy behind all others: the
    results of the copies follow, in order.
    """
    n = len(head)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(head)
    # What neighbours in the order share; others share the least of what lies between.
    shared = common_prefix(head[order])
    if twice is not None and twice.any():
        copy = np.flatnonzero(twice)
        number = np.full(n, -1)
        number[copy] = n + np.arange(len(copy))
        base = np.r_[np.arange(n), copy]
        times = 1 + twice[order].astype(np.int64)
        first = np.cumsum(times) - times
        x = np.empty(len(base), dtype=np.int64)
        x[first] = order
        x[first[times > 1] + 1] = number[order[times > 1]]
        between = np.full(len(base) - 1, head.shape[1], dtype=np.int64)
        between[first[1:] - 1] = shared
        shared = between
    else:
        base, x = np.arange(n), order
    length, place = np.zeros(len(base), dtype=np.int64), np.full(len(base), -1)
    to_left, to_right = np.r_[0, shared], np.r_[0, shared[::-1]]
    left = nearest_smaller(x, to_left)
    right = len(x) - 1 - nearest_smaller(x[::-1], to_right)[::-1]
    for side, has, least in ((left, left >= 0, to_left), (right, right < len(x), to_right[::-1])):
        own, other, got = x[has], x[side[has]], least[has]
        better = got > length[own]
        length[own[better]], place[own[better]] = got[better], other[better]
    return length, place


def repeated_starts(head: np.ndarray, twice: np.ndarray | None = None) -> np.ndarray:
    """Which suffixes have their whole head anywhere else too: those with a full factor, and the places of full factors."""
    length, place = longest_previous_factors(head, twice)
    full = np.flatnonzero(length == head.shape[1])
    hit = np.zeros(len(length), dtype=bool)
    hit[full] = True
    hit[place[full]] = True
    return hit[: len(head)]


_MATCHED = "key long, piece long, every boolean, starts array<int>"


def _matched(rows: DataFrame, buckets: int) -> DataFrame:
    """``key, piece, every, starts``: starts (offsets in the piece) that are repeated, of pieces that have any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["key", "piece"], kind="stable")
        size = pdf["body"].map(len).to_numpy()
        keys, pieces, twice_there = pdf["key"].to_numpy(), pdf["piece"].to_numpy(), pdf["twice"].to_numpy(dtype=bool)
        # Keys are sorted together up to a bound of bytes; equal strings never have different keys.
        total = np.cumsum(size)
        a = 0
        while a < len(pdf):
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + TASK_BYTES, side="right"))
            b = max(b, a + 1)
            while b < len(pdf) and keys[b] == keys[b - 1]:
                b += 1
            raw = np.frombuffer(b"".join(pdf["body"].iloc[a:b]), dtype=np.uint8)
            count = size[a:b] - LENGTH + 1
            first = np.cumsum(count) - count
            hit = repeated_starts(heads(raw, T.spread(np.cumsum(size[a:b]) - size[a:b], count)), np.repeat(twice_there[a:b], count))
            n = np.add.reduceat(hit.astype(np.int64), first)
            out += [(keys[a + k], pieces[a + k], bool(n[k] == count[k]), None if n[k] == count[k] else np.flatnonzero(hit[first[k] : first[k] + count[k]]).astype(np.int32)) for k in np.flatnonzero(n)]
            a = b
        return pd.DataFrame(out, columns=["key", "piece", "every", "starts"])

    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, _MATCHED)


def _matched_apart(rows: DataFrame) -> DataFrame:
    """The same for keys of very many pieces: every string for itself, counted on its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "body", 64 << 10):
            raw, off = T.flat(rb.column(3))
            per = np.diff(off) - LENGTH + 1
            at = pa.array(np.repeat(np.arange(len(per)), per))
            body = heads(raw, T.spread(off[:-1], per)).tobytes()
            strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), int(per.sum()), [None, pa.py_buffer(body)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at), rb.column(2).take(at), pa.array(T.spread(np.zeros(len(per), np.int64), per).astype(np.int32)), pa.array(np.repeat(per, per).astype(np.int32)), strings], ["key", "piece", "twice", "start", "per", "string"])

    strings = rows.select("key", "piece", "twice", "body").mapInArrow(cut, "key long, piece long, twice boolean, start int, per int, string binary")
    many = strings.groupBy("string").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times")).where("times > 1")
    hit = joined(strings, many, ["string"], "times").groupBy("key", "piece").agg(F.first("per").alias("per"), F.collect_list("start").alias("starts"))
    every = F.size("starts") == F.col("per")
    return hit.select("key", "piece", every.alias("every"), F.when(~every, F.col("starts")).alias("starts"))


def repeated(chunks: DataFrame, hot_kinds: int = HOT) -> DataFrame:
    """``chunk, hits``: (piece, every, starts) of a chunk's pieces that hold repeated strings."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            cut = _Cut(c)
            piece, at, n = np.unique(cut.piece, return_index=True, return_counts=True)
            again = cut.again()
            yield pa.RecordBatch.from_arrays([pa.array(cut.key[at].view(np.int64)), pa.array(piece.view(np.int64)), pa.array(np.full(len(piece), c.id)), pa.array(again[at]), pa.array(n > 1)], ["key", "piece", "chunk", "again", "more"])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            cut = _Cut(c)
            piece, at = np.unique(cut.piece, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(cut.key[at].view(np.int64)), pa.array(piece.view(np.int64)), pa.array(np.full(len(piece), c.id))], ["key", "piece", "chunk"])

    read = chunks.select("chunk", "ids", "lens", "text")
    sent = read.mapInArrow(send, "key long, piece long, chunk long, again boolean, more boolean")
    pieces = sent.groupBy("key", "piece").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"), F.max("again").alias("again"), F.max("more").alias("more"), F.count(F.lit(1)).alias("times"))
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("mass"), F.min("lo").alias("a"), F.max("hi").alias("z"), F.max(F.col("again") | F.col("more")).alias("b")).where("a < z or b").select("key", "kinds", "mass")
    # Both sides take the same columns, so that they read one shuffle; a join splits skewed keys at run time.
    known = saved(pieces.join(keys, "key").select("key", "piece", F.col("lo").alias("chunk"), (F.col("more") | (F.col("lo") < F.col("hi"))).alias("twice"), (F.col("kinds") > hot_kinds).alias("hot"), "times", "again", "mass"))
    asked = known.groupBy("chunk").agg(F.collect_list(F.struct("key", "piece", "twice", "hot", "times")).alias("asked"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            want = c.structs("asked")
            p = want.field("piece").to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(p)
            cut = _Cut(c)
            own, at = np.unique(cut.piece, return_index=True)
            pos = at[np.searchsorted(own, p[order])]
            raw = c.raw.tobytes()
            a, b = cut.at[cut.begin[pos]], cut.at[cut.end[pos] - 1] + LENGTH
            take = pa.array(order)
            columns = [want.field(x).take(take) for x in ("key", "piece", "twice", "hot", "times")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([raw[x:y] for x, y in zip(a, b, strict=True)], pa.binary())], ["key", "piece", "twice", "hot", "times", "body"])

    shipped = saved(read.join(asked, "chunk").mapInArrow(bodies, "key long, piece long, twice boolean, hot boolean, times long, body binary"))
    dropped(known)
    mass = shipped.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)), F.max("hot")).first()
    buckets = max(shipped.sparkSession.sparkContext.defaultParallelism, int(mass[0] // (6 * TASK_BYTES)) + 1)
    found = _matched(shipped.where("not hot"), buckets)
    if mass[1]:
        found = found.unionByName(_matched_apart(shipped.where("hot")))
    found = saved(found.join(shipped.select("key", "piece", "times"), ["key", "piece"]))
    dropped(shipped)
    # The way back needs no places within a chunk, so they are not looked for again.
    back = joined(read.mapInArrow(names, "key long, piece long, chunk long"), found, ["key", "piece"], "times")
    out = saved(back.groupBy("chunk").agg(F.collect_list(F.struct("piece", "every", "starts")).alias("hits")))
    dropped(found)
    return out


def _gone(c: Chunk) -> np.ndarray:
    """Which bytes of a chunk (with its ``hits``) lie in repeated strings."""
    hits = c.structs("hits")
    if hits is None:
        return np.zeros(len(c.raw), dtype=bool)
    cut = _Cut(c)
    hit = np.zeros(len(cut.at), dtype=bool)
    p = hits.field("piece").to_numpy(zero_copy_only=False).view(np.uint64)
    every = hits.field("every").to_numpy(zero_copy_only=False)
    hit[cut.starts(np.flatnonzero(member(cut.piece, np.sort(p[every]))))] = True
    part = np.flatnonzero(~every)
    part = part[np.argsort(p[part])]
    starts = hits.field("starts")
    mine = np.flatnonzero(member(cut.piece, p[part]))
    for m, k in zip(mine, part[np.searchsorted(p[part], cut.piece[mine])], strict=True):
        hit[cut.begin[m] + starts[int(k)].values.to_numpy()] = True
    return covered(cut.at[hit], LENGTH, len(c.raw))


def digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot_kinds: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    chunks = chunked(docs, chunk_bytes=chunk_bytes)
    found = repeated(chunks, hot_kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each(batches):
            gone = _gone(c)
            opens = gone.copy()
            if len(gone):
                opens[1:] &= ~gone[:-1]
                inner = c.off[(c.off > 0) & (c.off < len(gone))]
                opens[inner] = gone[inner]
            kept = c.raw[~gone].tobytes()
            before = np.r_[0, np.cumsum(gone)][c.off]
            cuts = c.off - before
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            spans = np.diff(np.r_[0, np.cumsum(opens)][c.off])
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(np.diff(c.off)), pa.array(np.diff(before).astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = saved(chunks.join(found, "chunk", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    dropped(found)
    dropped(chunks)
    return out
