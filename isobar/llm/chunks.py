"""Texts in fixed chunks, for operators that ask about a text's parts more than once.

A chunk is a row with the ids and texts of neighbouring documents, about
``CHUNK_BYTES`` of text.  The table is written to the shared folder first, so
that a chunk is the same whenever it is read, also after an executor is lost.
Operators send hashed keys of a chunk's parts, once each, and get back by
chunk which of them matter: a key that every document has costs one row a
chunk, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import text as T
from .common import saved

CHUNK_BYTES = 1 << 20


def chunked(docs: DataFrame, extra: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk, ids, lens, text[, rest]``; with ``extra`` the other columns of ``docs`` are kept in ``rest``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if extra else []
    rows = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []))
    schema = StructType().add("chunk", "long").add("ids", ArrayType(LongType())).add("lens", ArrayType(LongType())).add("text", "binary")
    if others:
        schema = schema.add("rest", ArrayType(rows.schema["rest"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for rb in T.slices(batches, "text", chunk_bytes):
            raw, off = T.flat(rb.column(1))
            lens = np.diff(off)
            if rb.column(1).null_count:
                lens[np.array(rb.column(1).is_null().to_numpy(zero_copy_only=False))] = -1  # null stays null
            n = pa.array([0, rb.num_rows], pa.int32())
            cols = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(n, rb.column(0)), pa.ListArray.from_arrays(n, pa.array(lens)), pa.array([raw.tobytes()], pa.binary())]
            if others:
                cols.append(pa.ListArray.from_arrays(n, rb.column(2)))
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "lens", "text", "rest"][: len(cols)])
            chunk += 1

    return saved(rows.mapInArrow(run, schema), block_bytes=16 << 20)


class Chunk:
    """One row of the table."""

    def __init__(self, rb: pa.RecordBatch, k: int):
        at = rb.schema.get_field_index
        self.id = rb.column(at("chunk"))[k].as_py()
        self.ids = rb.column(at("ids"))[k].values
        lens = rb.column(at("lens"))[k].values.to_numpy(zero_copy_only=False)
        self.null = lens < 0
        self.raw = np.frombuffer(rb.column(at("text"))[k].as_buffer(), dtype=np.uint8)
        self.off = np.r_[0, np.cumsum(np.maximum(lens, 0))]
        self.rest = rb.column(at("rest"))[k].values if at("rest") >= 0 else None
        self._rb, self._k = rb, k

    def keys(self, name: str) -> np.ndarray:
        """A sorted list of keys that came back for the chunk."""
        got = self._rb.column(self._rb.schema.get_field_index(name))[self._k]
        return np.sort(got.values.to_numpy(zero_copy_only=False).view(np.uint64)) if got.is_valid and len(got.values) else np.zeros(0, np.uint64)

    def structs(self, name: str) -> pa.Array | None:
        """A list of structs that came back for the chunk, None where there is none."""
        got = self._rb.column(self._rb.schema.get_field_index(name))[self._k]
        return got.values if got.is_valid and len(got.values) else None

    def order(self) -> np.ndarray:
        """Rank of each document by id; equal ids in the order of rows."""
        at = np.argsort(self.ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), kind="stable")
        rank = np.empty(len(at), dtype=np.int64)
        rank[at] = np.arange(len(at))
        return rank


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for rb in batches:
        for k in range(rb.num_rows):
            yield Chunk(rb, k)


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``h`` are among the sorted ``keys``."""
    out = np.zeros(len(h), dtype=bool)
    if len(keys) and len(h):
        bits = np.uint64((1 << max(10, int(4 * len(keys)).bit_length())) - 1)
        sieve = np.zeros(int(bits) + 1, dtype=bool)
        sieve[keys & bits] = True
        maybe = np.flatnonzero(sieve[h & bits])
        pos = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        out[maybe] = keys[pos] == h[maybe]
    return out


def twice(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values that occur more than once."""
    s = np.sort(h)
    return np.unique(s[1:][s[1:] == s[:-1]])


def covered(start: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in ``[start, start + width)`` of any start."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:-1]) > 0
