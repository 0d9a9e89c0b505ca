"""Sums of matrices over partitions, added up in a tree of strips.

A task adds up its own rows and hands out strips of its sum, each a binary of
some MB; strips of the same place meet ``FAN`` at a time and then once more.  No
row is sent for each entry of a matrix, and no group holds more than ``FAN``
strips or one for each ``FAN`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a panel of rows; leaves of a node where products are added up.
PANEL, FAN = 32 << 20, 16
#: Entries of a strip (8 MB of doubles).
STRIP = 1 << 20


def panels(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their rows as a dense matrix ``[rows, n]``, from columns ``i`` (places) and ``x``."""
    step = max(1, PANEL // (8 * max(n, 1)))
    for rb in batches:
        for s in range(0, rb.num_rows, step):
            part = rb.slice(s, step)
            where, x = (part.column(part.schema.get_field_index(c)) for c in ("i", "x"))
            size = np.diff(x.offsets.to_numpy())
            flat = x.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((part.num_rows, n))
            if where.null_count == part.num_rows:  # whole rows in order
                out[:] = flat.reshape(part.num_rows, n)
            else:
                out[np.repeat(np.arange(part.num_rows), size), where.flatten().to_numpy(zero_copy_only=False)] = flat
            yield part, out


def summed(parts: DataFrame) -> DataFrame:
    """``strip, v``: arrays (binary, doubles) added up by strip; first over ``FAN`` parts, then over what is left, so that no group is large."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for b in table.column("v"):
            x = np.frombuffer(b.as_py())
            total = x.copy() if total is None else total + x
        return pa.table({"strip": table.column("strip").slice(0, 1), "salt": pa.array([0], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    once = parts.groupBy("strip", "salt").applyInArrow(add, "strip int, salt int, v binary")
    return once.groupBy("strip").applyInArrow(add, "strip int, salt int, v binary").select("strip", "v")


def strips(total: np.ndarray, rows: int) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(total), rows):
        yield k // rows, np.ascontiguousarray(total[k : k + rows]).tobytes()


def salted(parts: DataFrame) -> DataFrame:
    """A group for every ``FAN`` partitions of parts."""
    return parts.withColumn("salt", F.floor(F.spark_partition_id() / FAN).cast("int"))
