"""A resumable assimilation cycle in physical space, its state in distributed rows.

``StateStore`` keeps the states of a run by step; ``PhysicalCycle`` advances a
window of steps: the due observations are assimilated into blocks of rows
(``enkf_blocks``), the current step is projected on the reduced space (one sum
over partitions), its members are forecast there, and the next prior is the way
back, a map of each row.  Of a step only the reduced ensemble and the gains pass
the driver.  Every step is written before the next begins, so a run that was
killed goes on after the last finished step and gives what one run would have:
random numbers depend on seed and step alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enkf_blocks as eb
from ..operators.enkf import inflate
from ..operators.lim import Lim
from ..sources import storage
from .assimilate import HISTORY, STEPS_PER_YEAR


#: Steps whose observations are read at once.
AHEAD = 32


@dataclass
class StateStore:
    """States by step under ``path/kind``: each is written once, in the order of steps.

    A finished step has Spark's success mark; what an interrupted write left is
    overwritten.  ``single``: arrays of doubles are kept as floats.
    """

    spark: SparkSession
    path: str
    kind: str
    single: bool = True
    _found: list[int] | None = None

    def _at(self, step: int) -> str:
        return f"{self.path}/{self.kind}/step={step:08d}"

    def steps(self) -> list[int]:
        """Finished states in order; the folder is listed once, a store has one writer."""
        if self._found is None:
            root = f"{self.path}/{self.kind}"
            self._found = [int(n.removeprefix("step=")) for n in storage.children(self.spark, root) if n.startswith("step=") and storage.exists(self.spark, f"{root}/{n}/_SUCCESS")]
        return self._found

    def last(self) -> int | None:
        return self.steps()[-1] if self.steps() else None

    def insert(self, step: int, rows: DataFrame) -> DataFrame:
        """Writes a state that is newer than all before and returns it as written."""
        last = self.last()
        if last is not None and step <= last:
            raise ValueError(f"{self.kind} {step} is not newer than the last state, {last}")
        if self.single:
            rows = rows.select(*[F.col(c).cast("array<float>").alias(c) if t == "array<double>" else F.col(c) for c, t in rows.dtypes])
        out = storage.written(rows, self._at(step))
        self.steps().append(step)
        return out

    def get(self, step: int) -> DataFrame:
        if step not in self.steps():
            raise ValueError(f"unknown state {step}")
        return self.spark.read.parquet(self._at(step))

    def drop(self, step: int) -> None:
        storage.delete(self.spark, self._at(step))
        self._found = [s for s in self.steps() if s != step]


def _mapped(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(x, f, b)`` on blocks of rows: window, forward and backward weights as matrices; its result becomes ``x``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for s in range(0, rb.num_rows, eb.BLOCK):
                part = rb.slice(s, eb.BLOCK)
                x, f, b = (_matrix(part, c) for c in ("x", "f", "b"))
                new = np.ascontiguousarray(work(x, f, b))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)), pa.array(new.ravel()))
                yield pa.record_batch([lists if c == "x" else part.column(part.schema.get_field_index(c)) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def _matrix(rb: pa.RecordBatch, name: str) -> np.ndarray:
    return rb.column(rb.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rb.num_rows, -1)


def reduced(rows: DataFrame, modes: int, width: int) -> np.ndarray:
    """``sum of f' x`` over all rows: ``[modes, width]``, summed in partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((modes, width))
        for rb in batches:
            if rb.num_rows:
                total += _matrix(rb, "f").T @ _matrix(rb, "x")
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(modes * width)
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one number a mode and member
        out[r["i"]] = r["v"]
    return out.reshape(modes, width)


@dataclass
class PhysicalCycle:
    """A run over ``steps`` seasons; all of it is in ``path``.

    ``space``: ``key long, lat, lon, f array<double>, b array<double>``, one row
    for each element of the state, with its weights to reduced space and back.
    ``due``: ``step, k, key, slope, intercept, obs, err_std, back`` and, where
    localised, ``lat, lon``: what is assimilated when (``assimilate.schedule``),
    in the order of ``k``; ``back`` are the steps before the current one.
    """

    spark: SparkSession
    path: str
    space: DataFrame
    due: DataFrame
    lim: Lim
    members: int
    radius_km: float | None = None
    inflation: float | None = None
    substeps: int | None = None
    history: int = HISTORY
    seed: int = 562_151
    keep_prior: bool = False

    def __post_init__(self):
        store = lambda kind, single: StateStore(self.spark, self.path, kind, single)
        self.working, self.final, self.prior = store("working", False), store("posterior", True), store("prior", True)
        self.modes = self.lim.g.shape[0]
        self._ahead: dict[int, list[dict]] = {}
        # The inputs of a run are written with it: steps read them again and again.
        for name in ("space", "due"):
            at = f"{self.path}/{name}"
            if storage.exists(self.spark, f"{at}/_SUCCESS"):
                setattr(self, name, self.spark.read.parquet(at))
            else:
                df = getattr(self, name)
                setattr(self, name, storage.written(df.repartition("step").sortWithinPartitions("step") if name == "due" else df, at))
        self.schema = "key bigint, lat double, lon double, x array<double>, f array<double>, b array<double>"

    # The forecast that follows a step, [modes, members], is part of the finished step.
    def _forecast_at(self, step: int) -> str:
        return f"{self.path}/forecast/step-{step:08d}.json"

    def _finish(self, step: int, z: np.ndarray) -> None:
        storage.put_text(self.spark, self._forecast_at(step), json.dumps(z.tolist()))

    def _forecast(self, step: int) -> np.ndarray:
        return np.array(json.loads(storage.get_text(self.spark, self._forecast_at(step))))

    def _due(self, step: int) -> list[dict]:
        """What is assimilated at a step; read for ``AHEAD`` steps at once."""
        if step not in self._ahead:
            self._ahead = {s: [] for s in range(step, step + AHEAD)}
            for r in self.due.where(F.col("step").between(step, step + AHEAD - 1)).collect():
                self._ahead[r["step"]].append(r.asDict())
        return self._ahead[step]

    def finished(self) -> int:
        """The last step whose state and forecast are written, -1 before the first."""
        steps = [s for s in self.working.steps() if storage.exists(self.spark, self._forecast_at(s))]
        return max(steps, default=-1)

    def run(self, steps: int, initial: DataFrame | None = None) -> None:
        """Goes on to ``steps`` steps in all; ``initial``: ``key, x`` (an array by member) of the first prior."""
        done = self.finished()
        for s in self.final.steps():
            if s > done - self.history + 1:  # what an earlier end took out of the window may change yet
                self.final.drop(s)
        if done < 0:
            if initial is None:
                raise ValueError("a new run needs an initial ensemble")
            now = initial.select("key", "x").join(self.space, "key").selectExpr("key", "cast(lat as double) lat", "cast(lon as double) lon", "cast(x as array<double>) x", "f", "b")
        else:
            now = self._next(done)
        for step in range(done + 1, steps):
            # A state or forecast beyond the last finished step was interrupted.
            for s in [s for s in self.working.steps() if s >= step]:
                self.working.drop(s)
            self._step(step, now)
            now = self._next(step)
        if steps:
            self._flush(max(done, steps - 1))

    def _width(self, step: int) -> int:
        return min(step + 1, self.history)

    def _next(self, step: int) -> DataFrame:
        """The window for the step after ``step``: what stays of the old one, and the forecast as its last step."""
        z, members, old = self._forecast(step), self.members, self._width(step)
        kept = min(old, self.history - 1)
        factor = self.inflation

        def work(x: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
            new = b @ z
            if factor is not None:
                new = inflate(new, factor)
            window = x.reshape(len(x), members, old)[:, :, old - kept :]
            return np.concatenate([window, new[:, :, None]], axis=2).reshape(len(x), -1)

        return _mapped(self.working.get(step), self.schema, work)

    def _step(self, step: int, now: DataFrame) -> None:
        width = self._width(step)
        last = width - 1
        if self.keep_prior:
            if step not in self.prior.steps():
                self.prior.insert(step, self._slice(now, width, last).select("key", "x"))
        models = [{**r, "times": [last - b for b in r["back"]]} for r in self._due(step) if max(r["back"]) <= last]
        after = eb.assimilate_rows(now, models, ["key"], self.members, width, self.radius_km)
        after = self.working.insert(step, after)
        z = reduced(self._slice(after, width, last), self.modes, self.members)
        rng = np.random.default_rng([self.seed, step])
        self._leave(step)
        self._finish(step, self.lim.simulate(z, 1, self.substeps or int(STEPS_PER_YEAR * self.lim.tau), rng)[:, :, -1])
        if step >= 1:  # the next step reads this one alone
            self.working.drop(step - 1)

    def _slice(self, rows: DataFrame, width: int, at: int) -> DataFrame:
        members = self.members
        return _mapped(rows, self.schema, lambda x, f, b: x.reshape(len(x), members, width)[:, :, at])

    def _leave(self, step: int) -> None:
        """The oldest step of a full window is final."""
        if self._width(step) == self.history:
            self._final(step, step - self.history + 1, 0)

    def _final(self, step: int, which: int, at: int) -> None:
        if which not in self.final.steps():
            self.final.insert(which, self._slice(self.working.get(step), self._width(step), at).select("key", "x"))

    def _flush(self, step: int) -> None:
        """What is still in the window when the run ends; a run that goes further writes it anew."""
        width = self._width(step)
        for at in range(width):
            self._final(step, step - width + 1 + at, at)

    def posterior(self) -> DataFrame:
        """``step, key, x`` of all final states."""
        last = self.final.last()
        if last is None:
            raise ValueError("no state is final yet")
        # States are written in order: only one beyond the last can be unfinished.
        return self.spark.read.parquet(f"{self.path}/{self.final.kind}").where(F.col("step") <= last).select("step", "key", "x")
