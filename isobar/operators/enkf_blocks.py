"""Serial square-root filter over a state of any size, in blocks of rows.

Observations are assimilated one after the other, each estimated from the state
that the ones before have left.  The estimates need only the rows that are
looked at, about as many as there are observations; these are updated like any
row of the state, so the whole sequence can be worked out on them alone, and
what a state row needs of an observation is its shift by member, its deviations
and the variance of its innovation.  These are sent to all tasks, and every
block of rows takes all updates in one pass, apart from all others, without a
shuffle.

A row is ``x array<double>``, members times steps of a window (the steps of a
member together), with any columns beside it; localised filters need ``lat``
and ``lon``.  An observation with ``times`` stands for the mean over these steps
of the window: that mean is updated, deviations from it stay.

Without localisation a sequence of updates is one linear map of a row, so it is
multiplied once on the identity and then on every row as a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_RADIUS_M

#: Numbers of the rows that are looked at, and of the gains that are sent to every task (0.5 GB of doubles).
CELLS = 1 << 26
#: Rows that are updated at once.
BLOCK = 2048


@dataclass
class Gains:
    """A sequence of observations as a state row needs it; the first axis is the observation."""

    members: int
    steps: int
    deviation: np.ndarray  # of the estimate, by member
    shift: np.ndarray  # what a gain of 1 adds to each member
    innovation: np.ndarray
    times: list[list[int]]
    lat: np.ndarray
    lon: np.ndarray
    radius_km: float | None

    def __len__(self) -> int:
        return len(self.innovation)


def gaspari_cohn(km: np.ndarray, radius: float) -> np.ndarray:
    """Fifth-order weights that fall from 1 at 0 to 0 at ``radius``."""
    z = km / (radius / 2)
    near = 1 + z**2 * (-5 / 3 + z * (5 / 8 + z * (0.5 - z / 4)))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = 4 - 5 * z + z**2 * (5 / 3 + z * (5 / 8 + z * (-0.5 + z / 12))) - 2 / (3 * z)
    return np.where(z <= 1, near, np.where(z <= 2, far, 0.0))


def distance_km(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    a, b = np.radians(lat0), np.radians(lat)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - lon0) / 2) ** 2
    return 2 * EARTH_RADIUS_M / 1e3 * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _move(x: np.ndarray, k: int, gains: Gains, lat: np.ndarray | None, lon: np.ndarray | None) -> None:
    """Observation ``k`` on rows ``x[row, member, step]``, in place."""
    rows: np.ndarray | slice = slice(None)
    weight: np.ndarray | float = 1.0
    if gains.radius_km is not None:
        weight = gaspari_cohn(distance_km(lat, lon, gains.lat[k], gains.lon[k]), gains.radius_km)
        rows = np.flatnonzero(weight)
        if not len(rows):
            return
        weight = weight[rows]
    at = gains.times[k]
    mean = x[rows][:, :, at].mean(axis=2)
    gain = (mean - mean.mean(axis=1, keepdims=True)) @ gains.deviation[k] / (gains.members - 1) / gains.innovation[k] * weight
    change = np.outer(gain, gains.shift[k])
    for t in at:
        x[rows, :, t] += change


def solve(x: np.ndarray, observations: list[dict], members: int, steps: int = 1, radius_km: float | None = None, lat: np.ndarray | None = None, lon: np.ndarray | None = None) -> Gains:
    """The gains of ``observations`` in their order, worked out on the state rows ``x`` that they look at.

    An observation has ``look`` (pairs of a row's number and its slope),
    ``intercept``, ``obs``, ``err_std``, ``times``, and ``lat, lon`` where
    localised; ``lat`` and ``lon`` are those of the rows.  Each updates all
    rows, so the next is estimated from what it left.
    """
    y = np.array(x, float).reshape(len(x), members, steps)
    m = len(observations)
    place = [np.array([o[c] for o in observations], float) if radius_km is not None else np.zeros(m) for c in ("lat", "lon")]
    g = Gains(members, steps, np.zeros((m, members)), np.zeros((m, members)), np.ones(m), [list(o["times"]) for o in observations], *place, radius_km)
    for k, o in enumerate(observations):
        own = o["intercept"] + sum(slope * y[row][:, g.times[k]].mean(axis=1) for row, slope in o["look"])
        g.deviation[k] = own - own.mean()
        g.innovation[k] = own.var(ddof=1) + o["err_std"] ** 2
        alpha = 1 / (1 + np.sqrt(o["err_std"] ** 2 / g.innovation[k]))
        g.shift[k] = o["obs"] - own.mean() - alpha * g.deviation[k]
        if not np.isfinite(g.shift[k]).all():
            raise ValueError("no posterior value is finite")
        _move(y, k, g, lat, lon)
    return g


def as_map(gains: Gains) -> np.ndarray:
    """What an unlocalised sequence does to a row, as a matrix that multiplies it from the right."""
    n = gains.members * gains.steps
    x = np.eye(n).reshape(n, gains.members, gains.steps)
    for k in range(len(gains)):
        _move(x, k, gains, None, None)
    return x.reshape(n, n)


def apply_gains(x: np.ndarray, gains: Gains, matrix: np.ndarray | None, lat: np.ndarray | None = None, lon: np.ndarray | None = None) -> np.ndarray:
    """Rows ``[row, member * step]`` after all observations."""
    if matrix is not None:
        return x @ matrix
    x = x.reshape(len(x), gains.members, gains.steps).copy()
    for k in range(len(gains)):
        _move(x, k, gains, lat, lon)
    return x.reshape(len(x), -1)


def update_blocks(state: DataFrame, gains: Gains) -> DataFrame:
    """``state`` with ``x`` after all observations of ``gains``; one narrow pass."""
    if not len(gains):
        return state
    if len(gains) * gains.members * 2 > CELLS:
        raise ValueError(f"gains of {len(gains)} observations and {gains.members} members are too many to send: assimilate them in several calls")
    matrix = as_map(gains) if gains.radius_km is None else None
    shared = state.sparkSession.sparkContext.broadcast((gains, matrix))  # bounded above
    at = state.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, m = shared.value
        width = g.members * g.steps
        for rb in batches:
            for s in range(0, rb.num_rows, BLOCK):
                part = rb.slice(s, BLOCK)
                lists = part.column(at)
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(x) != part.num_rows * width:
                    raise ValueError(f"every row of the state needs {width} values")
                place = [part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lat", "lon")] if m is None else []
                new = apply_gains(x.reshape(-1, width), g, m, *place)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, width, dtype=np.int32)), pa.array(new.ravel()))
                yield part.set_column(at, rb.schema.names[at], column.cast(lists.type))

    return state.mapInArrow(run, state.schema)


def ensemble_rows(long: DataFrame, state: list[str], ens: str = "ens", value: str = "value") -> DataFrame:
    """Rows with ``x`` from a long table; every state element must have all members."""
    return long.groupBy(*state).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ens).alias("e"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("x"))


def long_rows(rows: DataFrame, state: list[str], steps: int = 1) -> DataFrame:
    """``state, ens, [step,] value`` of rows with ``x``."""
    out = rows.select(*state, F.posexplode("x").alias("_k", "value"))
    out = out.withColumn("ens", F.floor(F.col("_k") / steps).cast("int"))
    return out.select(*state, "ens", *([(F.col("_k") % steps).cast("int").alias("step")] if steps > 1 else []), "value")


def assimilate_blocks(state: DataFrame, models: DataFrame, keys: list[str], members: int, steps: int = 1, radius_km: float | None = None) -> DataFrame:
    """Posterior rows after all observations of ``models``, in the order of ``k``.

    ``models``: ``k, keys, slope, intercept, obs, err_std, times`` and, where
    localised, ``lat, lon`` of the observation; one row for each state row that
    an observation looks at, which share all but ``keys`` and ``slope``.  The
    state rows that are looked at reach the driver, ``CELLS`` numbers at most;
    a longer sequence is assimilated in several calls, which gives the same
    result.
    """
    looked = [r.asDict() for r in models.limit(CELLS // (members * steps) + 1).collect()]
    return assimilate_rows(state, looked, keys, members, steps, radius_km)


def assimilate_rows(state: DataFrame, looked: list[dict], keys: list[str], members: int, steps: int = 1, radius_km: float | None = None) -> DataFrame:
    """``assimilate_blocks`` with the models as rows that are here already."""
    if len(looked) * members * steps > CELLS:
        raise ValueError(f"more than {CELLS // (members * steps)} rows of observation models are too many for one call")
    if not looked:
        return state
    wanted = sorted({tuple(r[c] for c in keys) for r in looked})
    # A handful of keys beside a state of any size.
    if len(keys) == 1 and len(wanted) <= 1000:
        seen = state.where(F.col(keys[0]).isin([w[0] for w in wanted])).collect()
    else:
        schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in keys)
        seen = state.join(F.broadcast(state.sparkSession.createDataFrame(wanted, schema)), keys, "left_semi").collect()
    number = {tuple(r[c] for c in keys): k for k, r in enumerate(seen)}
    if len(number) < len(seen):
        raise ValueError(f"several rows of the state have the same {keys}")
    by_k: dict[int, dict] = {}
    for r in looked:
        if (row := number.get(tuple(r[c] for c in keys))) is None:
            raise ValueError("an observation looks at no row of the state")
        by_k.setdefault(r["k"], {**r, "look": []})["look"].append((row, r["slope"]))
    place = [np.array([r[c] for r in seen], float) if radius_km is not None else None for c in ("lat", "lon")]
    observations = [o for _, o in sorted(by_k.items())]
    return update_blocks(state, solve(np.array([r["x"] for r in seen]), observations, members, steps, radius_km, *place))
