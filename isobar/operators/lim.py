"""Linear inverse models: fit from lagged covariances, deterministic and stochastic forecasts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import indexed, lag_covariance

#: Numbers of the noise factor of several substeps at once (8 MB).
JOINT = 1 << 20


@dataclass
class Lim:
    """Dynamics ``dx = L x dt + noise``; ``g`` steps one ``tau``."""

    tau: float
    g: np.ndarray
    l: np.ndarray
    q_values: np.ndarray
    q_vectors: np.ndarray
    q_scale: float

    @classmethod
    def from_covariances(cls, c0: np.ndarray, ct: np.ndarray, tau: float) -> Lim:
        g = np.linalg.solve(c0.T, ct.T).T
        lam, vec = np.linalg.eig(g)
        rate = np.log(lam.astype(complex)) / tau
        if (rate.real >= 0).any():
            raise ValueError("the dynamics grow: an eigenvalue of L has no negative real part")
        l = vec @ np.diag(rate) @ np.linalg.inv(vec)
        q = -(l @ c0 + c0 @ l.conj().T)
        if not np.allclose(q, q.conj().T, atol=1e-10):
            raise ValueError("the noise covariance is not Hermitian")
        value, vector = np.linalg.eigh(q)
        value, vector = value[::-1], vector[:, ::-1]
        good = value > 0
        # Modes with negative variance go; the rest is scaled so that the total stays.
        scale = float(value.sum() / value[good].sum()) if (value < 0).any() else 1.0
        return cls(tau, g, l, value[good] * scale, vector[:, good], scale)

    def forecast(self, x0: np.ndarray, steps: int) -> np.ndarray:
        """``[state, steps + 1]``, the start first."""
        out = np.empty((len(x0), steps + 1))
        out[:, 0] = x0
        for k in range(steps):
            out[:, k + 1] = self.g @ out[:, k]
        return out

    def simulate(self, x0: np.ndarray, steps: int, substeps: int, rng: np.random.Generator, keep_initial: bool = False) -> np.ndarray:
        """Stochastic integration of ``[state, ens]``; ``[state, ens, steps + 1]``.

        What is kept of each step is the midpoint of the following substep, as
        in the fitted scheme also for the start, unless ``keep_initial``.
        """
        move, noise, powers, joint, most = self._scheme(substeps)
        r, m = noise.shape[1], x0.shape[1]
        out = np.empty((*x0.shape, steps + 1))
        x = x0.astype(move.dtype)
        for k in range(steps + 1):
            new = move @ x
            if r:
                new += noise @ rng.standard_normal((r, m))
            out[:, :, k] = ((x + new) / 2).real
            x, left = new, substeps - 1 if k < steps else 0
            while left:
                now = min(left, most)
                x, left = powers[now] @ x, left - now
                if r:
                    x += joint[:, (most - now) * r :] @ rng.standard_normal((now * r, m))
        if keep_initial:
            out[:, :, 0] = x0
        return out

    def _scheme(self, substeps: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray, int]:
        """Matrix and noise factor of a substep, and of up to ``most`` substeps at once: powers, and what each one's draw has become."""
        kept = self.__dict__.setdefault("_schemes", {})
        if substeps not in kept:
            dt = self.tau / substeps
            # One matrix step and one noise factor, both constant.
            move = np.eye(len(self.l)) + self.l * dt
            noise = self.q_vectors * np.sqrt(self.q_values * dt)
            real = np.abs(move.imag).max() < 1e-12 and (not np.iscomplexobj(noise) or np.abs(noise.imag).max(initial=0) < 1e-12)
            if real:
                move, noise = move.real, np.real(noise)
            if not noise.any():
                noise = noise[:, :0]
            most = max(1, min(substeps - 1, JOINT // max(noise.size, 1)))
            parts, power, powers, ends = [], np.eye(len(move)), {}, {most, (substeps - 1) % most}
            for k in range(1, most + 1):
                parts.append(power @ noise)
                power = power @ move
                if k in ends:
                    powers[k] = power
            kept[substeps] = move, noise, powers, np.hstack(parts[::-1]), most
        return kept[substeps]

    def quiet(self, substeps: int) -> bool:
        """Without noise, so that members differ by their start alone."""
        return not self._scheme(substeps)[1].size

    def to_json(self) -> str:
        pair = lambda a: {"re": np.real(a).tolist(), "im": np.imag(a).tolist()}
        return json.dumps({"tau": self.tau, "q_scale": self.q_scale} | {k: pair(getattr(self, k)) for k in ("g", "l", "q_values", "q_vectors")})

    @classmethod
    def from_json(cls, text: str) -> Lim:
        d = json.loads(text)
        join = lambda v: np.array(v["re"]) + 1j * np.array(v["im"])
        return cls(d["tau"], join(d["g"]).real, join(d["l"]), join(d["q_values"]).real, join(d["q_vectors"]), d["q_scale"])


def fit(df: DataFrame, state: str, step: str, tau: float, x: str = "x") -> Lim:
    """From rows (state, step number, x) with zero mean and uniform steps."""
    cov = lag_covariance(df, state, step, 1, x).toPandas()
    n = int(cov["i"].max()) + 1
    c0, ct = np.zeros((n, n)), np.zeros((n, n))
    c0[cov["i"], cov["j"]], ct[cov["i"], cov["j"]] = cov["c0"], cov["ct"]
    return Lim.from_covariances(c0, ct, tau)


def verify(m: Lim, df: DataFrame, state: str, step: str, steps: int, x: str = "x") -> DataFrame:
    """``step, state, rmse`` of deterministic forecasts 1 to ``steps`` steps ahead.

    Every sample is a start; each of its forecasts is compared with the sample
    that many steps later, so only forecasts beyond the last sample go unverified.
    """
    st, _ = indexed(df, [state])
    n = len(m.g)
    powers = [np.linalg.matrix_power(m.g, k) for k in range(1, steps + 1)]
    vec = df.join(F.broadcast(st), state).groupBy(step).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(x).alias("x")))), lambda a: a["x"]).alias("a"))
    after = vec.select(F.explode(F.array(*[F.lit(k) for k in range(1, steps + 1)])).alias("k"), F.col(step), F.col("a").alias("truth")).withColumn(step, F.col(step) - F.col("k"))
    pairs = after.join(vec, step).select("k", "a", "truth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((steps, n)), np.zeros(steps, dtype=np.int64)
        for b in batches:
            for k, part in b.groupby("k"):
                error = np.vstack(part["a"]) @ powers[k - 1].T - np.vstack(part["truth"])
                total[k - 1] += (error**2).sum(0)
                count[k - 1] += len(part)
        if count.any():
            k, i = np.divmod(np.arange(steps * n), n)
            yield pd.DataFrame({"step": (k + 1).astype(np.int32), "_i": i.astype(np.int32), "e": total.ravel(), "m": np.repeat(count, n)})

    sums = pairs.mapInPandas(run, "step int, _i int, e double, m long").groupBy("step", "_i").agg(F.sum("e").alias("e"), F.sum("m").alias("m")).where("m > 0")
    return sums.join(F.broadcast(st), "_i").select("step", state, F.sqrt(F.col("e") / F.col("m")).alias("rmse"))
