"""Physical to reduced space and back: EOFs of each field, then joint EOFs.

Each field is standardised and projected on its own modes; fields that are not
kept directly are projected on joint modes.  Both steps are linear, so the
mapping is one matrix in either direction (rows: reduced elements), which is
multiplied with distributed state vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import area_weight
from .linear import EofFit, by_mode, eof_fit, nan_mask, product, project, reconstruct, sized
from .reduce import area_weighted_mean, field_std

#: Fields whose global mean stays in their modes.
KEEP_MEAN = ("siconc", "siconcn", "siconcs")


@dataclass
class Mapper:
    k: int
    l: int
    k_direct: dict[str, int] = field(default_factory=dict)
    by_season: bool = False
    separate_mean: bool = False
    fields: list[str] = field(default_factory=list)
    std: dict = field(default_factory=dict)  # (field, season or None) -> std
    mean_std: dict = field(default_factory=dict)
    eofs: dict[str, EofFit] = field(default_factory=dict)
    joint: np.ndarray | None = None

    # -- fit ------------------------------------------------------------
    def _scaled(self, df: DataFrame) -> DataFrame:
        """Weighted, standardised values ``x`` of (field, lat, lon, time) rows."""
        s = F.col("season") if self.by_season else F.lit(-1)
        std = F.create_map(*[F.lit(v) for (f, q), sd in self.std.items() for v in (f"{f}|{-1 if q is None else q}", sd)])
        return df.withColumn("x", F.col("value") * F.sqrt(area_weight(F.col("lat"))) / std[F.concat("field", F.lit("|"), s.cast("string"))])

    def _split(self, df: DataFrame, time: list[str]) -> tuple[DataFrame, DataFrame | None]:
        if not self.separate_mean:
            return df, None
        own = df.where(~F.col("field").isin(*KEEP_MEAN))
        mean = area_weighted_mean(own, ["field", *time])
        rest = df.join(mean.withColumnRenamed("value", "_g"), ["field", *time], "left").withColumn("value", F.col("value") - F.coalesce("_g", F.lit(0.0))).drop("_g")
        return rest, mean

    def fit(self, df: DataFrame, time: list[str]) -> Mapper:
        """From (field, lat, lon, time columns, value); with ``by_season`` the time columns hold ``season``."""
        df = nan_mask(df, ["field", "lat", "lon"]).persist()
        self.fields = sorted(r[0] for r in df.select("field").distinct().collect())
        rest, mean = self._split(df, time)
        q = ["season"] if self.by_season else []
        self.std = {(r["field"], r["season"] if q else None): r["std"] for r in field_std(rest, ["field", *q]).collect()}
        if mean is not None:
            self.mean_std = {(r["field"], r["season"] if q else None): r["s"] for r in mean.groupBy("field", *q).agg(F.stddev_pop("value").alias("s")).collect()}
        scaled = self._scaled(rest)
        for f in self.fields:
            self.eofs[f] = eof_fit(scaled.where(F.col("field") == f), ["lat", "lon"], time, self.k_direct.get(f, self.k))
        joint = [f for f in self.fields if f not in self.k_direct]
        if joint:
            scores = self._individual(df, time).where(F.col("part") < self._sizes(joint))
            fit = eof_fit(scores.withColumnRenamed("score", "x"), ["part"], time, self.l)
            self.joint = fit.u
        df.unpersist()
        return self

    def _order(self) -> list[str]:
        """Fields of the joint modes, then the direct ones."""
        return [f for f in self.fields if f not in self.k_direct] + [f for f in self.fields if f in self.k_direct]

    def _has_mean(self, f: str) -> bool:
        return self.separate_mean and f not in KEEP_MEAN

    def _sizes(self, fields: list[str]) -> int:
        return sum(self.eofs[f].u.shape[1] + self._has_mean(f) for f in fields)

    def _starts(self) -> dict[str, int]:
        out, at = {}, 0
        for f in self._order():
            out[f] = at
            at += self._sizes([f])
        return out

    @property
    def n_reduced(self) -> int:
        joint = [f for f in self.fields if f not in self.k_direct]
        return (self.joint.shape[1] if joint else 0) + self._sizes([f for f in self.fields if f in self.k_direct])

    # -- tables ---------------------------------------------------------
    def _modes(self, spark: SparkSession) -> DataFrame:
        """(field, lat, lon, first, u): a field's modes over the root of the retained variance, and their place in the stacked vector."""
        starts, rows = self._starts(), []
        for f in self.fields:
            e = self.eofs[f]
            at = starts[f] + self._has_mean(f)
            rows += [(f, float(lat), float(lon), at, u) for (lat, lon), u in zip(e.states, (e.u / np.sqrt(e.retained)).tolist(), strict=True)]
        return spark.createDataFrame(rows, "field string, lat double, lon double, first int, u array<double>")

    def _individual(self, df: DataFrame, time: list[str]) -> DataFrame:
        """``time, part, score`` of the first step."""
        rest, mean = self._split(df, time)
        out = project(self._scaled(rest), self._modes(df.sparkSession), ["field", "lat", "lon"], time).withColumnRenamed("mode", "part")
        if mean is not None:
            starts = self._starts()
            place = F.create_map(*[F.lit(v) for f in self.fields if self._has_mean(f) for v in (f, starts[f])])
            s = F.col("season") if self.by_season else F.lit(-1)
            std = F.create_map(*[F.lit(v) for (f, q), sd in self.mean_std.items() for v in (f"{f}|{-1 if q is None else q}", sd)])
            means = mean.select(*time, place[F.col("field")].alias("part"), (F.col("value") / std[F.concat("field", F.lit("|"), s.cast("string"))]).alias("score"))
            out = out.unionByName(means).groupBy(*time, "part").agg(F.sum("score").alias("score"))
        return out

    def forward(self, df: DataFrame, time: list[str]) -> DataFrame:
        """``time, state, x``: reduced state of complete state vectors."""
        parts = self._individual(df, time)
        m = self._reduction()
        spark = df.sparkSession
        rows = spark.createDataFrame([(p, m[:, p].tolist()) for p in range(m.shape[1])], "part int, u array<double>")
        return project(parts, rows, ["part"], time, "score").select(*time, F.col("mode").alias("state"), F.col("score").alias("x"))

    def _reduction(self) -> np.ndarray:
        """Stacked first-step scores to the reduced state."""
        joint = self._sizes([f for f in self.fields if f not in self.k_direct])
        n = self._sizes(self.fields)
        out = np.zeros((self.n_reduced, n))
        j = self.joint.shape[1] if self.joint is not None else 0
        if j:
            out[:j, :joint] = self.joint.T
        out[j:, joint:] = np.eye(n - joint)
        return out

    def backward_rows(self) -> list[tuple[str, float, float, int, list[float]]]:
        """(field, lat, lon, season, row of the backward matrix); season -1 without seasonal scaling."""
        back, starts, rows = self._reduction().T, self._starts(), []
        seasons = sorted({q for _, q in self.std if q is not None}) or [None]
        for f in self.fields:
            e, at = self.eofs[f], starts[f]
            own = back[at + self._has_mean(f) : at + self._sizes([f])]
            for (lat, lon), u in zip(e.states, e.u, strict=True):
                for q in seasons:
                    # The parts with their own seasonal spread are scaled each by it.
                    r = u @ own * np.sqrt(e.retained) * self.std[(f, q)] / np.sqrt(np.cos(np.radians(lat)))
                    if self._has_mean(f):
                        r = r + back[at] * self.mean_std[(f, q)]
                    rows.append((f, float(lat), float(lon), -1 if q is None else q, r.tolist()))
        return rows

    def backward_matrix(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.backward_rows(), "field string, lat double, lon double, season int, u array<double>")

    def backward(self, reduced: DataFrame, time: list[str], places: DataFrame | None = None) -> DataFrame:
        """``field, lat, lon, time, value``; with ``places`` (field, lat, lon) only those rows of the matrix are used."""
        m = self.backward_matrix(reduced.sparkSession)
        if places is not None:
            m = m.join(F.broadcast(places.select("field", "lat", "lon").distinct()), ["field", "lat", "lon"], "left_semi")  # rows of the matrix bound it
        if self.by_season:
            each = by_mode(reduced, time, "state", "x").join(sized(m), "season")
            return each.select("field", "lat", "lon", *time, product(F.col("u"), F.col("_s")).alias("value"))
        scores = reduced.select(*time, F.col("state").alias("mode"), F.col("x").alias("score"))
        return reconstruct(scores, m.drop("season"), ["field", "lat", "lon"], time).withColumnRenamed("x", "value")

    def truncate(self, df: DataFrame, time: list[str]) -> DataFrame:
        """Through reduced space and back; gaps count as 0, cells without any value stay empty."""
        full = df.withColumn("value", F.coalesce("value", F.lit(0.0)))
        empty = df.groupBy("field", "lat", "lon").agg(F.count("value").alias("_n")).where("_n = 0")
        back = self.backward(self.forward(full, time), time)
        return back.join(empty.select("field", "lat", "lon", F.lit(True).alias("_e")), ["field", "lat", "lon"], "left").withColumn("value", F.when(F.col("_e"), None).otherwise(F.col("value"))).drop("_e")

    def matrices(self) -> tuple[list[tuple[str, float, float]], np.ndarray, np.ndarray]:
        """State places and the whole mapping as two matrices (without seasonal scaling)."""
        if self.by_season:
            raise ValueError("one pair of matrices has no seasons")
        rows = self.backward_rows()
        places = [(f, lat, lon) for f, lat, lon, _, _ in rows]
        back = np.array([r for *_, r in rows])
        reduce_ = self._reduction()
        forward, at, starts = np.zeros((self.n_reduced, len(rows))), 0, self._starts()
        for f in self.fields:
            e = self.eofs[f]
            w = np.sqrt(np.cos(np.radians([s[0] for s in e.states])))
            n, k = len(w), starts[f] + self._has_mean(f)
            step = np.zeros((reduce_.shape[1], n))
            # Weighted modes; of the centred field, so their sum times the mean's weights goes off, without a matrix of cells by cells.
            own = e.u.T / np.sqrt(e.retained) * w
            if self._has_mean(f):
                own = own - np.outer(own.sum(axis=1), w**2 / (w**2).sum())
            step[k : k + e.u.shape[1]] = own / self.std[(f, None)]
            if self._has_mean(f):
                step[starts[f]] = w**2 / (w**2).sum() / self.mean_std[(f, None)]
            forward[:, at : at + n] = reduce_ @ step
            at += n
        return places, forward, back

    def individual_mode(self, spark: SparkSession, f: str, n: int) -> DataFrame:
        """Physical pattern of a field's mode."""
        e = self.eofs[f]
        std = self.std[(f, min((q for g, q in self.std if g == f and q is not None), default=None))]
        return spark.createDataFrame([(f, float(a), float(b), float(u[n] * std / np.sqrt(np.cos(np.radians(a))))) for (a, b), u in zip(e.states, e.u, strict=True)], "field string, lat double, lon double, value double")

    def joint_mode(self, spark: SparkSession, n: int) -> DataFrame:
        """Physical pattern of a joint mode."""
        return spark.createDataFrame([(f, a, b, q, r[n]) for f, a, b, q, r in self.backward_rows()], "field string, lat double, lon double, season int, value double")
