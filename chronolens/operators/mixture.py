"""Diagonal normal mixtures, many models at once: expectation-maximisation keyed by model, components chosen by BIC.

Rows are dealt out evenly, whatever their model. A step is one pass that returns a row of sums for each component and task, for
all models and all numbers of components; what reaches the driver is the sums and the parameters, a row for each component. Rows start in
components by their order on the first element.

Edge cases: rows without a model, and rows with a null or non-finite element, are left out. A component that no row belongs to is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .lineage import dealt

RIDGE = 1e-3
PER_COMPONENT = 5


def _log_density(x: Column, mean: Column, var: Column) -> Column:
    each = F.zip_with(F.zip_with(x, mean, lambda v, m: (v - m) * (v - m)), var, lambda q, s: -0.5 * (F.log(2 * F.pi() * s) + q / s))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def _joint(x: Column) -> Column:
    """log(weight) + log density of each component of a row's model."""
    return F.transform("components", lambda c: F.log(c["weight"]) + _log_density(x, c["mean"], c["var"]))


def _log_sum(joint: Column) -> Column:
    top = F.array_max(joint)
    return top + F.log(F.aggregate(joint, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


class _Fits:
    """The fits of 1 to `most` components of each model, as flat arrays of components."""

    def __init__(self, sizes: list[int], most: int, per_component: int, d: int):
        self.sizes, self.d = sizes, d
        self.of = [(m, k) for m, n in enumerate(sizes) for k in range(1, max(1, min(most, n // per_component)) + 1)]
        self.ends = np.cumsum([0, *[k for _, k in self.of]])
        self.weight, self.mean, self.var = np.zeros(self.ends[-1]), np.zeros((self.ends[-1], d)), np.ones((self.ends[-1], d))
        self.by_model = [[f for f, (m, _) in enumerate(self.of) if m == k] for k in range(len(sizes))]

    def members(self, fit: int, x: np.ndarray, place: np.ndarray, start: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """(components in use, the share of each row in each of them, log likelihood of the rows)."""
        model, k = self.of[fit]
        used = np.arange(self.ends[fit], self.ends[fit + 1])
        if start:
            return used, (place * k // self.sizes[model])[:, None] == np.arange(k), 0.0
        used = used[self.weight[used] > 0]
        joint = np.column_stack([np.log(self.weight[c]) - 0.5 * (np.log(2 * np.pi * self.var[c]) + (x - self.mean[c]) ** 2 / self.var[c]).sum(1) for c in used])
        top = joint.max(1)
        total = top + np.log(np.exp(joint - top[:, None]).sum(1))
        return used, np.exp(joint - total[:, None]), float(total.sum())

    def maximise(self, sums: np.ndarray) -> None:
        n, s, q = sums[:, 0], sums[:, 1 : 1 + self.d], sums[:, 1 + self.d : 1 + 2 * self.d]
        use = n > 0
        m = s[use] / n[use, None]
        self.mean[use], self.var[use] = m, np.maximum(0.0, q[use] / n[use, None] - m * m) + RIDGE
        for a, b in zip(self.ends[:-1], self.ends[1:], strict=True):
            self.weight[a:b] = n[a:b] / (math.fsum(n[a:b]) or 1.0)


def _pass(data: DataFrame, fits: _Fits, start: bool = False) -> np.ndarray:
    """components x (share of rows, sums, sums of squares, log likelihood of the fit at its first component). data: m, x, place."""
    names = ["c", *[f"s{i}" for i in range(2 + 2 * fits.d)]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((int(fits.ends[-1]), 2 + 2 * fits.d))
        for b in batches:
            model, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "place"))
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(model), -1)
            for m in np.unique(model).tolist():
                mine, at = x[model == m], place[model == m]
                both = np.hstack([np.ones((len(mine), 1)), mine, mine * mine])
                for f in fits.by_model[m]:
                    used, share, ll = fits.members(f, mine, at, start)
                    out[used, :-1] += share.T.astype("float64") @ both
                    out[fits.ends[f], -1] += ll
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), *[pa.array(c) for c in out[some].T]], names=names)

    total = np.zeros((int(fits.ends[-1]), 2 + 2 * fits.d))
    for r in data.mapInArrow(each, ", ".join(["c int", *[f"{c} double" for c in names[1:]]])).groupBy("c").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():
        total[r.c] = r[1:]
    return total


def fit(rows: DataFrame, most: int = 4, steps: int = 12, per_component: int = PER_COMPONENT) -> DataFrame:
    """(model, k, n, bic, components) of the best number of components of each model; rows: model, x."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["model"]
    schema = f"model {kind}, k int, n long, bic double, components array<struct<weight:double,mean:array<double>,var:array<double>>>"
    data = rows.select("model", F.col("x").cast("array<double>").alias("x")).where("model IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))")
    counts = data.groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).orderBy("model").collect()  # a row for each model
    if not counts:
        return spark.createDataFrame([], schema)
    number = spark.createDataFrame([(r.model, m) for m, r in enumerate(counts)], f"model {kind}, m int")
    placed = ranks.positions(data.join(F.broadcast(number), "model").select("m", "x", F.col("x")[0].alias("first")), ["m"], ["first", "x"], "place")
    data = dealt(placed.select("m", "x", (F.col("place") - 1).alias("place")), sum(r.n for r in counts)).persist()
    fits = _Fits([r.n for r in counts], most, per_component, counts[0].d)
    fits.maximise(_pass(data, fits, start=True))
    for _ in range(steps):
        fits.maximise(_pass(data, fits))
    ll = _pass(data, fits)[fits.ends[:-1], -1]
    data.unpersist()
    best: dict = {}
    for f, (m, k) in enumerate(fits.of):
        bic = float(-2 * ll[f] + (k * (2 * fits.d + 1) - 1) * np.log(fits.sizes[m]))
        if m not in best or bic < best[m][0]:
            best[m] = (bic, k, f)
    out = []
    for m, (bic, k, f) in best.items():
        parts = [(float(fits.weight[c]), fits.mean[c].tolist(), fits.var[c].tolist()) for c in range(fits.ends[f], fits.ends[f + 1]) if fits.weight[c] > 0]
        out.append((counts[m].model, k, counts[m].n, bic, parts))
    return spark.createDataFrame(out, schema)


def score(rows: DataFrame, models: DataFrame, on: list[str] | None = None) -> DataFrame:
    """`rows` with the log likelihood `ll` and the likeliest component of each model (all models, or those that match `on`)."""
    scored = (rows.join(F.broadcast(models), on) if on else rows.join(F.broadcast(models))).withColumn("joint", _joint(F.col("x").cast("array<double>")))
    return scored.withColumn("ll", _log_sum(F.col("joint"))).withColumn("component", F.array_position("joint", F.array_max("joint")).cast("int") - 1).drop("joint", "components")


def divergence(rows: DataFrame, key: str, cell: str, by: list[str], seed: int = 0) -> DataFrame:
    """(by, cell_a, cell_b, divergence): symmetric, and each cell is scored on rows that its model hasn't seen.

    A cell's rows are halved by an md5 order; a model of one half scores the other half, both ways."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = ranks.positions(rows.withColumn("order_", order), [*by, cell], ["order_", key], "half").drop("order_")
    halves = placed.withColumn("half", (F.col("half") % 2).cast("int")).withColumn("model", F.concat_ws("|", F.col(cell).cast("string"), F.col("half").cast("string"))).persist()
    names = halves.select("model", *by, F.col(cell).alias("of"), F.col("half").alias("seen")).distinct()
    models = fit(halves.select("model", "x")).select("model", "components").join(names, "model").drop("model")
    scored = score(halves.select(*by, cell, "half", "x"), models, by).where("half <> seen")
    means = scored.groupBy(*by, F.col(cell).alias("test"), "of", "seen").agg(F.avg("ll").alias("ll")).groupBy(*by, "test", "of").agg(F.avg("ll").alias("ll"))
    own = means.where("test = of").select(*by, "test", F.col("ll").alias("own"))
    gain = means.join(own, [*by, "test"]).select(*by, "test", "of", (F.col("own") - F.col("ll")).alias("gain"))
    a, b = gain.select(*by, F.col("test").alias("cell_a"), F.col("of").alias("cell_b"), F.col("gain").alias("ga")), gain.select(*by, F.col("of").alias("cell_a"), F.col("test").alias("cell_b"), F.col("gain").alias("gb"))
    return a.join(b, [*by, "cell_a", "cell_b"]).where("cell_a < cell_b").select(*by, "cell_a", "cell_b", ((F.col("ga") + F.col("gb")) / 2).alias("divergence"))
