"""Panels of likelihood-ratio models: rows once, models as arrays.

A model is a ridge fusion of the same features and an isotonic calibrator, and differs from the others only in the rows that it
learns from and in its strength. Rows are never copied for models: a row carries the number of its source (0 for label 0) and of
its fold, a model which sources it learns from and which fold it doesn't see. All models are fitted, calibrated and applied in the
same passes over the rows, as matrices in the tasks:

- A Newton step is one pass that returns a row of sums for each model and task, added up by model; the driver solves one small
  system a model. Steps begin at the models of a bounded sample of rows, which only saves passes: they end at the same optimum.
- Calibrators need scores in order. This is the only place where a row counts once for each model, so scores travel packed: a task
  sends one sorted array of scores, with counts of equal ones, for each model, range of scores and label, and they are shuffled
  once, into ranges of about `RANGE` scores that are pooled where they lie.
- Ratios of a row under all models are one array column, from one pass; where only their costs are asked for, the tasks add them up. Blocks of calibrators go to the tasks up to a
  number of rows; beyond it scores meet them in a join by range.

Edge cases: a model without rows of both labels has no fit; its coefficients and ratios are NaN. Null or NaN features make a row's
ratios NaN and keep it out of the fit. An empty table has no models' sums, so all ratios are NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import calibrate

SAMPLE = 20_000
KNOTS = 500_000
BUFFER, RANGE = 4_000_000, 500_000


@dataclass
class Models:
    """keep: models x sources, what each learns from (source 0: label 0); held: the fold it doesn't see, -1 for none; l2: its strength."""

    keep: np.ndarray
    held: np.ndarray = field(default=None)
    l2: np.ndarray = field(default=None)

    def __post_init__(self):
        n = len(self.keep)
        self.keep = np.asarray(self.keep, bool)
        self.held = np.full(n, -1) if self.held is None else np.asarray(self.held)
        self.l2 = np.ones(n) if self.l2 is None else np.asarray(self.l2, "float64")

    def learns(self, source: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """rows x models."""
        return self.keep.T[source] & (fold[:, None] != self.held)


def numbered(df: DataFrame, label: str, source: str) -> tuple[DataFrame, list]:
    """`df` with `source_no`: 0 for label 0, 1 and on for the sources of label 1 in order of name; and their names. A registry: a row a source."""
    names = [r[0] for r in df.where(F.col(label) == 1).select(source).distinct().orderBy(source).collect()]
    table = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names, 1)], f"name_ {dict(df.dtypes)[source]}, source_no int")
    out = df.join(F.broadcast(table), (F.col(source) == F.col("name_")) & (F.col(label) == 1), "left").drop("name_")
    return out.withColumn("source_no", F.coalesce("source_no", F.lit(0))), names


def _columns(batch: pa.RecordBatch, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False).astype("float64") for c in features]])
    return x, batch.column("source_no").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def _inputs(rows: DataFrame, features: list[str]) -> DataFrame:
    fold = F.col("fold") if "fold" in rows.columns else F.lit(-2)
    return rows.select("source_no", fold.cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in features])


def _weights(counts: list[tuple[int, int, int]], models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of label 0 and 1 that each model learns from, and the weight of a row of either: both labels weigh alike, and all weights add up to the rows."""
    n = np.zeros((2, len(models.keep)))
    for source, fold, count in counts:
        n[int(source > 0)] += count * models.learns(np.array([source]), np.array([fold]))[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        w0, w1 = (np.where((n > 0).all(0), n.sum(0) / (2 * n[j]), 0.0) for j in (0, 1))
    return n[0], n[1], w0, w1


def _sums(x: np.ndarray, source: np.ndarray, fold: np.ndarray, beta: np.ndarray, models: Models, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """models x (gradient, upper half of the Hessian) of the weighted logistic loss."""
    ok = np.isfinite(x).all(1)
    x, source, fold = x[ok], source[ok], fold[ok]
    y = (source > 0)[:, None]
    p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -500, 500)))
    w = models.learns(source, fold) * np.where(y, w1, w0)
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([((y - p) * w).T @ x, (p * (1 - p) * w).T @ (x[:, i] * x[:, j])])


def _step(total: np.ndarray, beta: np.ndarray, models: Models) -> tuple[np.ndarray, float]:
    m = beta.shape[1]
    i, j = np.triu_indices(m)
    out, change = beta.copy(), 0.0
    for k, row in enumerate(total):
        if not row.any():
            continue
        hess = np.zeros((m, m))
        hess[i, j] = hess[j, i] = row[m:]
        ridge = np.diag([0.0, *[models.l2[k]] * (m - 1)])
        d = np.linalg.solve(hess + ridge + 1e-12 * np.eye(m), row[:m] - ridge @ beta[k])
        out[k], change = beta[k] + d, max(change, float(np.abs(d).max()))
    return out, change


def fit(rows: DataFrame, models: Models, features: list[str], steps: int = 25, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients: models x (1 + features), rows of label 0 and of label 1 that each learned from). rows: source_no, fold if any model holds one out, features."""
    data = _inputs(rows, features)
    m, size = len(features) + 1, (len(features) + 1) * (len(features) + 4) // 2
    finite = " AND ".join([f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features])
    counts = [tuple(r) for r in data.where(finite).groupBy("source_no", "fold").count().collect()]
    n0, n1, w0, w1 = _weights(counts, models)
    beta, total = np.zeros((len(models.keep), m)), sum(c for *_, c in counts)
    if total > 2 * SAMPLE:
        drawn = data.where(F.pmod(F.xxhash64(*data.columns), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total)).toArrow().combine_chunks().to_batches()
        if drawn:
            x, source, fold = _columns(drawn[0], features)
            near = _weights([(a, b, 1) for a, b in zip(source.tolist(), fold.tolist(), strict=True)], models)[2:]
            for _ in range(steps):
                beta, change = _step(_sums(x, source, fold, beta, models, *near), beta, models)
                if change < 1e-6:
                    break
    names = ["model", *[f"s{i}" for i in range(size)]]
    schema = ", ".join(["model int", *[f"{c} double" for c in names[1:]]])
    for _ in range(steps):
        now = beta

        def each(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = sum((_sums(*_columns(b, features), now, models, w0, w1) for b in batches), np.zeros((len(now), size)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now), dtype="int32")), *[pa.array(c) for c in total.T]], names=names)

        total = np.zeros((len(beta), size))
        for r in data.mapInArrow(each, schema).groupBy("model").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():
            total[r.model] = r[1:]
        beta, change = _step(total, beta, models)
        if change < tol:
            break
    beta[w0 + w1 == 0] = np.nan
    return beta, n0, n1


def _cuts(data: DataFrame, models: Models, beta: np.ndarray, features: list[str], n: np.ndarray) -> list[np.ndarray]:
    """For each model the scores that part its ranges of about `RANGE` of its n scores. They come from a bounded sample: nothing but the sizes of the ranges depends on them."""
    ranges, none = np.ceil(np.nan_to_num(n) / RANGE).astype(int), np.zeros(0)
    if ranges.max(initial=0) < 2:
        return [none] * len(beta)
    share = min(1.0, SAMPLE / max(1, data.count()))
    drawn = data.where(F.pmod(F.xxhash64(*data.columns), F.lit(1 << 30)) < int((1 << 30) * share)).toArrow().combine_chunks().to_batches()
    if not drawn:
        return [none] * len(beta)
    x, source, fold = _columns(drawn[0], features)
    score, on = beta @ x.T, models.learns(source, fold).T & np.isfinite(x).all(1)
    seen = [s[o & np.isfinite(s)] for s, o in zip(score, on, strict=True)]
    return [np.unique(np.quantile(s, np.arange(1, r) / r)) if r > 1 and len(s) else none for s, r in zip(seen, ranges.tolist(), strict=True)]


def _packed(values: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, its distinct scores in order, how often each comes up: a byte each where that is enough, else eight)."""
    lo, n = np.unique(values, return_counts=True)
    ends = [0, *np.searchsorted(lo, cuts).tolist(), len(lo)]
    for part, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a < b:
            yield part, lo[a:b].tobytes(), n[a:b].astype("uint8" if n[a:b].max() < 256 else "int64").tobytes()


def _unpacked(scores: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    lo = np.frombuffer(scores)
    return lo, np.frombuffer(counts, "uint8" if len(counts) == len(lo) else "int64").astype("int64")


def blocks(rows: DataFrame, models: Models, beta: np.ndarray, features: list[str], n0: np.ndarray, n1: np.ndarray) -> DataFrame:
    """(model, lo, hi, w, w1): the blocks of each model's isotonic calibrator, on the rows it learned from."""
    data, names = _inputs(rows, features), ["model", "part", "one", "scores", "counts"]
    with np.errstate(divide="ignore"):
        w0, w1 = 0.5 / n0, 0.5 / n1
    cuts = _cuts(data, models, beta, features, n0 + n1)

    def send(held: list[tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        for k, of in enumerate(held):
            found = [(k, part, bool(one), lo, n) for one, values in enumerate(of) if values for part, lo, n in _packed(np.concatenate(values), cuts[k])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [([], []) for _ in beta], 0
        for b in batches:
            x, source, fold = _columns(b, features)
            score, y = beta @ x.T, source > 0
            on = np.ascontiguousarray(models.learns(source, fold).T) & np.isfinite(score)
            for k, of in enumerate(held):
                for one, use in enumerate((on[k] & ~y, on[k] & y)):
                    if len(values := score[k][use]):
                        of[one].append(values)
                        size += len(values)
            if size > BUFFER:
                yield from send(held)
                held, size = [([], []) for _ in beta], 0
        yield from send(held)

    def here(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(s, c) for s, c in zip(rows["scores"], rows["counts"], strict=True)]
        lo, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        ones = n * np.repeat(rows["one"].to_numpy(), [len(p[0]) for p in parts])
        order = np.argsort(lo)
        lo = lo[order]
        first = np.flatnonzero(np.append(True, lo[1:] > lo[:-1]))
        lo = lo[first]
        # Shares by counts rise where those by weights do, and counts are added without rounding.
        pooled = calibrate._pooled(np.column_stack([lo, lo, np.add.reduceat(n[order], first), np.add.reduceat(ones[order], first)]))
        return pd.DataFrame(pooled, columns=calibrate.BLOCK).assign(model=rows["model"].iloc[0])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["model"].iloc[0])
        pooled = calibrate._pooled(rows.sort_values("lo")[calibrate.BLOCK].to_numpy())
        zeros, ones = (pooled[:, 2] - pooled[:, 3]) * w0[k], pooled[:, 3] * w1[k]
        return pd.DataFrame({"model": k, "lo": pooled[:, 0], "hi": pooled[:, 1], "w": zeros + ones, "w1": ones})

    tasks = max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(np.nansum(n0 + n1) / (4 * RANGE)))
    sent = data.mapInArrow(each, "model int, part int, one boolean, scores binary, counts binary").repartition(tasks, "model", "part")
    kinds = "lo double, hi double, w double, w1 double"
    return sent.groupBy("model", "part").applyInPandas(here, f"{kinds}, model int").groupBy("model").applyInPandas(whole, f"model int, {kinds}")


def knots_of(table: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of n models, the ends of its blocks in order and the shares of label 1 there. table: (model, lo, hi, w, w1), of a size that was checked."""
    found: list = [([], []) for _ in range(n)]
    for r in sorted(table.collect(), key=lambda r: (r.model, r.lo)):
        found[r.model][0].extend((r.lo, r.hi))
        found[r.model][1].extend([r.w1 / r.w] * 2)
    return [(np.array(x), np.array(p)) for x, p in found]


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.round(p, 12)
    return np.where(p >= 1, np.inf, p / np.where(p >= 1, 1.0, 1 - p))


def apply(rows: DataFrame, beta: np.ndarray, knots: list[tuple[np.ndarray, np.ndarray]], features: list[str], bounds: np.ndarray | None = None, of_fold: np.ndarray | None = None, name: str = "lr") -> DataFrame:
    """`rows` with an array of ratios under each model, in one pass; within `bounds` (models x 2), if given.

    of_fold (folds x places): a row gets the ratios of the models numbered there for its fold, and not of all."""
    which = np.arange(len(beta))[None] if of_fold is None else np.asarray(of_fold)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False).astype("float64") for c in features]])
            fold = np.zeros(b.num_rows, int) if of_fold is None else b.column("fold").to_numpy(zero_copy_only=False)
            lr = np.full((b.num_rows, which.shape[1]), np.nan)
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                score = x[at] @ beta[which[f]].T
                for j, k in enumerate(which[f].tolist()):
                    if len(knots[k][0]):
                        r = _odds(np.interp(score[:, j], *knots[k]))
                        lr[at, j] = r if bounds is None else np.clip(r, *bounds[k])
            lr[~np.isfinite(x).all(1)] = np.nan
            ends = pa.array(np.arange(b.num_rows + 1, dtype="int32") * lr.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(lr.ravel()))], names=schema.names)

    return rows.mapInArrow(each, schema)


def costs(rows: DataFrame, models: Models, beta: np.ndarray, knots: list[tuple[np.ndarray, np.ndarray]], features: list[str], bounds: np.ndarray, of_fold: np.ndarray) -> DataFrame:
    """(model, cllr): the cost of each model's ratios within `bounds` over the rows of its sources in the fold for which of_fold numbers it; null
    without rows of both labels. Penalties are added up in the tasks, so a row is never copied for models. NaN ratios count as the upper bound."""
    which, names = np.asarray(of_fold), ["model", "n0", "n1", "c0", "c1"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(beta), 4))
        for b in batches:
            x, source, fold = _columns(b, features)
            ok = np.isfinite(x).all(1)
            for f in np.unique(fold).tolist():
                for k in which[f].tolist():
                    at = np.flatnonzero((fold == f) & models.keep[k][source])
                    lr = np.full(len(at), np.inf)
                    if len(knots[k][0]):
                        lr = np.where(ok[at], _odds(np.interp(x[at] @ beta[k], *knots[k])), np.inf)
                    lr, y = np.minimum(np.maximum(lr, bounds[k, 0]), bounds[k, 1]), source[at] > 0
                    with np.errstate(divide="ignore"):
                        total[k] += (~y).sum(), y.sum(), np.log2(1 + lr[~y]).sum(), np.log2(1 + 1 / lr[y]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(beta), dtype="int32")), *[pa.array(c) for c in total.T]], names=names)

    sums = _inputs(rows, features).mapInArrow(each, "model int, n0 double, n1 double, c0 double, c1 double").groupBy("model").agg(*[F.sum(c).alias(c) for c in names[1:]])
    mean = lambda j: F.when(F.col(f"n{j}") > 0, F.col(f"c{j}") / F.col(f"n{j}"))
    return sums.select("model", (0.5 * (mean(1) + mean(0))).alias("cllr"))


def ratios(rows: DataFrame, key: str, table: DataFrame, beta: np.ndarray, features: list[str], of_fold: np.ndarray | None = None, name: str = "lr", most: int = KNOTS) -> DataFrame:
    """`rows` with an array of ratios, calibrated by the blocks of `table`: sent to the tasks up to `most` blocks, else joined by range."""
    if table.limit(most + 1).count() <= most:
        return apply(rows, beta, knots_of(table, len(beta)), features, of_fold=of_fold, name=name)
    which = np.arange(len(beta))[None] if of_fold is None else np.asarray(of_fold)
    fold = F.col("fold") if of_fold is not None else F.lit(0)
    score = lambda b: sum((F.lit(float(v)) * F.col(c) for v, c in zip(b[1:], features, strict=True)), F.lit(float(b[0])))
    models = F.array(*[F.array(*[F.struct(F.lit(int(k)).alias("model"), F.lit(j).alias("place"), score(beta[k]).alias("score")) for j, k in enumerate(w)]) for w in which.tolist()])
    long = rows.select(key, F.inline(F.get(models, fold)))
    found = calibrate.interpolated(long, table, "score", ["model"], "r_")
    arrays = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "r_"))), lambda s: s["r_"]).alias(name))
    return rows.join(arrays, key)


def long(lrs: DataFrame, names: list, name: str = "lr", of: str = "of") -> DataFrame:
    """A row for each model of each row: (of, lr) in place of the array."""
    return lrs.select("*", F.posexplode(name).alias("model_", "ratio_")).drop(name).withColumn(of, F.get(F.array(*[F.lit(n) for n in names]), F.col("model_"))).withColumnRenamed("ratio_", name).drop("model_")
