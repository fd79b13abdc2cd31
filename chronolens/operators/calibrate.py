"""Calibration of scores to likelihood ratios, fusion of scores, and their cost.

Class weights are one half each, so a calibrated probability p gives the ratio p / (1 - p). Fits aggregate first:
isotonic regression sees distinct scores with summed weights, and ridge fusion sees one set of weighted sums
for each model and Newton step, all models in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import inverse, odds
from .lineage import written


def balanced(df: DataFrame, y: str, by: list[str], name: str = "w") -> DataFrame:
    """Weights that give each class one half within `by`."""
    n = df.groupBy(*by, y).agg(F.count("*").alias("n_class"))
    on = [*by, y]
    return df.join(F.broadcast(n), on).withColumn(name, 0.5 / F.col("n_class")).drop("n_class")


def pav(df: DataFrame, score: str, y: str) -> IsotonicRegressionModel:
    """The calibrator of one model: weighted pool-adjacent-violators on distinct scores."""
    w = balanced(df.select(score, y), y, []).groupBy(score).agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("p"))
    return IsotonicRegression(featuresCol=score, labelCol="p", weightCol="w", predictionCol="calibrated").fit(w.withColumn(score, F.col(score).cast("double")))


def pav_lr(model: IsotonicRegressionModel, df: DataFrame, score: str, name: str = "lr") -> DataFrame:
    """`df` with the likelihood ratio of its score; scores outside the fitted range take the end's."""
    return model.setFeaturesCol(score).transform(df.withColumn(score, F.col(score).cast("double"))).withColumn(name, odds(F.round("calibrated", 12))).drop("calibrated")


def _pooled(rows: np.ndarray) -> np.ndarray:
    """Rows (lowest score, highest score, weight, weight of class 1) in order of score, pooled until their shares of class 1 increase.

    Neighbours whose shares fall end up in one block whatever is pooled first, so whole falling runs are pooled at once while that
    makes the table much shorter; what is left goes one by one."""
    while len(rows) > 100:
        w, w1 = rows[:, 2], rows[:, 3]
        first = np.flatnonzero(np.append(True, ~(w1[:-1] * w[1:] >= w1[1:] * w[:-1])))
        if len(first) > 0.9 * len(rows):
            break
        last = np.append(first[1:], len(rows)) - 1
        rows = np.column_stack([rows[first, 0], rows[last, 1], np.add.reduceat(w, first), np.add.reduceat(w1, first)])
    held: list[tuple] = []
    for lo, hi, w, w1 in rows.tolist():
        while held and held[-1][3] * w >= w1 * held[-1][2]:
            lo, _, v, v1 = held.pop()
            w, w1 = v + w, v1 + w1
        held.append((lo, hi, w, w1))
    return np.array(held).reshape(-1, 4)


BLOCK = ["lo", "hi", "w", "w1"]


def pav_table(df: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, lo, hi, w, w1): the blocks of weighted pool-adjacent-violators of each model, classes weighing one half each."""
    one = F.col(y) == 1
    hist = balanced(df.select(*by, F.col(score).cast("double").alias("lo"), F.col(y).alias(y)), y, by).groupBy(*by, "lo").agg(F.sum("w").alias("w"), F.sum(F.when(one, F.col("w")).otherwise(0.0)).alias("w1"))
    return pooled(hist, by)


def pooled(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, w, w1): the blocks of each model from (by, lo, w, w1), a row for each distinct score.

    Scores are dealt out by range and pooled where they lie, then the blocks of the ranges are pooled: pooling in parts
    gives the blocks of pooling at once. What one task pools of a model at the end are blocks, not scores."""
    kinds = dict(hist.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"{c} double" for c in BLOCK]])
    hist = hist.select(*by, "lo", F.col("lo").alias("hi"), "w", "w1").repartitionByRange(*by, "lo").sortWithinPartitions(*by, "lo")

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, rows in b.groupby(by, sort=False, dropna=False) if by else [((), b)]:
                yield pd.DataFrame(_pooled(rows[BLOCK].to_numpy()), columns=BLOCK).assign(**dict(zip(by, key, strict=True)))[[*by, *BLOCK]]

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        return pd.DataFrame(_pooled(rows[BLOCK].to_numpy()), columns=BLOCK).assign(**{c: rows[c].iloc[0] for c in by})[[*by, *BLOCK]]

    return hist.mapInPandas(here, schema).groupBy(*by).applyInPandas(whole, schema)


def pav_ratios(df: DataFrame, table: DataFrame, score: str, by: list[str], name: str = "lr", most: int = 500_000) -> DataFrame:
    """`df` with the likelihood ratio of its score under its model's blocks: linear between blocks, and the end's outside.

    The table of blocks goes to the tasks up to `most` rows; beyond, scores and blocks meet in a join by range."""
    if table.limit(most + 1).count() > most:
        return interpolated(df, table, score, by, name)
    models: dict = {}
    for r in table.orderBy(*by, "lo").collect():
        xs, ps = models.setdefault(tuple(r[c] for c in by), ([], []))
        xs += [r.lo, r.hi]
        ps += [r.w1 / r.w] * 2
    sent = df.sparkSession.sparkContext.broadcast({k or (0,): (np.array(x), np.array(p)) for k, (x, p) in models.items()})

    @F.pandas_udf("double")
    def calibrated(model: pd.DataFrame, x: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        for key, rows in model.groupby(list(model.columns), sort=False).groups.items():
            knots = sent.value.get(key if isinstance(key, tuple) else (key,))
            if knots is not None:
                out[rows] = np.interp(x[rows].astype(float), *knots)
        return out

    keys = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all_"))
    return df.withColumn(name, odds(F.round(calibrated(keys, F.col(score).cast("double")), 12)))


def interpolated(df: DataFrame, table: DataFrame, score: str, by: list[str], name: str = "lr") -> DataFrame:
    """The same ratios for blocks of any number: the distinct scores and the ends of the blocks are dealt out by range together, and
    each score takes the nearest ends on either side, in its range or, through a table with a row for each key and range, beyond it."""
    at, p = F.col(score).cast("double").alias("at"), F.col("w1") / F.col("w")
    ends = table.select(*by, F.inline(F.array(*[F.struct(F.col(c).alias("at"), p.alias("p")) for c in ("lo", "hi")]))).distinct()
    both = df.select(*by, at).where(F.col(score).isNotNull()).distinct().withColumn("p", F.lit(None).cast("double")).unionByName(ends)
    both = written(both.repartitionByRange(*by, "at").withColumn("range", F.spark_partition_id()), "knots")
    end = F.when(F.col("p").isNotNull(), F.struct("at", "p"))
    w = Window.partitionBy("range", *by).orderBy("at")
    below, above = F.last(end, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(end, True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.select(*by, "at", "p", "range", below.alias("below"), above.alias("above"))
    ranges = both.groupBy(*by, "range").agg(F.max(end).alias("last"), F.min(end).alias("first"))
    r = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range")  # a row for each key and range
    ranges = ranges.select(*by, "range", F.last("last", True).over(r.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(r.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    a, b = F.coalesce("below", "before", "above", "after"), F.coalesce("above", "after", "below", "before")
    share = F.when(a["at"] == b["at"], a["p"]).otherwise(a["p"] + (b["p"] - a["p"]) / F.nullif(b["at"] - a["at"], F.lit(0.0)) * (F.col("at") - a["at"]))
    shares = found.where("p IS NULL").join(ranges, [*by, "range"]).select(*by, F.col("at").alias("at_"), odds(F.round(share, 12)).alias(name))
    return df.withColumn("at_", at).join(shares, [*by, "at_"], "left").drop("at_")


def block_cost(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, cllr_min): the cost after the best monotone recalibration, from the blocks of the ratios themselves."""
    one, zero = F.col("w1"), F.col("w") - F.col("w1")
    term = lambda x, other: F.when(x > 1e-12, x * F.log2(1 + F.greatest(F.lit(0.0), other) / x)).otherwise(0.0)
    cost = term(one, zero) + term(zero, one)
    return table.groupBy(*by).agg(F.sum(cost).alias("cllr_min"))


def decomposition(df: DataFrame, lr: str, y: str, by: list[str]) -> DataFrame:
    """(by, cllr, n_p, n_d, cllr_min, cllr_cal): the cost, what is left of it after recalibration, and the rest."""
    least = block_cost(pav_table(df, lr, y, by), by)
    both = cllr(df, lr, y, by)
    both = both.join(least, by) if by else both.join(least)
    return both.withColumn("cllr_cal", F.col("cllr") - F.col("cllr_min"))


def logistic(df: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, intercept, b_<score>): the logistic calibrator of each model, without a penalty; its ratio is exp of the linear score."""
    kinds = dict(df.dtypes)
    beta = fuse(df.withColumn("l2_", F.lit(0.0)), by, [score], y, "l2_")
    return coefficients(df.sparkSession, beta, by, [score], [kinds[c] for c in by])


def permuted_cost(df: DataFrame, lr: str, y: str, by: list[str], perms: int, seed: int = 0) -> DataFrame:
    """(by, perm, cllr_min) with the labels dealt anew, for each permutation: from the counts of distinct ratios, as the number
    of each that gets label 1 is a draw without replacement. A permutation of a model is a group of its own."""
    kinds = dict(df.dtypes)
    hist = df.groupBy(*by, F.col(lr).cast("double").alias("lo")).agg(F.count("*").alias("n"), F.sum((F.col(y) == 1).cast("long")).alias("p"))
    many = hist.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))

    def cost(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        n, n_p = rows["n"].to_numpy(), int(rows["p"].sum())
        words = [seed, int(rows["perm"].iloc[0]), *"|".join(str(rows[c].iloc[0]) for c in by).encode()]
        p = np.random.default_rng(words).multivariate_hypergeometric(n, n_p, method="marginals")
        w1, w0 = 0.5 * p / max(1, n_p), 0.5 * (n - p) / max(1, n.sum() - n_p)
        blocks = _pooled(np.column_stack([rows["lo"], rows["lo"], w1 + w0, w1]))
        a, b = blocks[:, 3], blocks[:, 2] - blocks[:, 3]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(a > 0, a * np.log2(1 + b / a), 0).sum() + np.where(b > 1e-15, b * np.log2(1 + a / b), 0).sum()
        return pd.DataFrame([[*[rows[c].iloc[0] for c in by], int(rows["perm"].iloc[0]), float(least)]], columns=[*by, "perm", "cllr_min"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "perm int, cllr_min double"])
    return many.groupBy(*by, "perm").applyInPandas(cost, schema)


def cllr_terms(lr: Column, y: Column) -> list[Column]:
    """Mean penalty of label 1 and of label 0, in bits."""
    return [F.avg(F.when(y == 1, F.log2(1 + inverse(lr)))), F.avg(F.when(y == 0, F.log2(1 + lr)))]


def cllr(df: DataFrame, lr: str, y: str, by: list[str]) -> DataFrame:
    p, d = cllr_terms(F.col(lr), F.col(y))
    return df.groupBy(*by).agg((0.5 * (p + d)).alias("cllr"), F.count_if(F.col(y) == 1).alias("n_p"), F.count_if(F.col(y) == 0).alias("n_d"))


def cllr_min(df: DataFrame, lr: str, y: str) -> float:
    """Cost after the best monotone recalibration; depends on the order of the ratios alone."""
    ranked = df.select(y, F.col(lr).alias("order"))
    finite = ranked.withColumn("order", F.when(F.col("order") == float("inf"), 1e300).otherwise(F.col("order")))
    fit = pav_lr(pav(finite, "order", y), finite, "order", "best")
    return cllr(fit, "best", y, []).first()["cllr"]


def rates_misleading(df: DataFrame, lr: str, y: str, by: list[str], thresholds: tuple = (1.0, 4.0, 10.0)) -> DataFrame:
    one, zero = F.col(y) == 1, F.col(y) == 0
    high = [F.avg(F.when(zero, (F.col(lr) >= t).cast("int"))).alias(f"rme_d_{t:g}") for t in thresholds]
    return df.groupBy(*by).agg(F.count_if(one).alias("n_p"), F.count_distinct(lr).alias("distinct_lr"), *high, F.avg(F.when(one, (F.col(lr) <= 1).cast("int"))).alias("rme_p"))


def fuse(df: DataFrame, keys: list[str], features: list[str], y: str, l2: str, steps: int = 25, tol: float = 1e-9) -> dict[tuple, np.ndarray]:
    """Ridge logistic regression for each key, class-balanced: {key: [intercept, weights...]}.

    Minimises sum w loss + l2 / 2 |weights| ** 2 with weights w summing to the rows of the key. A Newton step is one
    aggregation; what reaches the driver is a row of sums for each model."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("size"))
    data = balanced(df, y, keys).join(F.broadcast(sizes), keys).withColumn("w", F.col("w") * F.col("size")).select(*keys, F.col(y).cast("double").alias("_y"), F.col("w").alias("_w"), F.col(l2).cast("double").alias("_l2"), *[F.col(c).cast("double").alias(c) for c in features]).persist()
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    m = len(x)
    spark, beta = df.sparkSession, {tuple(r[k] for k in keys): np.zeros(m) for r in data.select(*keys).distinct().collect()}
    for _ in range(steps):
        table = spark.createDataFrame([(*k, *map(float, b)) for k, b in beta.items()], _with(data.select(*keys).schema, m))
        z = sum((F.col(f"b{i}") * x[i] for i in range(1, m)), F.col("b0"))
        p = 1 / (1 + F.exp(-z))
        g = [F.sum(F.col("_w") * (F.col("_y") - p) * x[i]).alias(f"g{i}") for i in range(m)]
        h = [F.sum(F.col("_w") * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(m) for j in range(i, m)]
        rows = data.join(F.broadcast(table), keys).groupBy(*keys).agg(F.first("_l2").alias("_l2"), *g, *h).collect()
        change = 0.0
        for r in rows:
            k = tuple(r[c] for c in keys)
            hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
            ridge = np.diag([0.0, *[r["_l2"]] * (m - 1)])
            step = np.linalg.solve(hess + ridge + 1e-12 * np.eye(m), np.array([r[f"g{i}"] for i in range(m)]) - ridge @ beta[k])
            beta[k], change = beta[k] + step, max(change, float(np.abs(step).max()))
        if change < tol:
            break
    data.unpersist()
    return beta


def _with(schema, m: int):
    for i in range(m):
        schema = schema.add(f"b{i}", "double")
    return schema


def coefficients(spark, beta: dict[tuple, np.ndarray], keys: list[str], features: list[str], key_types: list[str]) -> DataFrame:
    """The models as a table (keys, intercept, a column for each feature)."""
    names = ", ".join([f"{k} {t}" for k, t in zip(keys, key_types, strict=True)] + ["intercept double"] + [f"b_{c} double" for c in features])
    return spark.createDataFrame([(*k, *map(float, b)) for k, b in beta.items()], names)


def fused_score(features: list[str]) -> Column:
    """The linear score of a row joined with its model."""
    return sum((F.col(f"b_{c}") * F.col(c) for c in features), F.col("intercept"))
