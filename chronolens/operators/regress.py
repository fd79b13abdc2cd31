"""Least squares for many keys at once: normal equations by aggregation, solved in the tasks.

The sums of products of all regressors and targets of a key are one aggregation, added up before the shuffle, so a key with a third
of all rows is as cheap as any other. Keys' small systems are then solved in batches in the tasks that hold them; nothing of a key
reaches the driver.

Edge cases: rows with a null in a regressor or target are left out. Regressors that depend on one another get the solution of least
norm (their rank is returned). A key without rows has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(df: DataFrame, by: list[str], targets: list[str], regressors: list[str]) -> DataFrame:
    """(by, n, xx: upper half of the products of (1, regressors) in rows, xy: targets x (1, regressors), yy: the targets' squares)."""
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in regressors]]
    y = [F.col(f"`{c}`").cast("double") for c in targets]
    rows = df.dropna(subset=[*targets, *regressors])
    xx = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    xy, yy = [F.sum(t * v) for t in y for v in x], [F.sum(t * t) for t in y]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.array(*yy).alias("yy"))


def solve(sums: DataFrame, by: list[str], targets: list[str], regressors: list[str], rows: int = 2048) -> DataFrame:
    """(by, n, rank, target, intercept, b_<regressor>..., rss, r2): a row for each key and target."""
    kinds, p = dict(sums.dtypes), len(regressors) + 1
    names = [*by, "n", "rank", "target", "intercept", *[f"b_{c}" for c in regressors], "rss", "r2"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, rank int, target string", *[f"`{c}` double" for c in names[len(by) + 3 :]]])
    i, j = np.triu_indices(p)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                m = b.num_rows
                half, xy, yy = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(m, -1) for c in ("xx", "xy", "yy"))
                xx = np.zeros((m, p, p))
                xx[:, i, j] = xx[:, j, i] = half
                xy = xy.reshape(m, len(targets), p)
                scale = np.sqrt(np.maximum(np.einsum("kii->ki", xx), 1e-300))  # regressors of any size weigh alike in the choice of rank
                values, axes = np.linalg.eigh(xx / scale[:, :, None] / scale[:, None])
                good = values > 1e-11 * values[:, -1:]
                inverse = (axes * np.where(good, 1 / np.where(good, values, 1), 0)[:, None]) @ axes.transpose(0, 2, 1)
                beta = np.einsum("kij,ktj->kti", inverse, xy / scale[:, None]) / scale[:, None]
                n = b.column("n").to_numpy(zero_copy_only=False)
                rss = np.maximum(yy - np.einsum("kti,kti->kt", beta, xy), 0)
                tss = yy - xy[:, :, 0] ** 2 / n[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    r2 = np.where(tss > 0, 1 - rss / tss, np.nan)
                t = len(targets)
                keys = [b.column(c).take(pa.array(np.repeat(np.arange(m), t))) for c in by]
                columns = [*keys, pa.array(np.repeat(n, t)), pa.array(np.repeat(good.sum(1), t).astype("int32")), pa.array(targets * m), *[pa.array(beta[:, :, c].ravel()) for c in range(p)], pa.array(rss.ravel()), pa.array(r2.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return sums.select(*by, "n", "xx", "xy", "yy").mapInArrow(each, schema)


def fit(df: DataFrame, by: list[str], targets: list[str], regressors: list[str]) -> DataFrame:
    return solve(normal_equations(df, by, targets, regressors), by, targets, regressors)


def fitted(row: str, regressors: list[str]) -> Column:
    """The prediction of a row joined with its key's struct of coefficients `row`."""
    return sum((F.col(f"{row}.b_{c}") * F.col(f"`{c}`") for c in regressors), F.col(f"{row}.intercept"))
