"""Mixtures: planted components are found, one component is the closed form, divergence tells cells apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import mixture


def test_planted_components_and_divergence(spark):
    rng = np.random.default_rng(1)
    one, two, few = rng.normal(size=(60, 2)), np.concatenate([rng.normal(-4, 0.5, size=(40, 2)), rng.normal(4, 0.5, size=(40, 2))]), rng.normal(size=(3, 2))
    rows = [(m, [float(v) for v in r]) for m, x in (("one", one), ("two", two), ("few", few)) for r in x]
    df = spark.createDataFrame(rows, "model string, x array<double>")
    got = {r.model: r for r in mixture.fit(df, most=3, steps=8).collect()}
    assert (got["one"].k, got["two"].k, got["few"].k) == (1, 2, 1)
    (c,) = got["one"].components
    assert c.mean == pytest.approx(list(one.mean(0))) and c["var"] == pytest.approx(list(one.var(0) + mixture.RIDGE))
    assert sorted(round(c.mean[0]) for c in got["two"].components) == [-4, 4]
    cells = [(i, "f", "a" if i % 3 == 0 else "b" if i % 3 == 1 else "c", [float(v) for v in rng.normal(3.0 * (i % 3 == 2), 1, size=2)]) for i in range(180)]
    d = mixture.divergence(spark.createDataFrame(cells, "id int, family string, cell string, x array<double>"), "id", "cell", ["family"])
    found = {(r.cell_a, r.cell_b): r.divergence for r in d.collect()}
    assert abs(found["a", "b"]) < 0.6 < found["a", "c"] and found["b", "c"] > 0.6
    assert d.where(F.col("divergence").isNull()).count() == 0


def test_rows_of_one_model_are_dealt_to_many_tasks(spark, monkeypatch):
    """One model's rows were all in one task of each step before; the fit is that of plain expectation-maximisation."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-2, 1, size=(150, 2)), rng.normal(2, 1, size=(250, 2))])
    rows = [("m", [float(v) for v in r]) for r in x] + [("m", [float("nan"), 0.0]), ("m", None), (None, [0.0, 0.0])]
    most, real = [], mixture._pass
    monkeypatch.setattr(mixture, "_pass", lambda data, *a, **k: most.append(max(data.groupBy(F.spark_partition_id()).count().toPandas()["count"])) or real(data, *a, **k))
    (got,) = mixture.fit(spark.createDataFrame(rows, "model string, x array<double>").coalesce(1), most=2, steps=5).collect()
    assert got.n == 400 and got.k == 2 and len(most) == 7 and max(most) < 200
    share = (np.lexsort(x.T[::-1]).argsort() * 2 // 400)[:, None] == np.arange(2)
    for step in range(6):
        n = share.sum(0)
        mean = share.T @ x / n[:, None]
        var = share.T @ (x * x) / n[:, None] - mean**2 + mixture.RIDGE
        joint = np.column_stack([np.log(n[c] / 400) - 0.5 * (np.log(2 * np.pi * var[c]) + (x - mean[c]) ** 2 / var[c]).sum(1) for c in range(2)])
        total = np.logaddexp.reduce(joint, 1)
        share = np.exp(joint - total[:, None])
    assert [c["mean"] for c in got.components] == [pytest.approx(list(m)) for m in mean] and [c["var"] for c in got.components] == [pytest.approx(list(v)) for v in var]
    assert got.bic == pytest.approx(-2 * total.sum() + 9 * np.log(400))
