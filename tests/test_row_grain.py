"""Nulls at the grain of rows: values that many rows have are dealt out by count, and each range is a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import ranks


def most_tasks(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
    most = {}
    while stages.hasNext():
        s = stages.next()
        most[s.stageId()] = s.numTasks()
    return most


def test_dealt_out_is_a_multivariate_hypergeometric_draw():
    rng, groups = np.random.default_rng(0), np.array([5, 0, 7, 3])
    got = ranks.dealt_out(rng, np.tile(groups, (100_000, 1)), 6)
    assert (got.sum(1) == 6).all() and (got >= 0).all() and (got <= groups).all()
    want = rng.multivariate_hypergeometric(groups, 6, size=100_000, method="marginals")
    assert got.mean(0) == pytest.approx(want.mean(0), abs=0.02) and np.cov(got.T) == pytest.approx(np.cov(want.T), abs=0.03)
    assert (ranks.dealt_out(rng, np.tile(groups, (2, 1)), 15) == groups).all() and not ranks.dealt_out(rng, np.tile(groups, (2, 1)) * 0, 0).any()


@pytest.mark.parametrize("many", [20, 1000])
def test_ties_by_count_have_the_same_null(spark, many):
    """Some values have most of the rows, as a count of lines has; others come up once."""
    rng = np.random.default_rng(3)
    day, value = rng.integers(0, 5, 900), np.where(rng.random(900) < 0.7, rng.integers(0, 4, 900) * 1.0, rng.random(900) * 4)
    df = spark.createDataFrame(list(zip(day.tolist(), value.tolist(), strict=True)), "d int, v double")
    rx, ry = ([(np.searchsorted(np.sort(x), x, "left") + np.searchsorted(np.sort(x), x, "right") + 1) / 2 for x in (day, value)])
    brute = np.array([np.corrcoef(rx, rng.permutation(ry))[0, 1] for _ in range(3000)])
    rho, null = ranks.row_grain_null(df, "d", "v", 3000, range_rows=200, many_rows=many)
    assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert abs(null.mean()) < 0.004 and null.std() == pytest.approx(brute.std(), rel=0.06)
    assert np.quantile(null, [0.05, 0.5, 0.95]) == pytest.approx(np.quantile(brute, [0.05, 0.5, 0.95]), abs=0.01)


def test_each_range_is_a_task(spark):
    """Ranges are small, and Spark put all of them into a few tasks by their size before."""
    df = spark.range(900).select((F.col("id") % 9).cast("int").alias("d"), F.col("id").cast("double").alias("v")).localCheckpoint()
    before = most_tasks(spark)
    ranks.row_grain_null(df, "d", "v", 50, range_rows=30)
    assert max(n for s, n in most_tasks(spark).items() if s not in before) == 30
