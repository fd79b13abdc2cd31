"""Rank statistics where columns don't vary."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import TABLES, plain

from chronolens.functions import exprs as X
from chronolens.operators import ranks
from chronolens.plans import registry

SF = "/root/testdata/sf0.01"


def test_correlations_of_columns_that_do_not_vary(spark):
    rows = [("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 4.0, 8.0), ("line", None, 3.0), ("flat", 0.1, 1.0), ("flat", 0.1, 2.0), ("flat", 0.1, 3.0), ("one", 1.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(3)
    got = {r.k: r.r for r in df.groupBy("k").agg(X.corr("a", "b").alias("r")).collect()}
    assert got["line"] == pytest.approx(1) and math.isnan(got["flat"]) and math.isnan(got["one"]) and got["none"] is None
    matrix = {r.k: r.rho for r in ranks.spearman_matrix(df, ["a", "b"], ["k"]).select("k", F.col("rho")).collect()}
    assert matrix["line"] == pytest.approx(1) and math.isnan(matrix["flat"])


def test_row_nulls_of_values_that_differ_when_computed_again(spark):
    """As sums of doubles do in their last bits, whenever their terms arrive in another order."""
    noise = F.udf(lambda v: v + 1e-9 * random.SystemRandom().random(), "double").asNondeterministic()
    df = spark.range(40).select((F.col("id") % 20).alias("day"), noise(F.col("id").cast("double")).alias("v"))
    rho, null = ranks.row_grain_null(df, "day", "v", 20)
    exact, same = ranks.row_grain_null(spark.range(40).select((F.col("id") % 20).alias("day"), F.col("id").alias("v")), "day", "v", 20)
    assert rho == pytest.approx(exact) and null == pytest.approx(same)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_trends_of_a_score_with_equal_medians(spark):
    """On this table the medians of a score are all equal."""
    registry.load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES["q_trend_tests"](spark, SF)
    cur = con.execute(registry.ORACLE["q_trend_tests"])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert 0 < len(want) < 5 and sorted(tuple(plain(v) for v in r) for r in df.collect()) == want
