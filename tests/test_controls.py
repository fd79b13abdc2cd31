"""Controls: known answers, identities and edge rows of the evidence and temporal operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.functions import exprs as X
from chronolens.operators import audit, bounds, calibrate, ranks, sampling, temporal, vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, lr double, y int")


def test_shuffled_scores_have_an_error_rate_of_one_at_the_neutral_bounds(spark):
    rng = random.Random(1)
    rows = [("a", math.exp(rng.gauss(0, 1)), i % 2) for i in range(200)]
    assert bounds.nbe(frame(spark, rows), "lr", "y", ["g"], 1.0, 1.0).first()["nbe"] == pytest.approx(1.0)


def test_perfect_separation_saturates_at_the_count_bound(spark):
    rng = random.Random(2)
    rows = [("a", rng.uniform(-3, -1), 0) for _ in range(150)] + [("a", rng.uniform(1, 3), 1) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    lrs = calibrate.pav_lr(calibrate.pav(df, "score", "y"), df, "score")
    assert calibrate.cllr(lrs, "lr", "y", []).first()["cllr"] == pytest.approx(0, abs=1e-9)
    e = bounds.elub(lrs, "lr", "y", ["g"]).first()
    assert e.lower == pytest.approx(151 / (41 * 150)) and e.upper == pytest.approx(40 * 151 / 41)  # 1 / 40 and 150, less the worst case added


def test_bounds_are_fit_and_widest_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, cases = [], {}
    for k in range(12):
        p, d = (np.round(np.exp(rng.normal(m, 0.4 + k % 4, rng.integers(2, 50))), 2 if k < 8 else 6) for m in (0.3 * (k % 4), -0.3 * (k % 4)))
        if k == 5:
            p[:1], d[:1] = np.inf, 0.0
        if k == 7:
            p, d = p + 2, d + 2
        cases[f"k{k}"] = p, d
        rows += [(f"k{k}", float(v), 1) for v in p] + [(f"k{k}", float(v), 0) for v in d]

    def worst(p, d, lower, upper):
        one, zero = np.append(np.clip(p, lower, upper), lower), np.append(np.clip(d, lower, upper), upper)
        t = np.unique(np.concatenate([one, zero, [1.0]]))
        t = np.concatenate([t * (1 - 1e-12), t, t * (1 + 1e-12)])
        miss, alarm = np.array([[np.mean(one <= x), np.mean(zero > x)] for x in t]).T
        return max((miss + t * alarm) / np.minimum(1, t))

    for r in bounds.elub(frame(spark, rows), "lr", "y", ["g"]).collect():
        p, d = cases[r.g]
        assert worst(p, d, r.lower, r.upper) <= 1 + 1e-9
        assert worst(p, d, r.lower * 0.999, r.upper) > 1 and worst(p, d, r.lower, r.upper * 1.001) > 1


def test_calibrators_of_many_models_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(np.round(rng.normal(0.8 * y), 1)), int(y)) for g in ("a", "b", None) for y in rng.integers(0, 2, 120)]
    df = spark.createDataFrame([r for r in rows if r[0]], "g string, score double, y int").repartition(5)
    many = {(r.g, r.score, r.y): r.lr for r in calibrate.pav_ratios(df, calibrate.pav_table(df, "score", "y", ["g"]), "score", ["g"]).collect()}
    cost = {r.g: r for r in calibrate.decomposition(df.withColumn("lr", F.exp("score")), "lr", "y", ["g"]).collect()}
    for g in "ab":
        of = df.where(F.col("g") == g)
        for r in calibrate.pav_lr(calibrate.pav(of, "score", "y"), of, "score").collect():
            assert many[g, r.score, r.y] == pytest.approx(r.lr)
        assert cost[g].cllr_min == pytest.approx(calibrate.cllr_min(of.withColumn("lr", F.exp("score")), "lr", "y"))
    null = calibrate.permuted_cost(df.withColumn("lr", F.exp("score")), "lr", "y", ["g"], 30).collect()
    assert len(null) == 60 and all(0 <= r.cllr_min <= 1 + 1e-9 for r in null) and np.mean([r.cllr_min for r in null]) > max(c.cllr_min for c in cost.values())


def test_positions_and_running_counts_are_those_of_a_sort(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "x", "y"]), rng.choice([None, *range(30)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    place = {r.i: r.place for r in ranks.positions(df, ["g"], ["v", "i"], "place").collect()}
    for g in (None, "x", "y"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        assert [place[r[2]] for r in order] == list(range(1, len(order) + 1))
    c = ranks.running_counts(df.where("g IS NOT NULL AND v IS NOT NULL"), "v", ["g"], {"n": F.count("*")}, following="next").collect()
    for r in c:
        assert r.n_below == sum(x[0] == r.g and x[1] is not None and x[1] < r.v for x in rows)
        assert r.next == min((x[1] for x in rows if x[0] == r.g and x[1] is not None and x[1] > r.v), default=None)


def test_neighbours_are_those_of_all_pairs_in_any_blocks(spark):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[40:50] = x[0]  # ties
    df = spark.createDataFrame([(i, i % 3 if i < 58 else 9, x[i].tolist()) for i in range(60)], "k long, s int, x array<double>")
    for strata, block in ((None, 7), (["s"], 4096), (["s"], 5)):
        got = {(r.k, r["rank"]): (r.other, r.d2) for r in vectors.neighbours(df, "k", "x", 5, strata, block_rows=block).collect()}
        want = {}
        for i in range(60):
            near = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(60) if j != i and (not strata or (i % 3 if i < 58 else 9) == (j % 3 if j < 58 else 9)))
            want |= {(i, r + 1): (j, d) for r, (d, j) in enumerate(near[:5])}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_whitened_groups_show_a_planted_drift(spark):
    rng = np.random.default_rng(12)
    rows = [(f"g{g:02d}", 0, f"20{10 + g:02d}-01-01", (rng.normal(size=3) * [1, 5, 0.2] + [0, 0, 0.2 * 4 * g / 9]).tolist()) for g in range(10) for _ in range(60)]
    df = spark.createDataFrame(rows, "generator string, family int, day string, x array<double>").withColumn("release_date", F.to_date("day"))
    g = df.select("family", "generator", "release_date").distinct()
    (r,) = temporal.drift_test(temporal.whitened_group_means(df, g, ["family"]), ["family"], perms=199, boot=100).collect()
    assert r.n_groups == 10 and abs(r.delta - 4) < 0.8 and r.p < 0.05 and r.boot_q95 >= r.delta * 0.9 and r.tau < 0.3
    few = temporal.drift_test(temporal.whitened_group_means(df.where("generator < 'g03'"), g.where("generator < 'g03'"), ["family"]), ["family"]).first()
    assert few.p is None and "3 are there" in few.not_testable


def test_isotonic_ratios_keep_their_identity(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v), 0) for v in rng.normal(size=306)] + [("a", float(v), 1) for v in rng.normal(3, 1, size=137)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    r = calibrate.pav_lr(calibrate.pav(df, "score", "y"), df, "score").toPandas()
    d, p = r[r.y == 0].lr, r[r.y == 1].lr
    assert d.mean() == pytest.approx(1 - np.isinf(p).mean(), abs=1e-9)


def test_source_bound_of_one_source_is_neutral(spark):
    lower, upper = (spark.range(1).select(c).first()[0] for c in bounds.source_bound(F.lit(1)))
    assert (lower, upper) == (1.0, 1.0)


def test_odds_and_inverse_at_the_ends(spark):
    r = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(X.odds(F.col("p")).alias("o"), X.inverse(X.odds(F.col("p"))).alias("i")).collect()
    assert [x.o for x in r] == [0.0, 1.0, math.inf] and [x.i for x in r] == [math.inf, 1.0, 0.0]


def test_probit_inverts_the_normal_distribution(spark):
    from statistics import NormalDist

    p = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(X.probit(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], abs=1e-7)


def test_ranks_share_ties_and_survive_ranges(spark):
    rng = random.Random(4)
    rows = [("ab"[i % 2], float(rng.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.v): r["rank"] for r in ranks.average_ranks(df, "v", ["g"]).collect()}
    for g in "ab":
        values = sorted(v for h, v in rows if h == g)
        for v in set(values):
            at = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[g, v] == pytest.approx(sum(at) / len(at))


def test_auroc_with_ties_and_one_sided_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 1.0, 1), ("a", 2.0, 1), ("b", 1.0, 1)], "g string, s double, y int")
    got = {r.g: r.auroc for r in ranks.auroc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}


def test_allocation_sums_to_the_total_and_keeps_caps(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 4), ("d", 1)], "k string, n long")
    for total in (0, 1, 7, 15, 16, 40):
        got = {r.k: r.share for r in sampling.allocate(sizes, "k", "n", F.lit(total)).collect()}
        assert sum(got.values()) == min(total, 16) and all(got[k] <= n for k, n in (("a", 1), ("b", 10), ("c", 4), ("d", 1)))


def test_odd_strata_alternate(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 3), ("b", 5), ("c", 2)) for i in range(n)], "s string, id int")
    got = {(r.s, r.half): r["count"] for r in sampling.stratified_split(df, "s", "id").groupBy("s", "half").count().collect()}
    assert got == {("a", "train"): 2, ("a", "val"): 1, ("b", "train"): 2, ("b", "val"): 3, ("c", "train"): 1, ("c", "val"): 1}


def test_fusion_meets_the_gradient_condition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.4).astype(int)
    df = spark.createDataFrame([("m", float(a), float(b), int(c), 2.0) for (a, b), c in zip(x, y, strict=True)], "k string, a double, b double, y int, l2 double")
    beta = calibrate.fuse(df, ["k"], ["a", "b"], "y", "l2")[("m",)]
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    z = np.column_stack([np.ones(300), x])
    grad = z.T @ (w * (y - 1 / (1 + np.exp(-z @ beta)))) - 2.0 * np.array([0, *beta[1:]])
    assert np.abs(grad).max() < 1e-6


def test_release_groups_bridge_a_week(spark):
    rows = [("f", f"g{i}", d) for i, d in enumerate([0, 7, 14, 22, 22])]
    df = spark.createDataFrame(rows, "family string, generator string, d int").withColumn("release_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    assert [r.grp for r in temporal.release_groups(df, ["family"]).orderBy("generator").collect()] == [0, 0, 0, 1, 1]


def test_zero_spread_elements_scale_by_one(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [5.0, 5.0])], "k int, x array<double>")
    assert [r.x for r in vectors.scale(df).orderBy("k").collect()] == [[-1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    got = {(r.id, r["rank"]): r.other for r in vectors.neighbours(df, "id", "x", 3, block_rows=20).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3])}


def test_require_raises_with_the_offenders(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="'k': 1"):
        audit.require(audit.duplicate_keys(df, "k"), "keys repeat")
    audit.require(audit.duplicate_keys(df.distinct(), "k"), "keys repeat")
