"""Held-out tests with mixtures, least squares for many keys, nulls at the grain of rows, neighbours on prefixes: brute force and planted effects."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import attribution, ranks, regress, vectors


def frame(spark, rows):
    return spark.createDataFrame([(g, [float(v) for v in x]) for g, x in rows], "generator int, x array<double>").repartition(3)


def months(n, start=2018):
    return [datetime.date(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def normal_mixture(x, k, steps=20, ridge=1e-3, tol=1e-4):
    """Expectation-maximisation of one set, alone: mean log likelihood of any rows under it, and its criterion."""
    mu, var = x.mean(0), x.var(0) + ridge
    j = int(var.argmax())
    z = np.array([attribution._normal_quantile(np.array([(c + 0.5) / k]))[0] for c in range(k)])
    mean, var, w = np.tile(mu, (k, 1)), np.tile(var, (k, 1)), np.full(k, 1 / k)
    mean[:, j] += np.sqrt(var[0, j]) * z

    def density(rows):
        each = np.array([np.log(w[c]) - 0.5 * (np.log(2 * np.pi * var[c]) + (rows - mean[c]) ** 2 / var[c]).sum(1) for c in range(k)])
        return np.logaddexp.reduce(each, 0), each

    before = -np.inf
    for step in range(steps + 1):
        total, each = density(x)
        if step == steps or k == 1 or total.sum() - before <= tol * len(x):
            break
        before = total.sum()
        r = np.exp(each - total)
        n = r.sum(1)
        w, mean = n / len(x), (r @ x) / n[:, None]
        var = np.maximum((r @ (x * x)) / n[:, None] - mean**2, 0) + ridge
    return lambda rows: density(rows)[0].mean(), -2 * total.sum() + (k * (2 * x.shape[1] + 1) - 1) * np.log(len(x))


def test_likelihoods_are_those_of_each_set_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(g, rng.normal([3 * (i % 2) * (g % 2), 0], [1, 0.5])) for g in range(5) for i in range(12 + 7 * g)]
    df = frame(spark, rows).unionByName(spark.createDataFrame([(0, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (77, [0.0, 0.0])], "generator int, x array<double>"))
    sets = attribution.Sets()
    asked = [{0, 1}, {1, 3}, {2}, {0, 1, 2, 3, 4}, {5}]
    assert [sets.of(a) for a in asked] == list(range(5)) and sets.of({1, 0}) == 0
    shifts = np.zeros((2, 6, 2))
    shifts[1, 1], shifts[1, 3] = [0.5, -1], [2, 0]
    got = attribution.likelihoods(df, [0, 1, 2, 3, 4, 5], sets, shifts=shifts)
    of = {g: np.array([x for h, x in rows if h == g]) for g in range(5)}
    assert np.isnan(got[:, 4]).all() and np.isnan(got[:, :, 5]).all()
    for v in range(2):
        for k, a in enumerate(asked[:4]):
            x = np.concatenate([of[g] + shifts[v, g] for g in sorted(a)])
            best = min((normal_mixture(x, c) for c in range(1, max(1, min(4, len(x) // 5)) + 1)), key=lambda m: m[1])[0]
            assert got[v, k, :5] == pytest.approx([best(of[g] + shifts[v, g]) for g in range(5)], rel=1e-4, abs=1e-4)


def test_a_change_of_shape_is_found_that_one_normal_misses(spark):
    rng = np.random.default_rng(4)
    shape = lambda late: rng.normal([2 * rng.choice([-1, 1]), 0], 1) if late else rng.normal([0, 0], [5**0.5, 1])
    df = frame(spark, [(g, shape(g >= 6)) for g in range(12) for _ in range(60)])
    registry = {"f": list(zip(range(12), months(12), strict=True)), "tiny": [(50, months(1)[0])]}
    many, few = attribution.time_test(df, registry, n_bins=2, perms=99, most=4), attribution.time_test(df, registry, n_bins=2, perms=99, most=1)
    by = lambda rows: {r["family"]: r for r in rows}
    assert by(many)["f"]["p_llr"] <= 0.02 and by(few)["f"]["p_llr"] > 0.1 and by(many)["f"]["perms"] == 99
    assert "1 are there" in by(many)["tiny"]["not_testable"] and "acc" not in by(many)["tiny"]


def test_planted_drift_grows_with_its_strength(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, [(g, rng.normal(size=3)) for g in range(12) for _ in range(25)])
    registry = {"f": list(zip(range(12), months(12), strict=True))}
    shifts, variants = attribution.planted_shifts(df, registry, [0.0, 6.0], 2)
    assert variants == [(0.0, 0), (6.0, 0), (0.0, 1), (6.0, 1)] and not shifts[0].any()
    assert np.linalg.norm(shifts[1][-1]) == pytest.approx(6, rel=0.15) and not shifts[1][0].any()
    found = {r["variant"]: r for r in attribution.time_test(df, registry, n_bins=3, perms=49, shifts=shifts)}
    assert found[1]["p_llr"] <= 0.04 and found[3]["p_llr"] <= 0.04 and found[1]["llr"] > found[0]["llr"]


def test_lineages_are_told_and_the_null_is_full(spark):
    rng = np.random.default_rng(13)
    df = frame(spark, [(g, rng.normal(size=2) + [6 * (g % 2), 0]) for g in range(8) for _ in range(30)])
    members = [(g, m, "ab"[g % 2] if g < 7 else None) for g, m in enumerate(months(8))]
    few = [(20, months(1)[0], "a"), (21, months(2)[1], "b")]
    found = {r["family"]: r for r in attribution.lineage_test(df, {"f": members, "few": few}, perms=120)}
    r = found["f"]
    assert (r["n_classes"], r["n_generators"], r["acc"], r["perms"]) == (2, 7, 1.0, 120) and r["p_llr"] < 0.1 and r["null_acc"] < 0.8
    assert found["few"]["not_testable"]
    crowded = [(0, months(1)[0], "a"), (1, months(2)[1], "a"), (2, months(3)[2], "b"), (3, months(4)[3], "b"), *[(g, months(1)[0], "a") for g in (4, 5, 6)]]
    assert attribution.lineage_test(df, {"c": crowded}, perms=50)[0]["perms"] == 50  # few orders are valid; they are drawn until there are enough


def test_regressions_of_thousands_of_keys_are_numpys(spark):
    rng = np.random.default_rng(8)
    names = [f"x{i}" for i in range(7)]
    rows = []
    for k in range(2500):
        for _ in range(int(rng.integers(9, 14))):
            x = rng.normal(size=7) * [1, 10, 0.1, 1, 1, 1, 1]
            rows.append((k, *[float(v) for v in x], float(x @ np.arange(7) + k + rng.normal()), float(rng.normal())))
    rows += [(9000, *[1.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0], 3.0, 1.0), (9001, None, *[0.0] * 6, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(["k int", *[f"{c} double" for c in names], "y double, z double"]))
    got = {(r.k, r.target): r for r in regress.fit(df, ["k"], ["y", "z"], names).collect()}
    assert len(got) == 2 * 2501 and got[9000, "y"].rank == 1 and (9001, "y") not in got
    data = np.array([r for r in rows if r[0] < 2500])
    for k in range(0, 2500, 97):
        own = data[data[:, 0] == k]
        x = np.column_stack([np.ones(len(own)), own[:, 1:8]])
        for j, t in ((8, "y"), (9, "z")):
            beta, *_ = np.linalg.lstsq(x, own[:, j], rcond=None)
            r = got[k, t]
            assert [r.intercept, *[r[f"b_{c}"] for c in names]] == pytest.approx(beta.tolist(), rel=1e-5, abs=1e-6) and r.rank == 8
            assert r.rss == pytest.approx(((own[:, j] - x @ beta) ** 2).sum(), rel=1e-5, abs=1e-7)
    assert regress.fit(df.where("false"), ["k"], ["y"], names).count() == 0


def test_a_null_over_rows_is_that_of_exploding_them(spark):
    rng = np.random.default_rng(6)
    rows = [(int(d), float(np.round(rng.normal() + 0.1 * d, 1))) for d in rng.integers(0, 5, 400)] + [(1, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "d int, v double")
    x, y = np.array([r for r in rows if None not in r]).T
    rank = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    rx, ry = rank(x), rank(y)
    for size in (10_000, 37):  # in one range and in many
        rho, null = ranks.row_grain_null(df, "d", "v", 3000, range_rows=size)
        brute = np.array([np.corrcoef(rx, rng.permutation(ry))[0, 1] for _ in range(3000)])
        assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])
        assert abs(null.mean()) < 0.004 and null.std() == pytest.approx(brute.std(), rel=0.06)
        assert np.quantile(null, [0.05, 0.5, 0.95]) == pytest.approx(np.quantile(brute, [0.05, 0.5, 0.95]), abs=0.01)
    assert np.isnan(ranks.row_grain_null(df.withColumn("v", F.lit(1.0)), "d", "v", 5)[0]) and np.isnan(ranks.row_grain_null(df.where("false"), "d", "v", 5)[0])


def test_neighbours_on_prefixes_are_those_of_single_runs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, s int, x array<double>")
    many = vectors.neighbours(df, "id", "x", 4, ["s"], block_rows=30, prefixes=[3, 1, 6])
    for g in (1, 3, 6):
        alone = vectors.neighbours(df.withColumn("x", F.slice("x", 1, g)), "id", "x", 4, ["s"]).select("id", "rank", "other")
        assert sorted(map(tuple, many.where(F.col("g") == g).select("id", "rank", "other").collect())) == sorted(map(tuple, alone.collect()))
    assert vectors.neighbours(df, "id", "x", 4).columns == ["id", "rank", "other", "d2"]


def test_twenty_specifications_at_once_are_twenty_alone(spark):
    from chronolens.operators import specs

    rng = np.random.default_rng(9)
    rows = [(g, g % 2, int(rng.integers(0, 3)), [float(v) for v in rng.normal(size=8) * np.arange(1, 9) + [0.4 * g, 0, 0, 0, 0, 0, 0, 0]]) for g in range(12) for _ in range(20)]
    df = spark.createDataFrame(rows, "generator int, family int, origin int, x array<double>").repartition(3)
    registry = {f: [(g, m) for g, m in enumerate(months(12)) if g % 2 == f] for f in (0, 1)}
    some = [specs.Spec(f"{b} {s} {c} {g}", b, s, c, g, n) for (b, n), s, c, g in [(x, s, c, g) for x in (((0, 8), 2), ((2, 6), 3)) for s in ("robust", "standard", "none") for c in ((), ("origin",), ("family", "origin")) for g in (2,)]]
    some += [specs.Spec("rows", (0, 8), rows="origin <> 1"), specs.Spec("wide", (0, 8), g=20)]
    assert len(some) == 20
    many = specs.time_tests(df, registry, some, perms=9)
    assert len(many) == 40
    for s in some[::3] + some[-2:]:
        alone = specs.time_tests(df, registry, [s], perms=9)
        for r in alone:
            (same,) = [m for m in many if m["spec"] == s.name and m["family"] == r["family"]]
            assert {k: v for k, v in same.items() if k != "variant"} == pytest.approx({k: v for k, v in r.items() if k != "variant"}, abs=2e-4, nan_ok=True)
    mean, axes = specs.maps(df, [some[0]])[0]
    x = np.array([r[3] for r in rows])
    iqr = np.subtract(*np.percentile(x, [75, 25], axis=0))
    scaled = (x - x.mean(0)) / iqr
    _, _, v = np.linalg.svd(scaled, full_matrices=False)
    assert np.allclose(np.abs((x - mean) @ axes), np.abs(scaled @ v[:2].T), atol=1e-6)


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch):
    """With many variants a row is much work, and a table of one row group was one task in each step before."""
    rng = np.random.default_rng(4)
    df = frame(spark, [(g, rng.normal(g, 1, size=2)) for g in range(3) for _ in range(400)]).coalesce(1)
    most, real = [], attribution._pass
    monkeypatch.setattr(attribution, "_pass", lambda data, *a: most.append(max(data.groupBy(F.spark_partition_id()).count().toPandas()["count"])) or real(data, *a))
    sets = attribution.Sets()
    sets.of({0, 1})
    got = attribution.likelihoods(df, [0, 1, 2], sets, shifts=np.zeros((50, 3, 2)), most=1)
    assert np.isfinite(got).all() and np.ptp(got, axis=0).max() < 1e-9 and most and max(most) <= 400
