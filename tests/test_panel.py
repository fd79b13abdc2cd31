"""Panels of models against one model at a time in numpy, ratios through a range join, blocks by content, models in force by date."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import blocks, calibrate, panel
from chronolens.plans import evidence


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        g = [None, "g1", "g2", "g3"][i % 4] if i % 3 else None
        x = rng.normal([0.0, 0.5 * (g == "g1"), 0.8 * (g in ("g2", "g3"))], 1)
        rows.append((i, int(g is not None), g, int(rng.integers(0, 3)), *[float(v) for v in np.round(x, 1)]))
    return rows, spark.createDataFrame(rows, "item long, label int, generator string, fold int, a double, b double, c double").repartition(4)


def one(rows, keep, held, l2):
    """A model by plain Newton steps, its calibrator by pooling, and its ratio of any item."""
    use = [r for r in rows if r[3] != held and (r[1] == 0 or r[2] in keep)]
    x, y = np.array([[1.0, *r[4:]] for r in use]), np.array([float(r[1]) for r in use])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, ridge = np.zeros(4), np.diag([0, l2, l2, l2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
    score = np.round(x @ beta, 9)
    at = np.unique(score)
    stack = []
    for s in at:
        now = [s, s, (w / len(y))[score == s].sum(), (w * y / len(y))[score == s].sum()]
        while stack and stack[-1][3] / stack[-1][2] >= now[3] / now[2]:
            b = stack.pop()
            now = [b[0], now[1], b[2] + now[2], b[3] + now[3]]
        stack.append(now)
    ends, share = np.array([[lo, hi] for lo, hi, *_ in stack]).ravel(), np.repeat([v / t for _, _, t, v in stack], 2)

    def ratio(r):
        p = np.interp(np.round(np.array([1.0, *r[4:]]) @ beta, 9), ends, share)
        return math.inf if p > 1 - 1e-12 else p / (1 - p)

    return beta, ratio


SPECS = [({"g1"}, -1, 1.0), ({"g2", "g3"}, -1, 0.1), ({"g1", "g2", "g3"}, -1, 5.0), ({"g1"}, 0, 1.0), ({"g1"}, 1, 1.0), ({"g1"}, 2, 1.0)]


def models(names):
    return panel.Models([[True, *[n in k for n in names]] for k, _, _ in SPECS], [h for _, h, _ in SPECS], [x for *_, x in SPECS])


@pytest.mark.parametrize(("sample", "most"), [(20_000, 500_000), (150, 0)])
def test_models_of_a_panel_are_those_of_each(spark, items, monkeypatch, sample, most):
    monkeypatch.setattr(panel, "SAMPLE", sample)
    rows, df = items
    df, names = panel.numbered(df, "label", "generator")
    assert names == ["g1", "g2", "g3"]
    m, z = models(names), ["a", "b", "c"]
    beta, n0, n1 = panel.fit(df, m, z)
    table = panel.blocks(df, m, beta, z, n0, n1)
    want = [one(rows, *s) for s in SPECS]
    assert np.allclose(beta, [b for b, _ in want], atol=1e-7)
    assert n1[0] == sum(r[2] == "g1" for r in rows) and n0[3] == sum(r[1] == 0 and r[3] != 0 for r in rows)
    got = {r.item: r.lr for r in panel.ratios(df, "item", table, beta, z, most=most).collect()}
    fold = {r.item: r.lr for r in panel.ratios(df, "item", table, beta, z, of_fold=np.array([[3, 1], [4, 1], [5, 1]]), most=most).collect()}
    assert len(got) == len(rows)
    for r in rows:  # every row under every model, whatever its source
        expected = [f(r) for _, f in want]
        assert got[r[0]] == pytest.approx(expected, rel=1e-5, abs=1e-7)
        assert fold[r[0]] == pytest.approx([expected[3 + r[3]], expected[1]], rel=1e-5, abs=1e-7)


def test_models_without_rows_and_rows_without_features(spark):
    rows = [(1, 0, None, 0, 1.0, 0.0), (2, 1, "g", 0, None, 1.0), (3, 1, "g", 0, 2.0, float("nan")), (4, 1, "h", 0, 0.5, 0.5), (5, 0, None, 0, 0.0, 0.2)]
    df, names = panel.numbered(spark.createDataFrame(rows, "item long, label int, generator string, fold int, a double, b double"), "label", "generator")
    m = panel.Models([[True, True, False], [True, False, True]])
    beta, n0, n1 = panel.fit(df, m, ["a", "b"])
    assert names == ["g", "h"] and np.isnan(beta[0]).all() and np.isfinite(beta[1]).all() and list(n1) == [0, 1]
    table = panel.blocks(df, m, beta, ["a", "b"], n0, n1)
    got = {r.item: r.lr for r in panel.ratios(df, "item", table, beta, ["a", "b"]).collect()}
    assert all(math.isnan(v[0]) for v in got.values()) and math.isnan(got[2][1]) and math.isnan(got[3][1]) and not math.isnan(got[4][1])
    assert panel.ratios(df.where("false"), "item", table, beta, ["a", "b"]).count() == 0


def test_ratios_by_range_are_those_by_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(np.round(rng.normal(), 2)), int(rng.random() < 0.5)) for g in "ab" for _ in range(700)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(5)
    table = calibrate.pav_table(df.where("s IS NOT NULL").where("abs(s) < 1.5"), "s", "y", ["g"])
    near, far = (sorted((r.g, r.s, round(r.lr, 9)) for r in calibrate.pav_ratios(df.where("s IS NOT NULL"), table, "s", ["g"], most=m).collect()) for m in (10**6, 0))
    assert near == far and len(far) == 1400
    assert calibrate.interpolated(df.where("s IS NULL"), table, "s", ["g"]).first()["lr"] is None


def test_models_in_force():
    day = lambda n: datetime.date(2020, 1, n)
    specs = [("f", 1, day(1)), ("f", 2, day(5)), ("g", 1, day(3)), ("g", 2, day(3))]
    assert evidence.in_force(specs, [day(1), day(3), day(4), day(9)]) == [[0], [0, 3], [0, 3], [1, 3]]


def test_running_maximum_of_models_in_force(spark):
    force, ends = [[0], [0, 3], [0, 3], [1, 3]], [(0.5, 4.0), (0.25, 8.0), (1.0, 1.0), (0.1, 2.0)]
    rows = [[9.0, 0.0, 99.0, 0.1], [0.1, 9.0, 99.0, 7.0], [None, 0.01, 99.0, None], [float("nan"), 1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, lr array<double>")
    got = {r.i: r.now for r in df.select("i", evidence.running("lr", ends, force).alias("now")).collect()}
    assert got[0] == [4.0] * 4 and got[1] == [0.5, 2.0, 2.0, 8.0] and got[2] == [0.5, 0.5, 0.5, 0.5]
    assert all(math.isnan(x) or x == 4.0 for x in got[3])
    # The array of ratios is read as it is: an array made from it, put in place of its name, is made anew for each element.
    plan = df.select("i", F.posexplode(evidence.running("lr", ends, force)))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip" not in plan.lower()


def test_blocks_are_computed_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in.parquet"))
    built = []

    def get(params, name="squares"):
        def build():
            built.append(params)
            return spark.read.parquet(str(tmp_path / "in.parquet")).select((F.col("id") * params["k"]).alias("v"))

        return sorted(r.v for r in blocks.block(spark, name, params, [str(tmp_path / "in.parquet")], [panel], build).collect())

    assert get({"k": 2}) == get({"k": 2}) == list(range(0, 20, 2)) and len(built) == 1
    assert get({"k": 3})[-1] == 27 and len(built) == 2
    spec = lambda k: ("squares", {"k": k}, [str(tmp_path / "in.parquet")], [panel])
    assert blocks.missing(spark, [spec(2), spec(3), spec(4)]) == [2]
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in.parquet"))
    assert get({"k": 2}) == [0, 2, 4, 6, 8] and len(built) == 3 and get({"k": 2}, "other") == [0, 2, 4, 6, 8]

    def broken():
        return spark.range(1).select(F.raise_error(F.lit("no")).alias("v"))

    with pytest.raises(Exception, match="no"):
        blocks.block(spark, "bad", {}, [], [], broken)
    assert blocks.missing(spark, [("bad", {}, [], [])]) == [0]  # nothing is published by halves
    blocks.clear(spark)
    assert blocks.missing(spark, [spec(2)]) == [0]


def records_shuffled(spark):
    """Rows written to shuffles so far, by stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
    out = {}
    while stages.hasNext():
        s = stages.next()
        out[s.stageId()] = s.shuffleWriteRecords()
    return out


@pytest.mark.parametrize(("size", "buffer"), [(500_000, 4_000_000), (60, 300)])
def test_calibrators_shuffle_packed_scores_and_pool_them_by_range(spark, items, monkeypatch, size, buffer):
    """A row for each row and model used to be shuffled, twice."""
    monkeypatch.setattr(panel, "RANGE", size, raising=False)
    monkeypatch.setattr(panel, "BUFFER", buffer, raising=False)
    rows, df = items
    df, names = panel.numbered(df, "label", "generator")
    m = models(names)
    rng = np.random.default_rng(5)
    beta = rng.normal(0, 1, (len(SPECS), 4))
    n0, n1 = (np.array([float(sum(r[1] == y and r[3] != held and (not y or r[2] in keep) for r in rows)) for keep, held, _ in SPECS]) for y in (0, 1))
    df = df.repartition(3).localCheckpoint()
    before = records_shuffled(spark)
    found = panel.blocks(df, m, beta, ["a", "b", "c"], n0, n1).collect()
    sent = sum(n for stage, n in records_shuffled(spark).items() if stage not in before)
    if size > len(rows):
        assert sent < len(rows)  # 3 tasks x 6 models x 2 labels, and the blocks
    for k, (keep, held, _) in enumerate(SPECS):
        use = [r for r in rows if r[3] != held and (r[1] == 0 or r[2] in keep)]
        score, y = np.round([beta[k] @ [1.0, *r[4:]] for r in use], 9), np.array([r[1] for r in use])
        at = np.unique(score)
        w1 = np.array([y[score == s].sum() * 0.5 / n1[k] for s in at])
        w = w1 + np.array([(1 - y[score == s]).sum() * 0.5 / n0[k] for s in at])
        a, b = np.append(0, np.cumsum(w1)), np.append(0, np.cumsum(w))
        # Isotonic regression by its formula: the greatest over beginnings of the least over ends of the mean between them.
        mean = np.array([[(a[j + 1] - a[i]) / (b[j + 1] - b[i]) if j >= i else np.inf for j in range(len(at))] for i in range(len(at))])
        ends = np.minimum.accumulate(mean[:, ::-1], 1)[:, ::-1]
        expected = np.array([ends[: i + 1, i].max() for i in range(len(at))])
        mine = sorted((r.lo, r.hi, r.w1 / r.w) for r in found if r.model == k)
        got = np.array([next(p for lo, hi, p in mine if lo - 1e-6 <= s <= hi + 1e-6) for s in at])
        assert np.allclose(got, expected, atol=1e-12)


def test_falling_runs_are_pooled_like_single_rows():
    rng = np.random.default_rng(3)
    for n in (101, 1000, 5000):
        w = rng.integers(1, 4, n).astype(float)
        w1 = np.minimum(w, rng.integers(0, 4, n))
        rows = np.column_stack([np.arange(n), np.arange(n), w, w1])
        held = []
        for lo, hi, v, v1 in rows.tolist():
            while held and held[-1][3] * v >= v1 * held[-1][2]:
                lo, _, u, u1 = held.pop()
                v, v1 = v + u, v1 + u1
            held.append((lo, hi, v, v1))
        assert np.array_equal(calibrate._pooled(rows), np.array(held))


def test_costs_of_strengths_are_added_up_without_copies_of_rows(spark, monkeypatch):
    blocks.clear(spark)
    got = evidence.strengths(spark, "/root/testdata/sf0.001")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.of, r.l2): r.cost for r in got.collect()}
    monkeypatch.setattr(panel, "KNOTS", 0)
    assert got == pytest.approx({(r.of, r.l2): r.cost for r in evidence.strengths(spark, "/root/testdata/sf0.001").collect()})
    assert len(got) == 35
