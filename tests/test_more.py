"""Runs that resume, draws that keep sources whole, ring blocks, recorded fingerprints: brute force and refusals."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from chronolens.functions import exprs as X
from chronolens.operators import audit, sampling
from chronolens.sources import runs


def test_an_interrupted_run_resumes_to_the_same(spark, tmp_path):
    items = spark.range(1000).select(F.col("id").alias("item"), (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 3)], "item long, v long"))
    computed = []

    def compute(df, broken=False):
        computed.append(sorted(r.shard for r in df.select("shard").distinct().collect()))
        if broken and len(computed) == 3:
            raise RuntimeError("lost")
        return df.select("shard", "item", (F.col("v") * 2).alias("w"))

    now = runs.record(items, "item", ["v"], {"k": 2}, {"model": "abc"})
    assert now["weights:model"] == "abc" and now["items"].startswith("1001-")
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    assert runs.resume(items, whole, "item", compute, now, shard_rows=100) == [-1, *range(10)] and computed == [[-1, *range(10)]]
    computed.clear()
    with pytest.raises(RuntimeError):
        runs.resume(items, broken, "item", lambda df: compute(df, True), now, shard_rows=100, batch=2)
    assert runs.done_shards(spark, broken) == {-1, 0, 1, 2}
    assert runs.resume(items, broken, "item", compute, now, shard_rows=100) == list(range(3, 10))
    rows = lambda p: sorted(map(tuple, runs.results(spark, p).select("shard", "item", "w").collect()), key=repr)
    assert rows(whole) == rows(broken) and len(rows(whole)) == 1001
    assert runs.resume(items, whole, "item", compute, now, shard_rows=100) == []
    with pytest.raises(ValueError, match="param:k: 2 -> 3"):
        runs.resume(items, whole, "item", compute, now | {"param:k": "3"}, shard_rows=100)
    with pytest.raises(ValueError, match="items"):
        runs.resume(items, whole, "item", compute, runs.record(items.where("v > 0"), "item", ["v"], {"k": 2}, {"model": "abc"}), shard_rows=100)


def test_draws_keep_sources_whole(spark):
    rng = random.Random(3)
    rows = [(i, 1, rng.choice("xyz"), rng.choice("ab"), None) for i in range(400)] + [(1000 + i, 0, None, None, s) for i, s in enumerate("p" * 40 + "q" * 300 + "r" * 100)] + [(2000, 0, None, None, None)]
    df = spark.createDataFrame(rows, "item int, label int, g string, part string, source string")
    got = sampling.draw_keeping_whole(df, "label", "g", "part", "source", "item", 60, ["p"]).collect()
    n = collections.Counter((r.label, r.g or r.source) for r in got)
    assert [n[1, g] for g in "xyz"] == [60, 60, 60] and n[0, "p"] == 40 and sum(v for (y, _), v in n.items() if y == 0) == 180
    exact = {s: 140 * size / 401 for s, size in (("q", 300), ("r", 100))}
    assert all(abs(n[0, s] - x) <= 1 for s, x in exact.items()) and len({r.item for r in got}) == 360
    assert {r.item for r in got} == {r.item for r in sampling.draw_keeping_whole(df.repartition(5), "label", "g", "part", "source", "item", 60, ["p"]).collect()}
    assert collections.Counter(r.source for r in sampling.draw_keeping_whole(df, "label", "g", "part", "source", "item", 60, []).collect() if r.label == 0)["p"] < 40
    with pytest.raises(ValueError, match=r"fewer than 300 rows: x \("):
        sampling.draw_keeping_whole(df, "label", "g", "part", "source", "item", 300, ["p"])
    with pytest.raises(ValueError, match="whole sources hold more: p \\(40\\), q \\(300\\)"):
        sampling.draw_keeping_whole(df, "label", "g", "part", "source", "item", 60, ["p", "q"])


@pytest.mark.parametrize(("channels", "side"), [(2, 7), (3, 5), (1, 3)])
def test_ring_blocks_are_those_of_loops(spark, channels, side):
    rng = random.Random(side)
    x = [rng.gauss(0, 1) for _ in range(channels * (side * side - 1))]
    df = spark.createDataFrame([(x,)], "x array<double>")
    got = df.select(*[b.alias(n) for n, b in X.ring_blocks(F.col("x"), channels, side).items()]).first().asDict()
    want, k, c = collections.defaultdict(list), 0, side // 2
    for i in range(side):
        for j in range(side):
            if (i, j) != (c, c):
                m = sum(x[h * (side * side - 1) + k] for h in range(channels)) / channels
                ring = max(abs(i - c), abs(j - c))
                want["mean"].append(m)
                want["ring 1" if ring == 1 else "ring 2" if ring == 2 else "ring 3+"].append(m)
                want["even" if (i - c) % 2 == 0 and (j - c) % 2 == 0 else "odd"].append(m)
                k += 1
    for name in ("mean", "ring 1", "ring 2", "ring 3+", "even", "odd"):
        assert got[name] == pytest.approx(want[name])
    assert got["deviations"] == pytest.approx([v - want["mean"][i % (side * side - 1)] for i, v in enumerate(x)])


def test_recorded_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, added int")
    prints = audit.provenance(df, "k", ["v", "added"]).withColumn("name", F.lit("now")).unionByName(audit.provenance(df, "k", ["v"]).withColumn("name", F.lit("before")))
    prints = prints.unionByName(audit.provenance(df.where("k = 1"), "k", ["v"]).withColumn("name", F.lit("lost")))
    assert {r.name: r.matches for r in audit.recorded_as(df, "k", ["v", "added"], ["v"], prints).collect()} == {"now": "whole", "before": "subset", "lost": "neither"}


def test_frequent_keys_collide_whole(spark):
    df = spark.createDataFrame([(i, "a/b" if i < 50 else f"c/{i}") for i in range(60)] + [(99, None), (98, None)], "i int, k string")
    got = audit.collisions(df, F.translate("k", "/", "_"), "flat")
    assert got.columns == ["i", "k", "flat", "n_same"] and sorted((r.i, r.n_same) for r in got.collect()) == [(i, 50) for i in range(50)] + [(98, 2), (99, 2)]
