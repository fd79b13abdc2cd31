"""Periodic runs: the query against comparison of all distances, the grammar's extensions, edge cases."""

import random

import numpy as np
import pytest

from chronolens.llm import runs


def text(rng, n=None):
    letters = "abcdéfgh"[: rng.randint(1, 8)]
    w = [rng.choice(letters) for _ in range(rng.randint(0, 120) if n is None else n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(len(w) + 1), rng.randint(1, 12)
        u = w[a : a + p]
        w[a:a] = (u * 80)[: rng.randint(10, 80)]
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, text(rng)) for i in range(400)]
    out += [(500, None), (501, ""), (502, " \t\r\n\x0b\x0c"), (503, "one"), (None, "a " * 40), (None, None), (504, "x y x z\x1cz " * 12), (505, "ab\n" * 24), (506, "ab " * 23), (507, text(rng, 2500))]
    return [*out, out[3], out[3], (10, "a b c " * 60), (10, "d e " * 60)]


def test_query_is_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", runs.F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = [tuple(r) for r in got.collect()], runs.brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 100 and sum(r[1] > 1 for r in want) > 20


def test_operator_takes_any_rows(spark, rows):
    columns = "doc_id long, text string, Runs string, n_words string, state map<string,int>"
    df = spark.createDataFrame([(i, t, "r", "n", {"a": 1}) for i, t in rows], columns)
    got = runs.periodic_runs(df, sequence_words=50)
    assert got.columns == ["doc_id", "text", "state", "n_words", "runs", "collapsed"] and got.count() == len(rows)
    want = {(r.text, tuple(map(tuple, r.runs))) for r in runs.periodic_runs(df).collect()}
    assert {(r.text, tuple(map(tuple, r.runs))) for r in got.collect()} == want  # however documents share sequences
    assert runs.periodic_runs(df.where("false")).count() == 0
    many = runs.periodic_runs(spark.range(2).selectExpr("id AS doc_id", "repeat('the same three ', 50000) AS text")).collect()
    assert all([tuple(x) for x in r.runs] == [(0, 150000, 3)] and r.collapsed == "the same three" for r in many)


def test_extensions_are_exact():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 6):
        x = np.concatenate([rng.integers(0, k, 300), np.tile(rng.integers(0, k, 7), 30), rng.integers(0, k, 100), [k]]).astype("int64")
        levels, n = runs.grammar(x), len(x)
        a = rng.integers(0, n - 1, 2000)
        b = a + rng.integers(1, n - a + 1)
        got, mirrored = runs.extension(levels, a, b), runs.extension([level.mirrored() for level in levels], a, b)
        for p, q, f, m in zip(a, b, got, mirrored, strict=True):
            for y, found in ((x, f), (x[::-1], m)):
                d = 0
                while q + d < n and y[p + d] == y[q + d]:
                    d += 1
                assert d == found
