"""Repeated passages: the query and the operator against a count of all strings, the merge against sorting, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import suffixes


def documents(seed, n, size=60, letters="abé"):
    """Texts that share passages of around n bytes in foreign surroundings, with copies, edits, periods and cuts at their ends."""
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choices(letters, k=m))
    passages = [text(rng.randint(n // 2, 2 * n)) for _ in range(6)]
    out = []
    for i in range(size):
        parts = []
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            parts += [text(rng.randint(0, n)), p if rng.random() < 0.5 else p[a:b]]
        out.append((i, "".join([*parts, text(rng.randint(0, n))])))
    out += [(100 + i, out[i][1]) for i in range(8)] + [(120, "ab" * n), (121, "a" * (n + 3)), (122, "a" * n), (123, None), (124, ""), (None, out[1][1]), (None, None)]
    return [*out, out[3], out[3]]


def rows_of(found):
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted(map(tuple, found.select("doc_id", "n_bytes", length, F.size("removed"), F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize(("n", "letters", "part", "run"), [(12, "ab", 100_000, 60_000), (12, "ab", 40, 100), (30, "abé", 60, 200), (7, "abc", 30, 50)])
def test_operator_is_brute_force(spark, n, letters, part, run):
    rows = documents(n, n, letters=letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "Z": F.create_map(F.lit("a"), F.lit(1)), "kept": F.lit(1)}).repartition(3)
    found = suffixes.removed(df, n=n, part_strings=part, run_strings=run)
    assert found.columns == ["doc_id", "key", "Z", "n_bytes", "removed", "kept"]
    assert rows_of(found) == sorted(suffixes.brute(rows, n), key=repr)


def test_query_is_brute_force(spark, tmp_path):
    rows = documents(9, 200, letters="abcdefgh ß", size=80)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffixes.op12_suffixes(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(suffixes.brute(rows), key=repr)


def test_long_texts_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghij", k=9000))
    rows = [(1, long[:5000] + "x" + long[2000:4000]), (2, "y" + long[6000:] + "z"), (3, long[5900:6500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    data = np.frombuffer(rows[0][1].encode(), "uint8")
    at, h = suffixes.anchors(data, np.array([len(data)]), 200, 100)
    monkeypatch.setattr(suffixes, "PIECE", 700)  # the workers read it with the function
    assert rows_of(suffixes.removed(df)) == sorted(suffixes.brute(rows), key=repr)
    assert suffixes.removed(df.where("false")).count() == 0
    assert (suffixes.core_hashes(np.stack([data[a : a + 100] for a in at])) == h).all()


def test_merge_is_sorting():
    rng = random.Random(2)
    for slices in (1, 2, 5, 16):
        strings = sorted({bytes(rng.choices(b"ab\0", k=40)) for _ in range(3000)} | {b"a" * 36 + rng.randbytes(4) for _ in range(200)})
        parts = [sorted(s for s in strings if hash(s) % slices == j) for j in range(slices)]
        packed = [next(suffixes.sliced(np.frombuffer(b"".join(p), "uint8").reshape(-1, 40), [])) for p in parts if p]
        got = list(suffixes.merged([suffixes.opened(d["n"], d["size"], d["slice"], 40) for d in packed]))
        assert [s for s, _ in got] == strings
        for (a, _), (b, lcp) in zip(got, got[1:], strict=False):
            assert a[:lcp] == b[:lcp] and a[lcp] != b[lcp]
