"""Ranked search: the query against scoring everything, blocks that are skipped, edge cases."""

import random

import numpy as np
import pytest

from chronolens.llm import ranked


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ÉE", "Straße"]
    line = lambda n: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=n))
    docs = [(i, line(rng.randint(1, 80))) for i in range(500)]
    docs += [(600 + i, docs[i % 7][1]) for i in range(40)]  # ties
    docs += [(700, None), (701, ""), (702, " .,\n"), (703, "W1-w1_W2!É"), (704, line(6000)), (None, docs[0][1]), (None, None), docs[4], docs[4]]
    items = [(i, line(rng.randint(1, 25))) for i in range(30)] + [(40, None), (41, "?"), (42, "never seen"), (43, "W1 w1 w1 É é"), (3, "w50 w51"), (None, "w2 w3")]
    return docs, items


def test_query_is_brute_force(spark, rows, tmp_path):
    docs, items = rows
    docs = [r for r in docs if r[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = ranked.op13_ranked(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ranked.brute(docs, items), key=repr)


@pytest.mark.parametrize(("terms", "postings", "cells"), [(1_000_000, 200_000, 12_000_000), (60, 500, 12_000_000), (1, 10**9, 900)])
def test_operator_in_blocks_and_parts(spark, rows, terms, postings, cells):
    docs, items = rows
    d = spark.createDataFrame([(i, t, "s", {"a": 1}) for i, t in docs], "doc_id long, text string, score string, term map<string,int>").repartition(3)
    q = spark.createDataFrame(items[:12] + items[30:], "item_id long, text string")
    got = ranked.search(d, q, k=7, query_terms=terms, postings=postings, cells=cells).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(ranked.brute(docs, items[:12] + items[30:], 7), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert ranked.search(none, some.selectExpr("CAST(item_id AS long) AS item_id", "text")).count() == 0
    assert ranked.search(some, none, "item_id", "text", "doc_id").count() == 0
    assert [tuple(r) for r in ranked.search(some, some.where("text <> ''"), "item_id").select("item_id", "rank", "doc_id").collect()] == [("1", 1, "1")]


def test_blocks_are_skipped_by_their_bounds_alone():
    rng = np.random.default_rng(5)
    topics = [rng.permutation(200)[:25] for _ in range(20)]
    docs = []
    for i in range(3000):
        t = np.unique(rng.choice(topics[i % 20], 12))
        docs.append((i, t.astype("int32"), rng.integers(1, 4, len(t)).astype("int32")))
    names = {str(t).encode(): t for t in range(200)}
    block = [(q, q, {str(t).encode(): 1 for t in topics[q][:6].tolist()}) for q in range(20)]
    queries = ranked.Queries(block, names, rng.integers(1000, 9000, 200))
    n = np.full(3000, 30)
    part = ranked.Part([d[0] for d in docs], n, [d[1:] for d in docs], queries, (3000, 90000))
    taken, total = 0, 0
    for q in range(20):
        best, blocks = part.search(queries, q, [], 10)
        score = part.impact[:, part.column[queries.terms[q]]].astype("int64") @ queries.weights[q]
        want = sorted((-s, False, i) for i, s in enumerate(score.tolist()) if s > 0)[:10]
        assert best == want
        taken, total = taken + blocks, total + sum(len(part.blocks[t][0]) for t in queries.terms[q].tolist())
    assert taken < total / 2
