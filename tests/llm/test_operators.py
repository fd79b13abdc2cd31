"""Small tests of the training-data operators: brute force, round trips, edge cases."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import common, decontaminate, extract, fingerprint, jaccard, langid, lmscore, mixing, ngram, quality, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, state string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 60)) for _ in range(25)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i, t in enumerate(base)]
    for i in range(25):  # copies and near copies
        w = base[i % 9].split()
        if i % 3 and len(w) > 2:
            w[rng.randrange(len(w))] = "neu"
        out.append((100 + i, " ".join(w), "en", "a"))
    out += [(200, None, "en", "a"), (201, "", None, None), (202, " \t\n", "fr", "b"), (203, "one", "en", "a"), (204, "ONE", "en", "a"), (205, "one two", "en", "a"), (206, words(rng, 5000), "en", "a"), (None, base[0], "en", "a"), (None, None, None, None)]
    out += [out[3], out[3]]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize(("k", "num", "crowd"), [(3, 90, 32), (5, 80, 32), (3, 50, 2), (2, 60, 3)])
def test_jaccard_is_brute_force(docs, rows, k, num, crowd):
    got = [(r.id, r.n_shingles, r.component_id) for r in jaccard.link(docs, k=k, num=num, den=100, crowd=crowd).collect()]
    assert same(got, jaccard.brute([r[:2] for r in rows], k, num, 100))


def test_jaccard_keeps_one_of_each_class(docs, rows, empty):
    kept = jaccard.keep_one(docs, k=5, num=80, den=100)
    assert kept.columns == docs.columns
    classes = jaccard.brute([r[:2] for r in rows], 5, 80, 100)
    want = sorted({c for _, n, c in classes if n}) + [i for i, n, _ in classes if not n]
    assert same([r.doc_id for r in kept.collect()], want)
    assert jaccard.keep_one(empty).count() == 0


def test_decontamination_is_brute_force(spark, docs, rows):
    w = [r[1].split() for r in rows if r[1] and len(r[1].split()) > 20]
    items = [(1, " ".join(w[0][3:18])), (2, "One, two"), (3, None), (4, ""), (5, " ".join(w[1][:10]).upper()), (6, "never seen anywhere"), (5, " ".join(w[2][2:15])), (10, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute([r[:2] for r in rows], items)
    for size in (1 << 20, 100):  # one block and several
        got = decontaminate.decontaminate(docs, bench, max_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
        assert same([tuple(r) for r in got], want)
    clean = decontaminate.decontaminate(docs, bench.where("false")).collect()
    assert not any(r.contaminated for r in clean) and len(clean) == len(rows)


def test_decontamination_spans_are_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünd -- so:  A, b c! End")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "so a B c")], "item_id long, text string")
    (r,) = decontaminate.decontaminate(docs, bench, spans=True).collect()
    assert [r.text[s.start : s.end] for s in r.hit_spans] == ["so:  A, b c"]


def test_mixing_meets_weights_and_repeats_itself(spark, docs, empty):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(big, weights={"x": 1, "y": 1}).groupBy("source").count().collect()}
    assert abs(got["x"] - 10000) < 500 and abs(got["y"] - 10000) < 500
    assert {r.source for r in mixing.mix(big, weights={"x": 1}).select("source").distinct().collect()} == {"x"}
    a, b = ([tuple(r) for r in mixing.mix(d).drop("shuffle_key").collect()] for d in (docs, docs.repartition(5)))
    assert same(a, b)
    heavy = mixing.mix(docs, weights={"a": 1}, budget=50_000.0).groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()
    assert all(r.rate > 500 for r in heavy) and abs(np.mean([r.n / r.rate for r in heavy if r.doc_id != 3]) - 1) < 0.2
    assert mixing.mix(empty).count() == 0
    equal = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit(0.5).alias("rate"), F.lit("c").alias("cdf"))
    keys = mixing.mix(equal, budget=8000.0)  # equal rows aren't one partition's
    assert keys.select("shuffle_key").distinct().count() == keys.count() and keys.columns == ["doc_id", "text", "source", "cdf", "rate", "copy", "shuffle_key"]


def test_mixing_counts_follow_the_poisson_distribution(spark):
    draws = spark.range(40000).select(mixing.uniform(F.lit("s"), F.col("id").cast("string")).alias("u"))
    n = draws.select(F.size(F.filter(mixing.cumulative(F.lit(1.7)), lambda c: c <= F.col("u"))).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(n[0] - 1.7) < 0.03 and abs(n[1] - 1.7) < 0.06


def test_sharding_moves_rows_only_into_a_new_shard(docs, rows, empty, tmp_path):
    got = sharding.shard(docs, bucket_bytes=500).collect()
    assert len(got) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    assert same([r.grown_shard for r in got], [r.shard for r in sharding.shard(docs, shards=9).collect()])
    again = sharding.shard(docs.repartition(7), bucket_bytes=500).select("doc_id", "text", "shard", "slot").collect()
    assert same([(r.doc_id, r.text, r.shard, r.slot) for r in got], [tuple(r) for r in again])
    assert sharding.shard(empty).count() == 0
    keys = [(r.doc_id, r.shard, r.grown_shard) for r in got]
    assert same([(i, s, g) for i, _, _, s, g in sharding.brute([r[:2] for r in rows])], keys)


def test_written_shards_hold_slots_in_order_and_split_repeated_rows(spark, docs, rows, empty, tmp_path):
    import pyarrow.parquet as pq

    many = docs.unionByName(docs.where("doc_id = 3").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy"))
    path = tmp_path / "s"
    found = sharding.write_shards(many, str(path), bucket_bytes=2000)
    total = len(rows) + 2000 * sum(r[0] == 3 for r in rows)
    assert found.count() == total and {"shard", "slot", "grown_shard", "bucket", "lang", "source", "state"} <= set(found.columns)
    hot = found.where("doc_id = 3").groupBy("bucket").count().collect()
    assert len(hot) > 20 and max(r["count"] for r in hot) < 400  # the copies of a row are many buckets
    for s in range(8):
        slots = [r.slot for r in found.where(f"shard = {s}").select("slot").collect()]
        assert sorted(slots) == list(range(len(slots)))
        for f in (path / f"shard={s}").glob("*.parquet") if slots else []:
            t = pq.ParquetFile(f).read().to_pydict()
            assert t["slot"] == sorted(t["slot"])
            for b in set(t["bucket"]):  # a bucket is whole and without a gap
                of = [x for x, y in zip(t["slot"], t["bucket"], strict=True) if y == b]
                assert of == list(range(of[0], of[0] + len(of)))
    assert sharding.write_shards(empty, str(tmp_path / "e")).count() == 0
    empty.write.parquet(str(tmp_path / "q/documents.parquet"))
    assert sharding.op8_sharding(spark, str(tmp_path / "q")).count() == 0


def test_sharding_query_is_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in sharding.op8_sharding(spark, str(tmp_path)).collect()]
    assert same(got, sharding.brute([r[:2] for r in rows]))


def test_fingerprints_recover_differences(spark, docs):
    rng = random.Random(3)
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([0, 1, 5, 300]))] for _ in range(30)]
    pairs = [(i, a, (a[: rng.randint(0, len(a))] + b)) for i, (a, b) in enumerate(zip(sets, sets[1:] + sets[:1], strict=True))]
    df = spark.createDataFrame(pairs, "k long, own array<long>, other array<long>")
    df = df.withColumn("other", F.array_distinct("other"))
    got = {r.k: (r.a_only, r.b_only) for r in fingerprint.differences(df, ["k"], "own", "other").collect()}
    assert got == {i: (len(set(a) - set(b)), len(set(b) - set(a))) for i, a, b in pairs}


def test_fingerprint_query_is_brute_force(spark, rows, tmp_path, monkeypatch):
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprint.op1_fingerprints(spark, str(tmp_path)).collect()}
    d = sorted({r[0]: r[1] or "" for r in rows if r[0] is not None}.items())
    lines = lambda t: {x.strip() for x in t.split("\n") if x.strip()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {}
    for k, (i, t) in enumerate(d):
        after, half = d[(k + 1) % len(d)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(lines(t), lines(edited))) and r.near_next == pytest.approx(like(lines(t), lines(after)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(got) == len(d)


def test_fingerprint_query_takes_repeated_and_null_rows(spark, docs, rows, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    empty.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert fingerprint.op1_fingerprints(spark, str(tmp_path / "a")).count() == len(rows)
    assert fingerprint.op1_fingerprints(spark, str(tmp_path / "b")).count() == 0


def test_fingerprint_query_leaves_no_digests_and_peelings(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(common.shared_folder(spark))
    before = set(folder.glob("*")) if folder.exists() else set()
    got = fingerprint.op1_fingerprints(spark, str(tmp_path))
    left = {f.name.split("-")[0] for f in set(folder.glob("*")) - before}
    assert not left & {"digests", "peeling", "retry"} and got.count() == docs.count()


def test_langid_learns_words_and_backs_off(spark, docs, empty):
    texts = [("the house and the garden", "en"), ("le jardin et la maison", "fr"), ("das haus und der garten", "de")]
    train = spark.createDataFrame([(t, lang) for t, lang in texts for _ in range(3)] + [("x", None), (None, "en")], "text string, lang string")
    model = langid.fit(train)
    tests = spark.createDataFrame([("the gardens", "en"), ("la jardiniere", "fr"), ("hausen und", "de"), (None, "und"), ("123 --- ́", "und"), ("", "und")], "text string, lang string").withColumn("score", F.lit("mine"))
    got = langid.identify(tests, model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def kneser_ney(texts, order, vocabulary=4096):
    """The same model in dictionaries."""
    from collections import Counter, defaultdict

    counts = {order: Counter()}
    for t in texts:
        s = "\x01" * (order - 1) + t
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    off, sums, freed = {}, {}, {}
    for k, c in counts.items():
        n = [max(1, sum(v == x for v in c.values())) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        off[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        sums[k], freed[k] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            sums[k][g[:-1]] += v
            freed[k][g[:-1]] += off[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / vocabulary
        if g[:-1] not in sums[k]:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return (v - off[k][min(v, 3) - 1] if v else 0) / sums[k][g[:-1]] + freed[k][g[:-1]] / sums[k][g[:-1]] * p(g[1:])

    return p


@pytest.mark.parametrize("shard_rows", [10**6, 60])
def test_ngram_model_is_kneser_ney(spark, shard_rows):
    rng = random.Random(11)
    train = [words(rng, 30) for _ in range(12)]
    tests = [words(rng, 20), "zzz", "", None, train[0], "日本" + train[1]]
    fold = lambda t: "".join(chr(min(ord(c), 4095)) for c in t)
    p = kneser_ney([fold(t) for t in train], 4)
    model = ngram.estimate(ngram.count(spark.createDataFrame([(t,) for t in train], "text string"), "text", 4), 4)
    df = spark.createDataFrame(list(enumerate(tests)), "i long, text string")
    got = {r.i: r for r in ngram.score(df, "text", {"lp": model}, 4, shard_rows).collect()}
    for i, t in enumerate(tests):
        s = "\x01" * 3 + fold(t or "")
        assert got[i].lp == pytest.approx(sum(np.log(p(s[j : j + 4])) for j in range(len(s) - 3)), rel=1e-4, abs=1e-4)
        assert got[i].n_tokens == len(t or "")


def test_quality_and_cross_entropy_tell_junk(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, words(rng, 80) if i % 10 else "".join(rng.choices("XYZ!|# ", k=300)), "en") for i in range(400)] + [(900, None, "en"), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert len(got) == len(rows) and not got[900].keep and not got[901].keep and got[900].perplexity is None
    assert np.mean([got[i].keep for i in range(400) if i % 10]) > 0.98 and not any(got[i].keep for i in range(0, 400, 10))
    target = d.where("doc_id % 10 > 0 AND doc_id < 300")
    scored = {r.doc_id: r.score for r in lmscore.difference(d, target).collect()}
    assert scored[900] is None and max(scored[i] for i in range(400) if i % 10) < min(scored[i] for i in range(0, 400, 10))
    assert quality.classify(empty, labels).count() == 0
    assert all(r.keep == bool(r.n_tokens) for r in quality.classify(docs, labels.where("false")).collect())


def test_quality_thresholds_use_all_held_rows_and_labelled_junk(spark):
    held = spark.range(1000).selectExpr("'en' AS lang", "1 + id / 100D AS perplexity").union(spark.range(5).selectExpr("'xx' AS lang", "2D AS perplexity"))
    of_lang, rest = quality.thresholds(held, spark.createDataFrame([("en", 10.35)] * 10 + [("xx", 100.0)], "lang string, perplexity double"))
    (r,) = of_lang.collect()  # 0.92 is the highest quantile that keeps the junk of en out
    assert r.lang == "en" and r.threshold == pytest.approx(10.19, abs=0.02) and rest < 10.35
    labels = spark.range(300).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    ids = quality.trusted_ids(labels, fit_docs=30)
    assert ids.count() == 300 and 10 < ids.where("fit").count() < 60


def test_scoring_sends_no_model_through_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some text {i} 日本 \U0001f600") for i in range(20)], "i long, text string")
    model = ngram.estimate(ngram.count(df, "text", 5), 5)
    for of, name in ((type(df), "toLocalIterator"), (type(df), "toPandas"), (type(spark.sparkContext), "broadcast")):
        monkeypatch.setattr(of, name, lambda *a, **k: pytest.fail("rows of the model on the driver"))
    out = ngram.score(df, "text", {"lp": model}, 5)
    monkeypatch.undo()
    assert out.where("lp < 0").count() == 20


def test_cross_entropy_takes_all_target_text_and_every_script(spark, tmp_path, monkeypatch):
    a, b = "春夏秋冬山川草木", "東西南北上下左右"
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(a if i % 2 else b, k=200))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r.doc_id: r.score for r in lmscore.difference(d, d.where("doc_id % 2 = 1")).collect()}
    assert max(s for i, s in scored.items() if i % 2) + 1 < min(s for i, s in scored.items() if not i % 2)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    d.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("TRUSTED_DOCS", "FIT_DOCS"):
        monkeypatch.setattr(quality, name, 5, raising=False)
    monkeypatch.setattr(quality.trusted_ids, "__defaults__", (5,))
    # with all documents trusted, both models are of the same text
    assert all(r.score == pytest.approx(0, abs=1e-9) for r in lmscore.op9_lmscore(spark, str(tmp_path)).collect())


def query_tables(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string, score string, bucket string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(21)
    text = lambda: words(rng, rng.randint(3, 25))
    rows = [(i, text(), "en" if i % 3 else "fr", "a", "b", "c") for i in range(150)] + [(200 + i, "X|! " * rng.randint(2, 9), "en", None, None, None) for i in range(20)]
    rows += [rows[3], rows[3], (300, None, None, None, None, None), (301, "", "fr", None, None, None), (None, text(), "en", None, None, None), (302, words(rng, 4000), "en", None, None, None)]
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(20)] + [(5, 1, 1), (None, 1, 0), (7, 1, 0)]
    return rows, labels


def log_p(p, text):
    s = "\x01" * 4 + text
    return sum(np.log(p(s[j : j + 5])) for j in range(len(text)))


def test_quality_query_is_brute_force(spark, judged, tmp_path, monkeypatch):
    rows, labels = judged
    query_tables(spark, tmp_path, rows, labels)
    monkeypatch.setattr(quality.classify, "__defaults__", (quality.ORDER, 60))
    got = {(r.doc_id, r.n_tokens): r for r in quality.op2_quality(spark, str(tmp_path)).collect()}
    trusted = {i for i, q, t in labels if i is not None} - {5} - {i for i, q, _ in labels if q == 0}
    split = {r.doc_id: r.fit for r in quality.trusted_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 60).collect()}
    assert set(split) == trusted and 0 < sum(split.values()) < len(split)
    p = kneser_ney([t for i, t, *_ in rows if split.get(i)], 5, ngram.CODE_POINTS)
    perplexity = {t: np.exp(-log_p(p, t) / len(t)) for _, t, *_ in rows if t}
    held = [(lang, perplexity[t]) for i, t, lang, *_ in rows if split.get(i) is False]
    junk = [(lang, perplexity[t]) for i, t, lang, *_ in rows if i is not None and 200 <= i < 220]
    at = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]
    large = {x for x, _ in held if sum(y == x for y, _ in held) >= quality.LEAST}

    def limits(q):
        return {x: at([v for y, v in held if x in (y, None)], q) for x in [*large, None]}

    share = lambda of, lim: np.mean([v <= lim[x if x in lim else None] * (1 + 1e-9) for x, v in of])
    best = max(quality.QUANTILES, key=lambda q: (share(held, limits(q)) - share(junk, limits(q)), q))
    lim = limits(best)
    assert len(got) == len({(r[0], len(r[1] or "")) for r in rows})
    for i, t, lang, *_ in rows:
        r = got[i, len(t or "")]
        threshold = lim[lang if lang in lim else None]
        assert r.threshold == pytest.approx(threshold, rel=1e-5) and r.lang == (lang or "und")
        if t:
            assert r.perplexity == pytest.approx(perplexity[t], rel=1e-5)
            assert r.keep == (perplexity[t] <= threshold) or abs(perplexity[t] / threshold - 1) < 1e-5
        else:
            assert r.perplexity is None and not r.keep


def test_scoring_query_is_brute_force(spark, judged, empty, tmp_path):
    rows, labels = judged
    query_tables(spark, tmp_path, rows, labels)
    got = lmscore.op9_lmscore(spark, str(tmp_path)).collect()
    trusted = {i for i, q, _ in labels if i is not None and q == 1} - {5}
    target = kneser_ney([t for i, t, *_ in rows if i in trusted], 5, ngram.CODE_POINTS)
    background = kneser_ney([t or "" for _, t, *_ in rows], 5, ngram.CODE_POINTS)
    want = {(i, len(t or "")): t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        t = want[r.doc_id, r.n_tokens]
        if not t:
            assert (r.target_loss, r.background_loss, r.score) == (None, None, None)
            continue
        a, b = -log_p(target, t) / len(t), -log_p(background, t) / len(t)
        assert r.target_loss == pytest.approx(a, rel=1e-5) and r.background_loss == pytest.approx(b, rel=1e-5) and r.score == pytest.approx(a - b, abs=1e-5)
    clash = spark.createDataFrame([(1, "abc", "x", "y", "z")], "doc_id long, text string, score string, bucket string, target_loss string")
    out = lmscore.difference(clash, clash.where("false"))
    assert set(out.columns) == {"doc_id", "text", "bucket", "n_tokens", "target_loss", "background_loss", "score"} and out.first().bucket == "y"
    assert lmscore.difference(empty.drop("shard"), empty).count() == 0


def test_langid_floor_is_the_same_for_a_language_of_one_document(spark):
    rng = random.Random(4)
    known = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    train = [(" ".join(rng.choices(known, k=100)), "en") for _ in range(200)] + [("xyzzy plugh", "zz")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    scorer = langid.Scorer(model)
    assert scorer.score([t for t, _ in train])[0] == [lang for _, lang in train]
    few = langid.fit(spark.createDataFrame(train, "text string, lang string"), max_words=50)
    assert few.langs == ["en", "zz"] and set(few.lang) == {0, 1} and (few.n == 0).sum() == 52


def langid_brute(train, texts, evidence=langid.EVIDENCE):
    """Word frequencies with backoff to n-grams, in dictionaries of strings."""
    from collections import Counter, defaultdict

    import regex

    words_of = lambda t: regex.findall(r"[\p{L}\p{M}]+", t.lower()) if t and regex.search(r"\p{L}", t) else []
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    counts = defaultdict(Counter)
    for t, lang in train:
        for w in words_of(t) if lang is not None else []:
            counts[0, lang][w] += 1
            for n in (4, 3, 2, 1):
                counts[n, lang].update(grams(w, n))
    langs = sorted({lang for _, lang in counts})
    total = {n: {x: sum(counts[n, x].values()) + 1 for x in langs} for n in range(5)}
    known = {n: set().union(*[counts[n, x] for x in langs]) for n in range(5)} if langs else {}
    row = lambda n, g: np.array([np.log(counts[n, x][g] / total[n][x] if g in counts[n, x] else 0.5 / max(total[n].values())) for x in langs])
    out = []
    for t in texts:
        x = np.zeros(len(langs))
        w = words_of(t)
        for word in w if langs else []:
            if word in known[0]:
                x += row(0, word)
                continue
            for n in (4, 3, 2, 1):
                if some := [g for g in grams(word, n) if g in known[n]]:
                    x += np.mean([row(n, g) for g in some], axis=0)
                    break
        if not w or not langs:
            out.append(("und", 0.0))
        else:
            x = x / len(w) * min(len(w), evidence)
            out.append((langs[int(x.argmax())], 1 / np.exp(x - x.max()).sum()))
    return out


def test_langid_is_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 7)))
    of = {"aa": "abcdé", "bb": "cdefß", "cc": "हिन्दीक", "dd": "日本語文"}
    train = [(" ".join(word(of[lang]) for _ in range(rng.randint(1, 30))) + "! 12", lang) for lang in of for _ in range(15)] + [("nothing", None), (None, "aa"), ("", "bb")] + [("twice the same", "aa")] * 2
    tests = [" ".join(word(rng.choice(list(of.values()))) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "12 !", "\u0301 3", "ÀÉ CDE", "x", "zzzz qqqq", "İstanbul", train[0][0], train[0][0]]
    tests.append(" ".join(word("abcdé") for _ in range(3000)))  # longer than a piece
    monkeypatch.setattr(langid, "_PIECE", 500)
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    lang, score = langid.Scorer(model).score(tests)
    for t, a, b in zip(tests, zip(lang, score, strict=True), langid_brute(train, tests), strict=True):
        assert a[1] == pytest.approx(b[1], abs=1e-4), t
        assert a[0] == b[0] or b[1] < 0.51, t


def test_langid_query_is_brute_force(spark, docs, rows, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    want = langid_brute([(r[1], r[2]) for r in rows if not fold(r[0])], [r[1] for r in rows])
    got = langid.op6_langid(spark, str(tmp_path / "a")).collect()
    assert same([(r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in got], [(r[0], fold(r[0]), lang, round(float(s), 3)) for r, (lang, s) in zip(rows, want, strict=True)])
    empty.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert langid.op6_langid(spark, str(tmp_path / "b")).count() == 0


def test_left_out_end_tags_lose_no_text():
    runs = lambda html: " ".join(r[2].strip() for r in extract.Page(html).runs if r[2].strip())
    assert runs("<html><head><title>x</title><body><p>text") == "text"
    assert runs("<html><head><title>x</title><p>text<p>more") == "text more"
    assert runs("<head><title>x</title>plain") == "plain"
    assert runs("<head><noscript><style>a</style><body><p>text") == "text"
    for name in ("button", "select", "object", "audio", "video", "svg"):
        assert runs(f"<body><div><{name}><p>text</p></div><p>more").endswith("more") and "text" in runs(f"<body><{name}><p>text</p>")
        assert runs(f"<body><{name}><p>label</p></{name}><p>text") == "text"
    assert "text" in runs("<body><button>a<p>text</p><button>b</button>")


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\nÄ</html>"
    rows = [(3, "http://b/x?q=1#f", long), (1, "http://a/ \n", long), (2, None, "<p>short</p>"), (4, "http://c", "<p>short</p>"), (5, "u", None), (6, "u", ""), (7, "v", "y" * 150), (7, "v", "y" * 150), (None, "w", "y" * 150)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.has_request) for r in warc.op10_warc(spark, str(tmp_path)).collect()]
    size, digest = (lambda h: len((h or "").encode())), (lambda h: hashlib.sha256((h or "").encode()).hexdigest())
    kinds = [("revisit", 1), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None), ("revisit", 7), ("revisit", 7)]
    assert same(got, [(i, u, size(h), digest(h), *k, True) for (i, u, h), k in zip(rows, kinds, strict=True)])
    path = str(tmp_path / "w")
    warc.write_archives(spark.read.parquet(str(tmp_path / "pages.parquet")), path)
    found = warc.assemble(warc.read_records(spark, path)).where("main.type = 'response'").select("main.payload").collect()
    assert same([r.payload for r in found], [h or "" for (_, _, h), k in zip(rows, kinds, strict=True) if k[0] == "response"])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert warc.op10_warc(spark, str(tmp_path / "none")).count() == 0


def test_extraction_on_held_out_layouts_and_edge_cases(spark):
    model = extract.fit([])
    rng = random.Random(99)
    paragraphs = [words(rng, rng.randint(5, 60)).capitalize() + "." for _ in range(80)]
    phrases = [words(rng, rng.randint(1, 4)) for _ in range(80)]
    right = total = 0
    for _ in range(150):
        page, main = extract.labelled(extract.layout(rng, paragraphs, phrases))
        keep = extract.decode(page.parent, model[1].log_odds(extract.features(page, model[0])))
        right, total = right + (keep[1:] == main[1:]).sum(), total + len(main) - 1
    assert right / total > 0.97
    page = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=1>menu</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  text,\n with enough words to be read as one.<p>Second<br>text of the article, also long enough to count.</article><footer>&copy; foot</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain text"), (5, "u", page)]
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more\n\nFirst text, with enough words to be read as one.\n\nSecond text of the article, also long enough to count."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain text", 10), 5: (want, len(want))}


LONG = "A paragraph of the article that goes on for a good many words, so that it reads as running text. " * 3
HEAD = "<html><head><title>x</title></head><body>"
HAND = {  # pages that no layout of the fit draws: foreign, opaque or no names, tables, bare bodies
    "div": f"{HEAD}<div><a href=/>home</a> <a href=/n>news</a></div><div><h1>Heading</h1><p>{LONG}</p><p>{LONG}</p></div><div>&copy; 2020 Foo</div>",
    "x2": f"{HEAD}<div class=nav><ul><li><a href=/>home</a></li><li><a href=/b>b</a></li></ul></div><div class=x2><h1>Heading</h1><p>{LONG}</p><p>{LONG}</p></div><div class=footer>&copy; 2020 Foo</div>",
    "artikel": f"{HEAD}<div class=menue><ul><li><a href=/>home</a></li><li><a href=/b>b</a></li></ul></div><div class=artikel><h1>Heading</h1><p>{LONG}</p><p>{LONG}</p></div><div class=kommentare><h3>Kommentare</h3><p>I do not agree with this, it is wrong.</p></div>",
    "table": f"{HEAD}<table><tr><td><a href=/>home</a><br><a href=/b>b</a></td><td><h1>Heading</h1><p>{LONG}</p><p>{LONG}</p></td></tr></table>",
    "bare": f"<h1>Heading</h1><p>{LONG}</p><p>{LONG}</p>",
}


@pytest.fixture(scope="module")
def trees():
    return extract.fit([])


@pytest.mark.parametrize("name", sorted(HAND))
def test_extraction_of_pages_outside_the_layouts(trees, name):
    assert extract.main_text([HAND[name]], trees) == ["\n\n".join(["Heading", LONG.strip(), LONG.strip()])]


@pytest.mark.parametrize("part", ["<a ", "<div>", '<a href="x ', "<svg>", "<button>", "<head>", "< ", "<p>a", "</div>", "<!-- ", '<p title="', "<li>", "&amp;", "<td>x"])
def test_a_page_of_a_million_characters_is_parsed_in_linear_time(part):
    import time

    took = []
    for size in (100_000, 1_000_000):
        begin = time.process_time()
        extract.Page(part * (size // len(part)))
        took.append(time.process_time() - begin)
    assert took[1] < 4 and took[1] < 40 * max(took[0], 0.01)


def test_extraction_takes_any_rows(spark, trees):
    rows = [(1, "u", HAND["x2"], "mine", 5, "f")] * 3 + [(2, None, "<div>" * 3000 + "x", None, None, None), (None, None, None, None, None, None), (4, "v", "<p>" + LONG * 4000, "t", 1, "g")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, found string")
    out = extract.extract(df)
    got = out.collect()
    assert out.columns == ["page_id", "url", "html", "found", "text", "n_chars"] and len(got) == 6
    assert len({r.text for r in got if r.page_id == 1}) == 1 and all(r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id == 4) == (LONG * 4000).strip()
    assert extract.extract(df.where("false")).count() == 0


def test_extraction_query_is_its_operator_page_by_page(spark, tmp_path):
    rows = [(i, f"u{i}", h) for i, h in enumerate(HAND.values())] + [(9, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    model = extract.fit([h for _, _, h in rows if h])
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract.op5_extract(spark, str(tmp_path)).collect()}
    for i, u, h in rows:
        want = extract.main_text([h], model)[0]
        assert got[i] == (u, want, len(want))


def test_decoding_is_the_best_of_all_consistent_choices():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 8
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(size=n)
        fits = [c for c in product([0, 1], repeat=n - 1) if all(not c[i - 1] or not parent[i] or c[parent[i] - 1] for i in range(1, n))]
        best = max(sum(o * k for o, k in zip(odds[1:], c, strict=True)) for c in fits)
        keep = extract.decode(parent, odds)
        assert sum(odds[1:] * keep[1:]) == pytest.approx(best)


def test_crc_of_the_query_is_that_of_the_text(spark, tmp_path):
    spark.createDataFrame([(1, "Äé"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.size, r.text_crc32, r.law) for r in sharding.op8_sharding(spark, str(tmp_path)).collect()}
    assert got == {1: (5, zlib.crc32("Äé".encode()), "key"), 2: (1, 0, "key")}
