"""The pipeline stage by stage against brute force on a small table."""

import random

import corpus_pipeline
from chronolens.llm import decontaminate, jaccard


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(n))
    rows = [(i, text(rng.randint(20, 80)), "en", rng.choice("ab")) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" end" if i % 2 else ""), "en", "a") for i in range(10)]
    rows += [(200, "12 34 !!", "en", "a"), (201, None, None, None), (202, "", "en", "b")]
    item = " ".join(rows[20][1].split()[3:15])
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns[: len(columns)] == columns if name != "shard" else set(columns) < set(docs.columns)
    assert {i for i, _ in kept["language_id"]} == {r[0] for r in rows} - {200, 201, 202}
    want = {c for _, n, c in jaccard.brute([r for r in kept["language_id"]], 5, 80, 100)}
    assert sorted(i for i, _ in kept["near_duplicates"]) == sorted(want)
    clean = {r[0] for r in decontaminate.brute(kept["near_duplicates"], [(1, item)]) if not r[5]}
    assert {i for i, _ in kept["decontaminate"]} == clean and 20 not in clean
    assert {i for i, _ in kept["mix"]} <= clean and len(kept["shard"]) == len(kept["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["shard"])


def test_stages_take_any_rows(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, shard_ string, token string, bucket string, row_key string, state string"
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    texts = ["the house and the garden of the old man by the river", "le jardin et la maison du vieil homme près de la rivière", long, None, "", "12 !", "one"]
    rows = [(i, t, "fr" if i == 1 else "en", "a" if i % 2 else None, len(t or ""), "x", "y", "z", None, "s") for i, t in enumerate(texts)]
    rows += [rows[0]] * 3 + [(None, texts[0], None, None, 1, None, None, None, None, None), (None, "an id is missing here but the text is not like any other", "en", "b", 1, None, None, None, None, None)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and (name == "shard" or out.columns == docs.columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept["language_id"]) == len(rows) - 3  # null, empty and without a letter
    assert sorted(kept["near_duplicates"], key=repr) == sorted({(i, texts[i]) for i in (0, 1, 2, 6)} | {(None, rows[-1][1])}, key=repr)
    assert sorted(kept["decontaminate"], key=repr) == sorted(kept["near_duplicates"], key=repr)
    assert {x for x in kept["mix"]} <= set(kept["decontaminate"]) and sorted(kept["shard"], key=repr) == sorted(kept["mix"], key=repr)
    empty = spark.createDataFrame([], columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and set(empty.columns) <= set(out.columns), name


def test_stages_and_scores_take_map_columns_and_choose_among_equal_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronolens.llm import langid, lmscore, sharding

    texts = ["the house and the garden of the old man by the river", "le jardin et la maison du vieil homme sur la rive", None, "one"]
    rows = [(i, t, "fr" if i == 1 else "en", "a") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.struct("tags")))
    assert sharding.shard(df).count() == 4 and lmscore.difference(df, df.where("lang = 'en'")).count() == 4
    assert langid.identify(df, langid.fit(df)).count() == 4
    for name, stage in corpus_pipeline.STAGES:
        if name != "decontaminate":
            assert set(df.columns) <= set(stage(spark, df, str(tmp_path)).columns)
    twice = df.unionByName(df.where("doc_id = 0").withColumn("source", F.lit("b")))
    kept = {tuple(r) for n in (1, 3, 5) for r in jaccard.keep_one(twice.repartition(n), k=5, num=80, den=100).where("doc_id = 0").select("doc_id", "source").collect()}
    assert len(kept) == 1


def test_shards_are_shuffled_in_small_buckets(spark, tmp_path):
    """A task of the last stage holds some megabytes of text: eight buckets of 20 MB before."""
    from pyspark.sql import functions as F

    docs = spark.range(160, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 170_000).alias("text"))
    out = corpus_pipeline.sharded(spark, docs, str(tmp_path)).groupBy("shard", "bucket").agg(F.sum(F.length("text")).alias("size"), F.min("slot").alias("slot"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in out) == 160 and len(out) >= 20 and max(r["size"] for r in out) <= 2 * corpus_pipeline.BUCKET_BYTES
