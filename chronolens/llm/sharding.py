"""Sharding: a two-pass external shuffle into shards that grow without moving rows between old shards.

Pass one scatters rows. The shard is the one with the highest hash of (seed, shard, doc_id), so doc_id and
the number of shards decide, and one more shard takes rows only into itself (law `key`). Within its shard a
row goes to a bucket by a seeded hash of all its columns; the number of buckets follows from the bytes of the
table, so that a bucket of `bucket_bytes` fits in a task's memory. A bucket that comes out at over twice as much
holds equal rows; the table is then written once, and the rows of such buckets are dealt into parts by the number of
the row in the written table. Each part is a bucket of its own.

Pass two sorts a bucket by the hashes of its rows (which makes it independent of the order of arrival), shuffles it
with Fisher-Yates from a generator seeded by (seed, shard, bucket), and numbers its rows on from the rows of
the shard's earlier buckets. write_shards() writes the shuffled rows: a folder for each shard, whose files hold whole
buckets, each with its rows in order of their slots.

Edge cases: null doc_id hashes like a value of its own; null text has 0 bytes, and its crc32 is that of the empty text. A very
long text is one row, and a bucket holds at least one. Repeated rows (same doc_id) share a shard and get slots of their own;
which of equal rows gets which of their slots makes no difference. An empty table gives an empty result. Columns of the input
pass through; shard, slot, grown_shard and bucket replace input columns of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, give_back, materialize, new_folder, row_hash, table, utf8_bytes

SHARDS = 8
SEED = 1234
BUCKET_BYTES = 24 << 20
RESULTS = ("shard", "slot", "grown_shard", "bucket")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The number of the shard with the highest seeded hash; the lower number wins a tie."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]) if shards > 1 else None
    return F.lit(0) if best is None else -best["s"]


def scatter(docs: DataFrame, key: str, text_col: str, shards: int, seed: int, bucket_bytes: int) -> tuple[DataFrame, str, int]:
    """Pass one: `docs` with shard, grown_shard, bucket and a hash of the row (its name is returned), and the number of buckets of a shard."""
    tie = free_name(docs, "tie")
    total = docs.agg(F.sum(utf8_bytes(F.col(text_col)) + 1)).first()[0] or 0
    n = max(1, -(-total // (shards * bucket_bytes)))
    named = lambda df: df.withColumns({
        "shard": shard_of(F.col(key), shards, seed).cast("int"), "grown_shard": shard_of(F.col(key), shards + 1, seed).cast("int"),
        tie: row_hash(docs, F.lit(seed)),
    }).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), tie), F.lit(n)).cast("long"))
    of = named(docs)
    sizes = of.groupBy("shard", "bucket").agg(F.sum(utf8_bytes(F.col(text_col)) + 1).alias("size"), F.count("*").alias("rows"))
    large = materialize(sizes.where((F.col("size") > 2 * bucket_bytes) & (F.col("rows") > 1)), "large")
    if not large.isEmpty():
        part = free_name(docs, "part")
        large = large.select("shard", "bucket", F.ceil(F.col("size") / bucket_bytes).alias(part))
        of = named(materialize(docs, "scattered")).withColumn("row_", F.monotonically_increasing_id()).join(large, ["shard", "bucket"], "left")
        of = of.withColumn("bucket", F.when(F.col(part).isNull(), F.col("bucket")).otherwise(F.col("bucket") + n * (1 + F.pmod(F.xxhash64("row_"), F.col(part))))).drop(part, "row_")
    return of.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "grown_shard", "bucket", tie), tie, n


def shard(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs`, shuffled, with shard, grown_shard (the shard among one more), bucket and slot."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    scattered, tie, n = scatter(docs, key, text_col, shards, seed, bucket_bytes)
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    schema = T.StructType([*[scattered.schema[c] for c in docs.columns], T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("slot", T.LongType())])
    out_columns = schema.names

    def fisher_yates(group: tuple, rows: pa.Table, start: pa.Table) -> pa.Table:
        give_back()
        s, b = (x.as_py() for x in group)
        rng = np.random.default_rng([seed, s, b])
        order = np.argsort(rows.column(tie).to_numpy(), kind="stable")
        for i in range(len(order) - 1, 0, -1):
            j = int(rng.integers(0, i + 1))
            order[i], order[j] = order[j], order[i]
        rows = rows.take(pa.array(order))
        return rows.append_column("slot", pa.array(np.arange(len(order), dtype="int64") + start.column("start")[0].as_py())).select(out_columns)

    dealt = scattered.repartition(max(shards * n, docs.sparkSession.sparkContext.defaultParallelism), "shard", "bucket")
    return dealt.groupBy("shard", "bucket").cogroup(starts.groupBy("s", "b")).applyInArrow(fisher_yates, schema)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Shard `docs` and write them: the files of path/shard=s hold whole buckets, their rows in order of slot. Returns what was written."""
    found = shard(docs, **options)
    found.sortWithinPartitions("shard", "bucket", "slot").write.option("compression", "zstd").partitionBy("shard").mode("errorifexists").parquet(path)
    schema = T.StructType([f for f in found.schema.fields if f.name != "shard"] + [found.schema["shard"]])
    return docs.sparkSession.read.schema(schema).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "shards"))
    return found.select(
        "doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def brute(rows: list[tuple], shards: int = SHARDS) -> list[tuple]:
    """What the law `key` says of (doc_id, text) rows, for tests: doc_id, size, crc32 of the text, and the shard among `shards` and one more,
    by comparing the same hash for each shard in a loop; slots aren't in it."""
    import zlib

    import xxhash

    def hashed(*parts: tuple[int | None, str]) -> int:
        h = 42
        for value, kind in parts:
            if value is not None:
                h = xxhash.xxh64_intdigest(int(value).to_bytes(4 if kind == "int" else 8, "little", signed=True), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    def best(i: int | None, n: int) -> int:
        return max(range(n), key=lambda s: (hashed((SEED, "int"), (s, "int"), (i, "long")), -s))

    return [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), best(i, shards), best(i, shards + 1)) for i, t in rows]
