"""Scans and sinks: score files, manifests, sidecars, features, shards. Every source has an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit

SCORE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("raw_score", T.DoubleType())])
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("image_id", "path")] + [T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("origin_dataset", "split", "generator_family", "release_date", "generator", "crop_path")]
    + [T.StructField(c, T.IntegerType()) for c in ("source_width", "source_height", "crop_top", "crop_left", "crop_height", "crop_width")]
)
LINEAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("generator", "family", "stage", "stage_detail", "codebase", "evidence", "note")])
SIDECAR = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("detector", "score_semantics", "score_orientation", "upstream_repo", "upstream_commit")]
    + [T.StructField("weights", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])))]
    + [T.StructField("manifest", T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("rows", T.IntegerType())])), T.StructField("crop_policy", T.StringType())]
    + [T.StructField("runtime", T.StructType([T.StructField("device", T.StringType()), T.StructField("batch_size", T.IntegerType())])), T.StructField("elapsed_s", T.DoubleType()), T.StructField("generated_at", T.StringType())]
)


def file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_scores(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, detector, raw_score): score files in long form, the detector from the file's name."""
    return spark.read.schema(SCORE).option("header", True).option("enforceSchema", False).csv(list(paths)).select("image_id", file_stem().alias("detector"), "raw_score")


def join_scores(manifest: DataFrame, scores: DataFrame, detectors: list[str]) -> DataFrame:
    """The manifest with a column for each detector: one pivot and one join for all of them."""
    audit.require(audit.duplicate_keys(scores, "image_id", "detector"), "an item has two scores of a detector")
    return audit.one_to_one(manifest, scores.groupBy("image_id").pivot("detector", detectors).agg(F.first("raw_score")), "image_id")


def normalize_manifest(df: DataFrame) -> DataFrame:
    """Both layouts as one: missing columns become null, empty strings too, dates are parsed, `validation` is `val`."""
    out = df
    for f in MANIFEST.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        out = out.withColumn(f.name, F.nullif(c.cast("string"), F.lit("")).cast(f.dataType))
    split = F.when(F.col("split") == "validation", "val").otherwise(F.col("split"))
    return out.withColumn("split", split).withColumn("release_date", F.try_to_date("release_date"))


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A panel manifest: `file` is crop_path where there is one, and image_id must be unique."""
    df = normalize_manifest(spark.read.option("header", True).csv(path))
    audit.require(audit.duplicate_keys(df, "image_id"), "image_id repeats")
    df = df.withColumn("file", F.coalesce("crop_path", "path"))
    return df if limit is None else df.limit(limit)


def read_halves(spark: SparkSession, *paths: str, splits: list[str] | None = None) -> DataFrame:
    """The union of half manifests by column name."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if splits is None else out.where(F.col("split").isin(splits))


def read_index(spark: SparkSession, path: str, payload: list[str]) -> DataFrame:
    """All columns but the payload; the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c not in payload])


def fetch_payload(spark: SparkSession, path: str, wanted: DataFrame, key: str, payload: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(key, *payload).join(wanted.select(key).distinct(), key, "left_semi")


def shard_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, shard): the file that holds each key."""
    return spark.read.parquet(path).select(key, file_stem().alias("shard"))


def write_manifest(df: DataFrame, folder: str, stem: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{stem}.parquet")
    df.write.mode("overwrite").json(f"{folder}/{stem}.jsonl")


def write_scores(df: DataFrame, path: str) -> None:
    df.select("image_id", "raw_score").write.mode("overwrite").option("header", True).csv(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sidecar, its structs flattened."""
    s = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    return s.select("detector", "score_semantics", "score_orientation", F.size("weights").alias("n_weights"), F.col("manifest.sha256").alias("manifest_sha256"), F.col("manifest.rows").alias("manifest_rows"), "crop_policy", F.col("runtime.device").alias("device"), F.col("runtime.batch_size").alias("batch_size"), "elapsed_s")


def run_record(df: DataFrame, key: str, columns: list[str], semantics: str) -> DataFrame:
    """One row about a run: rows, distinct keys, an order-free fingerprint, and what the score means."""
    return audit.provenance(df, key, columns).join(df.agg(F.count_distinct(key).alias("n_keys"))).withColumn("score_semantics", F.lit(semantics))


def composition(df: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n) for each value of each axis, from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]))
    return df.select(each.alias("e")).groupBy("e.axis", "e.value").agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # a sidecar: a few rows


def write_tables(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each table that has rows; returns the names written."""
    done = []
    for name, df in frames.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append(name)
    return done


def load_features(index: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Vectors with their index rows, one to one; vectors must be finite."""
    audit.require(features.where(~audit.finite("x")).select(key), "vectors with NaN or infinity")
    joined = audit.one_to_one(index, features, key)
    audit.require(joined.where("x IS NULL").select(key), "items without a vector")
    return joined


def finished_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """Configurations whose marker file is there."""
    return spark.read.option("multiLine", True).json(pattern).select(F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("config")).distinct()


def enrich(index: DataFrame, *metadata: DataFrame, key: str = "file_id") -> DataFrame:
    """`index` with the columns of the first of several metadata tables that has the key."""
    both = None
    for i, m in enumerate(metadata):
        m = m.withColumn("_rank", F.lit(i))
        both = m if both is None else both.unionByName(m, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_rank")]
    one = both.groupBy(key).agg(*[F.min_by(c, "_rank").alias(c) for c in rest])
    return index.join(one, key, "left")


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINEAGE).option("header", True).csv(path)


def with_shards(df: DataFrame, row: str, size: int) -> DataFrame:
    return df.withColumn("shard", F.floor(F.col(row) / size))


def assemble_shards(done: DataFrame, n_shards: int, row: str) -> DataFrame:
    """All shards' rows in order of their row number, after checking that none is missing."""
    audit.require(audit.missing_shards(done.select("shard").distinct(), "shard", n_shards), "shards are missing")
    return done.orderBy(row)
