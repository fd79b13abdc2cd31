"""Runs that are resumed: a pinned record beside the shards, compared before anything is appended.

A run's folder holds `record` (what the run was started with: parameters, the fingerprint of its items, versions) and `shards`, a
folder for each shard that is done. resume() writes the record on the first call; later calls compare it with theirs and refuse to
go on where anything differs, naming the fields. Then only the shards that are absent are computed, each written beside
its place and renamed when it is whole, so an interrupted run leaves whole shards and nothing else, and what a resumed run holds is
what an uninterrupted one would.

Edge cases: shards without rows are done once written, like others. An empty table has no shards. Rows with a null key are a shard
of their own (-1).
"""

from __future__ import annotations

import platform
import uuid
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.lineage import delete

FIELDS = "field string, value string"


def record(items: DataFrame, key: str, columns: list[str], params: dict, weights: dict[str, str] | None = None) -> dict[str, str]:
    """What a run rests on: each parameter, the order-free fingerprint of its items, digests of the weights, and the runtime."""
    p = audit.provenance(items, key, columns).first()
    out = {f"param:{k}": str(v) for k, v in sorted(params.items())} | {f"weights:{k}": v for k, v in sorted((weights or {}).items())}
    return out | {"items": "-".join(str(x) for x in p), "columns": ",".join([key, *columns]), "runtime:spark": pyspark.__version__, "runtime:python": platform.python_version()}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str) -> None:
    """Write a table beside its place and rename it there: a reader finds all of it or nothing."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    (a, fs), (b, _) = _fs(spark, beside), _fs(spark, path)
    if not fs.rename(a, b):
        delete(spark, beside)
        raise OSError(f"{path} can't be published")


def pin(spark: SparkSession, folder: str, now: dict[str, str]) -> None:
    """Write the run's record, or compare it with the one that is there: ValueError with the fields that differ."""
    path = f"{folder}/record"
    if not exists(spark, path):
        p, fs = _fs(spark, folder)
        fs.mkdirs(p)
        publish(spark.createDataFrame(sorted(now.items()), FIELDS), path)
        return
    drift = audit.drift(spark.read.schema(FIELDS).parquet(path).toDF("key", "value"), spark.createDataFrame(sorted(now.items()), "key string, value string"), "key", "value").collect()
    if drift:
        raise ValueError("the run was started with other values: " + "; ".join(f"{r.key}: {r.old} -> {r.new}" for r in sorted(drift)))


def done_shards(spark: SparkSession, folder: str) -> set[int]:
    p, fs = _fs(spark, f"{folder}/shards")
    if not fs.exists(p):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n.removeprefix("shard=")) for n in names if n.startswith("shard=") and "." not in n}


def resume(items: DataFrame, folder: str, key: str, compute: Callable[[DataFrame], DataFrame], now: dict[str, str], shard_rows: int = 1_000_000, batch: int = 64) -> list[int]:
    """Compute the shards that `folder` lacks, `batch` of them in one job; returns their numbers. A row's shard is its whole-number key divided by shard_rows."""
    spark = items.sparkSession
    pin(spark, folder, now)
    rows = items.withColumn("shard", F.coalesce(F.floor(F.col(key) / shard_rows), F.lit(-1)).cast("long"))
    wanted = sorted(r.shard for r in rows.select("shard").distinct().collect())  # a row a shard
    todo = [s for s in wanted if s not in done_shards(spark, folder)]
    p, fs = _fs(spark, f"{folder}/shards")
    fs.mkdirs(p)
    for at in range(0, len(todo), batch):
        some = todo[at : at + batch]
        beside = f"{folder}/part-{uuid.uuid4().hex}"
        compute(rows.where(F.col("shard").isin(some))).write.partitionBy("shard").parquet(beside)
        for s in some:
            (a, _), (b, _) = _fs(spark, f"{beside}/shard={s}"), _fs(spark, f"{folder}/shards/shard={s}")
            if not (fs.rename(a, b) if fs.exists(a) else fs.mkdirs(b)):
                raise OSError(f"shard {s} can't be published")
        delete(spark, beside)
    return todo


def results(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All rows of the shards that are done."""
    reader = spark.read.option("basePath", f"{folder}/shards")
    return (reader.schema(schema) if schema else reader).parquet(f"{folder}/shards")
