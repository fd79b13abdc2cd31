"""Cutting lineage: a frame written once in the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session without it gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` from a Parquet table in the shared folder: computed once, whatever reads it, and again by no executor's loss."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, least: int = 100) -> DataFrame:
    """`df`, which has so many `rows`, over tasks of equal size: as many as shuffles have, but for small tables of at least `least` rows each.
    A scan has no more tasks with rows than its files have row groups."""
    return df.repartition(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // least)))
