"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; on a cluster, whose machines share no local folder, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{found.rstrip('/')}/chronolens"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more, now and not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """In a task: return memory that this Python worker has freed to the system. Workers outlive stages, and what they keep for
    later counts against their executor while other operators run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_hash(df: DataFrame, *first: Column) -> Column:
    """A hash of `first` and all columns of a row; those that hold maps, which have no hash, count as JSON."""
    of = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*first, *[of(f) for f in df.schema.fields])


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the highest counts, at most `limit`: all above a cutoff found from how often each count comes up.

    No task sends more than it keeps; rows at the cutoff stay out together where they don't all fit."""
    kept, cutoff = 0, 0
    for r in counts.groupBy(F.col(count).alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("value")).toLocalIterator():
        if kept + r.rows > limit:
            cutoff = r.value
            break
        kept += r.rows
    return counts.where(F.col(count) > cutoff)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it while `df` has such a column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
