"""Blocks by content: a result is stored under a hash of what it came from, and computed only where it is absent.

The hash covers the block's name, its parameters, the files of its input tables (path, length, time of change) and the source text of
the modules that compute it, so a changed parameter, table or program is another block and leaves all others as they are. A
block is written beside its place and renamed to it when it is whole: a reader finds all of it or nothing, and of two writers one
publishes and the other drops its copy. Blocks lie in the folder of spark.checkpoint.dir, below `blocks`.

Edge cases: an empty result is a block like any other. Input tables must be given as paths of files or folders; a missing one is an error.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from .lineage import folder


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str]) -> list[list]:
    """(path, length, time of change) of each file below `paths`."""
    out = []
    for path in sorted(paths):
        p, fs = _fs(spark, path)
        todo = [fs.getFileStatus(p)]
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += list(fs.listStatus(s.getPath()))
            else:
                out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return sorted(out)


def address(spark: SparkSession, name: str, params: dict, inputs: list[str], code: list[ModuleType]) -> str:
    of = {"name": name, "params": params, "inputs": fingerprint(spark, inputs), "code": [hashlib.sha256(inspect.getsource(m).encode()).hexdigest() for m in code]}
    return f"{folder(spark)}/blocks/{name}-{hashlib.sha256(json.dumps(of, sort_keys=True, default=str).encode()).hexdigest()[:32]}"


def block(spark: SparkSession, name: str, params: dict, inputs: list[str], code: list[ModuleType], build: Callable[[], DataFrame]) -> DataFrame:
    """The block of that name, parameters, inputs and code: read if it is there, else built, published and read."""
    path = address(spark, name, params, inputs, code)
    there, fs = _fs(spark, path)
    if not fs.exists(there):
        beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
        build().write.parquet(beside.toString())
        if fs.exists(there) or not fs.rename(beside, there):
            fs.delete(beside, True)
    return spark.read.parquet(path)


def missing(spark: SparkSession, blocks: list[tuple[str, dict, list[str], list[ModuleType]]]) -> list[int]:
    """Which of the blocks (name, params, inputs, code) are absent, by number."""
    return [k for k, b in enumerate(blocks) if not (lambda at: at[1].exists(at[0]))(_fs(spark, address(spark, *b)))]


def clear(spark: SparkSession) -> None:
    """Delete all blocks of the session's folder."""
    p, fs = _fs(spark, f"{folder(spark)}/blocks")
    fs.delete(p, True)
