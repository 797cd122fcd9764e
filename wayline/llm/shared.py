"""Folders that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.stored import discard, folder  # noqa: F401


def new_path(spark: SparkSession, tag: str) -> str:
    return folder(spark, tag)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within: a finished write gives back its shuffle files at once, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later jobs start from those files, whichever
    executors have been lost meanwhile."""
    path = new_path(df.sparkSession, tag)
    with released_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def arrow_stage(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for wide rows: batches have 8 MB at most unless the session has set another size than Spark's 64 MB,
    and a worker gives the memory of a task back when it ends, since Spark keeps the worker for later stages."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) in ("67108864b", "64m"):
        df.sparkSession.conf.set(key, f"{8 << 20}b")

    @wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.mapInArrow(lean, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled_partitions(n_bytes: int, each: int, least: int) -> int:
    """As many partitions as give each ``each`` bytes at most; grows with the data."""
    return max(least, -(-int(n_bytes) // each))
