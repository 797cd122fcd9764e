"""Tables written to the shared folder, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The library's own setting for the folder, read where ``spark.checkpoint.dir`` is unset. Spark lets a running session set it, unlike its own.
FOLDER = "wayline.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else in ``wayline.shared.dir``; where both are unset and Spark is one process, as in tests, a
    temporary one, kept in the latter. A cluster must name a folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir (or {FOLDER}) must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayline-")
        spark.conf.set(FOLDER, found)
    return found.rstrip("/")


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` has written for ``tables``; nothing that is still to run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
