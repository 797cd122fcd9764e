"""Stored Parquet tables, cut into partitions: merging and deleting rewrites only the partitions that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.stored import discard, stored
from .writers import merge_by_mode


def write_table(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_table(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The table in ``path``; with the columns and types of ``like``, if it is given, though no partition be left."""
    return spark.read.schema(like.schema).parquet(path) if like is not None else spark.read.parquet(path)


def _values(df: DataFrame, by: str) -> list:
    """The values of a partition column: as many as the table has folders."""
    return [r[0] for r in df.select(by).distinct().collect()]


def _among(by: str, values: list) -> Column:
    some, has_null = [v for v in values if v is not None], None in values
    return F.coalesce(F.col(by).isin(some), F.lit(False)) | (F.col(by).isNull() & F.lit(has_null))


def _drop_folders(spark: SparkSession, path: str, by: str, values: list) -> None:
    if not values:
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {r["f"] for r in spark.read.parquet(path).where(_among(by, values)).select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("f")).distinct().collect()}
    for name in names:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)


def rewrite(spark: SparkSession, path: str, by: str, touched: list, content: DataFrame) -> None:
    """Partitions ``touched`` of the table in ``path`` become ``content``, which may be made from the table itself: it is staged as a written
    table first, so that a failure before the last step leaves the table as it was. Partitions that get no row go; no other partition's files are touched."""
    staged = stored(content, "table-staged")
    filled = _values(staged, by)
    _drop_folders(spark, path, by, [v for v in touched if v not in filled])
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    discard(staged)


def merge_table(spark: SparkSession, path: str, source: DataFrame, keys: list[str], mode: str, by: str, derived: Column | None = None) -> list:
    """``merge_by_mode`` on the table stored in ``path``, partitioned by ``by``. Returns the partitions that have changed.

    'skip' appends rows of new keys. 'update' rewrites the partitions that hold a key of ``source``, or get one: a row may move between partitions. 'replace' rewrites
    besides those that have rows that ``derived`` marks.
    """
    target = read_table(spark, path)
    source = stored(source.dropDuplicates(keys).select(*target.columns), "table-source")
    if mode == "skip":
        fresh = stored(source.join(target.select(*keys), keys, "left_anti"), "table-fresh")
        touched = _values(fresh, by)
        fresh.write.mode("append").partitionBy(by).parquet(path)
        discard(fresh)
    else:
        hit = target.join(source.select(*keys), keys, "left_semi")
        if mode == "replace" and derived is not None:
            hit = hit.unionByName(target.where(F.coalesce(derived, F.lit(False))))
        touched = _values(hit.select(by).unionByName(source.select(by)), by)
        rewrite(spark, path, by, touched, merge_by_mode(target.where(_among(by, touched)), source, keys, mode, derived))
    discard(source)
    return touched


def delete_rows(spark: SparkSession, path: str, by: str, gone: DataFrame | Column, keys: list[str] | None = None) -> list:
    """Delete the rows that ``gone`` marks, or whose ``keys`` stand in it. Returns the partitions that have changed."""
    target = read_table(spark, path)
    marked = target.join(gone.select(*keys).distinct(), keys, "left_semi") if keys else target.where(F.coalesce(gone, F.lit(False)))
    touched = _values(marked, by)
    if touched:
        held = target.where(_among(by, touched))
        rewrite(spark, path, by, touched, held.join(gone.select(*keys).distinct(), keys, "left_anti") if keys else held.where(~F.coalesce(gone, F.lit(False))))
    return touched


def set_null(spark: SparkSession, path: str, by: str, column: str, gone: DataFrame, key: str) -> list:
    """Null ``column`` of the rows whose ``column`` is among ``key`` of ``gone``: links to what has been deleted. Returns the partitions that have changed."""
    target = read_table(spark, path)
    names = gone.select(F.col(key).alias(column)).distinct()
    touched = _values(target.join(names, column, "left_semi"), by)
    if touched:
        held = target.where(_among(by, touched)).join(names.withColumn("_gone", F.lit(True)), column, "left")
        rewrite(spark, path, by, touched, held.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*target.columns))
    return touched


def undo_stored_batch(spark: SparkSession, paths: dict[str, tuple[str, str]], batch: int, links: tuple[str, ...] = ("attachments",)) -> dict[str, list]:
    """Remove a batch from the stored catalogue (name -> path and partition column): media, then the rows of other tables with their media_id; ``links`` lose
    their media_id only. Returns the partitions that have changed, by table."""
    path, by = paths["media"]
    gone = stored(read_table(spark, path).where(F.col("ingest_batch_id") == batch).select(F.col("id").alias("media_id")), "table-gone")
    changed = {}
    for name, (where, part) in paths.items():
        if name in links:
            changed[name] = set_null(spark, where, part, "media_id", gone, "media_id")
        elif name != "media":
            changed[name] = delete_rows(spark, where, part, gone, ["media_id"])
    changed["media"] = delete_rows(spark, path, by, F.col("ingest_batch_id") == batch)  # last, so that a failed run can be repeated
    discard(gone)
    return changed


