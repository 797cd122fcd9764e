"""Structured Streaming jobs: bursts of selections, and ingestion that skips what it has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.writers import dedup_ingest


def selection_bursts(stream: DataFrame, gap: str = "700 milliseconds", late: str = "10 seconds") -> DataFrame:
    """user_id, start, end, n, values: a user's messages (ts, user_id, value) up to a silence of ``gap``; distinct values in the order of their first message.

    A burst comes out once the watermark has passed its end; messages later than ``late`` are dropped.
    """
    session = F.session_window("ts", gap)
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]))
    bursts = stream.withWatermark("ts", late).groupBy("user_id", session).agg(F.count("*").alias("n"), values.alias("values"))
    return bursts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "values")


#: Hex digits of a fingerprint that say where it is kept.
PREFIX = 2


def known_fingerprints(spark: SparkSession, seen: str, batch: DataFrame, before: int) -> DataFrame:
    """file_hash of what batches before ``before`` have brought, from those folders of ``seen`` that fingerprints of ``batch`` can lie in."""
    prefixes = [r[0] for r in batch.select(F.substring("file_hash", 1, PREFIX)).distinct().collect()]  # 16 ** PREFIX at most, for hashes in hex
    path = spark._jvm.org.apache.hadoop.fs.Path(seen)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return batch.limit(0).select("file_hash")
    rows = spark.read.schema("file_hash string, prefix string, batch long").parquet(seen)
    return rows.where(F.col("prefix").isin(prefixes) & (F.col("batch") < before)).select("file_hash")


def incremental_ingest(stream: DataFrame, target: str, checkpoint: str, late: str = "1 day"):
    """Append rows of ``stream`` (ts, id, file_hash, ...) to the Parquet table ``target`` unless their file_hash has been seen, in the stream's recent past or ever. Returns the running query.

    Fingerprints are kept beside the rows, in ``target``_seen, in folders by their first digits and with Bloom filters, so a batch reads only folders (and of
    these only files) that may hold its own, never the target. Both tables are written by batch: a batch that is repeated after a failure replaces what it wrote.
    """
    seen = f"{target.rstrip('/')}_seen"

    def add(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.persist()
        fresh = dedup_ingest(batch, known_fingerprints(spark, seen, batch, number)).withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        added = spark.read.schema(fresh.schema).parquet(target).where(F.col("batch") == number)
        hashes = added.select("file_hash", F.substring("file_hash", 1, PREFIX).alias("prefix"), "batch").repartition("prefix")
        kept = hashes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#file_hash", "true")
        kept.partitionBy("prefix", "batch").parquet(seen)
        batch.unpersist()

    fresh = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_hash"])
    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
