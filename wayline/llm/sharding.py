"""Sharding by sampled splitters (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import stored, table

OVERHEAD = 16
_BUCKETS = 4096


def _bucket(h: Column) -> Column:
    """The leading 12 bits of a hash, in the order of the hash."""
    return F.shiftright(h, 52).cast("int")


def record_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """What sharding needs of each row: id, size, the checksum, and the key (h of the text, then k of the id)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
    ).withColumn("k", F.xxhash64("doc_id", "text_crc32"))


def sampled_splitters(rows: DataFrame, total: int, n_ranges: int, per_range: int = 24) -> DataFrame:
    """About ``n_ranges`` splitters (h, k): quantiles of a sample in which a row's chance grows with its size.

    A row is drawn with probability size / step, decided by a hash of its key, so a rerun draws the same rows. Every
    ``per_range``-th key of the sorted sample is a splitter. Where one text alone gives several splitters it is hot and
    they stay apart by k; any other splitter moves down to its text's first row, so that equal texts share a range.
    The sample has about ``n_ranges * per_range`` rows whatever the input's size; it is sorted by bucket of the hash,
    in parallel, not in one task.
    """
    step = max(1.0, total / (n_ranges * per_range))
    u = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(u < F.col("size") / step).select("h", "k").withColumn("b", _bucket(F.col("h")))
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    # one row per bucket, 4096 at most
    starts = sample.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = sample.join(F.broadcast(starts.select("b", "before")), "b").withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "k")))
    splitters = ranked.where(F.col("r") % per_range == 0).select("h", "k")
    hot = F.count("*").over(W.partitionBy("h")) > 1
    return splitters.withColumn("k", F.when(hot, F.col("k")).otherwise(F.lit(-(1 << 63)))).distinct()


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = OVERHEAD,
    snap: float = 0.02,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """Give every row a shard from 0 to ``n_shards - 1`` so that the shards' bytes are nearly equal (law ``bytes``).

    Rows are ordered by the hash of their text, then of their id. Sampled splitters cut that order into ranges; the
    exact bytes and rows of each range are counted; a range that turned out overfull is cut again by position. A row's
    place in bytes within the whole order gives its shard. Equal texts stand together and share a shard, unless their
    bytes exceed ``snap`` of a shard: such a group is dealt over several shards, else these would be unequal.

    Returns one row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null for this law). slot
    numbers a shard's rows from 0. Null texts have no bytes and the checksum of the empty string; null ids are kept;
    rows repeated in full get slots of their own; an empty table gives an empty result. Other columns are not read.
    """
    rows = stored(record_table(docs, id_col, text_col, overhead), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0]
    schema = "doc_id, size, text_crc32, 'bytes' AS law, shard, slot, CAST(null AS int) AS grown_shard"
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).selectExpr(*schema.split(", "))
    n_ranges = min(max(8 * n_shards, -(-int(total) // range_bytes)), 1 << 16)  # so the broadcast lookup stays under 2 MB
    target = total / n_shards
    splitters = sampled_splitters(rows, int(total), n_ranges)
    # at most one row per bucket: the bucket's own splitters, and how many lie in buckets before
    by_bucket = splitters.groupBy(_bucket(F.col("h")).alias("b")).agg(F.sort_array(F.collect_list(F.struct("h", "k"))).alias("keys"))
    span = rows.sparkSession.range(-(_BUCKETS // 2), _BUCKETS // 2).select(F.col("id").cast("int").alias("b"))
    lookup = (
        span.join(by_bucket, "b", "left")
        .withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<h:bigint,k:bigint>>")))
        .withColumn("base", F.coalesce(F.sum(F.size("keys")).over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    lookup = stored(lookup, "shard-lookup")
    key = F.struct("h", "k")
    ranged = (
        rows.withColumn("b", _bucket(F.col("h")))
        .join(F.broadcast(lookup), "b")
        .withColumn("rng", (F.col("base") + F.size(F.filter("keys", lambda s: s <= key))).cast("long"))
        .drop("b", "keys", "base")
    )
    # an overfull range is cut again by evenly spaced positions of its key's first part, or of k where one text fills it
    stats = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    cuts = F.least(F.lit(1 << 20), F.ceil(F.col("bytes") / F.lit(4.0 * total / n_ranges))).cast("long")
    stats = stats.withColumn("cuts", F.when(F.col("bytes") > 4.0 * total / n_ranges, cuts).otherwise(F.lit(1)))
    place = F.when(F.col("h0") == F.col("h1"), F.col("k") / float(1 << 64) + 0.5).otherwise(
        (F.col("h").cast("double") - F.col("h0").cast("double")) / (F.col("h1").cast("double") - F.col("h0").cast("double"))
    )
    ranged = ranged.join(_small(stats.select("rng", "h0", "h1", "cuts"), n_ranges), "rng").withColumn(
        "sub", F.when(F.col("cuts") == 1, F.lit(0)).otherwise(F.least(F.col("cuts") - 1, F.floor(place * F.col("cuts")))).cast("long")
    )
    ranged = stored(ranged.select("doc_id", "size", "text_crc32", "h", "k", "rng", "sub"), "shard-ranged")
    within = W.partitionBy("rng", "sub").orderBy("h", "k", "doc_id", "size")
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = ranged.withColumns({"cum": F.sum("size").over(upto), "rn": F.row_number().over(within).cast("long")})
    cells = ranged.groupBy("rng", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ahead = W.orderBy("rng", "sub").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("rng", "sub", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    # a row's place is its middle
    placed = numbered.join(_small(cells, 4 * n_ranges), ["rng", "sub"]).withColumns({"at": F.col("bytes0") + F.col("cum") - F.col("size") / 2, "row": F.col("n0") + F.col("rn") - 1})
    # small groups of equal texts go where their middle is
    texts = placed.groupBy("h").agg(F.sum("size").alias("group_bytes"), ((F.min("at") + F.max("at")) / 2).alias("group_at"), F.count("*").alias("copies")).where("copies > 1").where(F.col("group_bytes") <= snap * target)
    placed = placed.join(texts.select("h", "group_at"), "h", "left")
    at = F.coalesce("group_at", "at")
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(at * F.lit(n_shards) / F.lit(total))).cast("int"))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("row") - F.col("row0")).cast("long")).selectExpr(*schema.split(", "))


def _small(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast a table of known row bound while that bound is small; else let Spark choose the join."""
    return F.broadcast(df) if bound <= 200_000 else df


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
