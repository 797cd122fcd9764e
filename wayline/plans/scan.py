"""Ordered computations over a whole table without one task that holds it all.

Rows are dealt into ranges of their order key, at splitters drawn from a sample of the keys, so ranges hold about as many rows each however the keys lie. A
window works within each range, one summary row a range goes through a window over all ranges, and what it carries in is joined back. So the
only window without partitions sees a row a range.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import let

#: Keys that are drawn for each range.
DRAWN = 32


def ordered_bucket(df: DataFrame, order: list[str], ranges: int | None = None) -> Column:
    """The number of the range that a row's ``order`` (nulls first) falls into: one of ``ranges``, by default as many as shuffles have partitions.

    The keys with the least hashes are drawn, DRAWN for each range, which is all that reaches the driver; every DRAWN-th of them, in order, is
    a splitter. The column depends on the row's key alone, so it may be computed more than once.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = df.select(*order).schema
    drawn = df.select(F.struct(*order).alias("k")).orderBy(F.xxhash64("k"), "k").limit(DRAWN * n).orderBy("k")
    drawn = [] if n < 2 else drawn.select(*[F.col("k")[c].cast("string").alias(c) for c in order]).collect()
    each = max(1, len(drawn) // n)
    splitters = [F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kinds]) for row in drawn[each::each]]
    if not splitters:
        return F.lit(0)
    size = isqrt(len(splitters) - 1) + 1
    groups = [splitters[k : k + size] for k in range(0, len(splitters), size)]
    upto = lambda found, key: F.size(F.filter(found, lambda s: s <= key))
    within = lambda key, group: F.when(group == 0, 0).otherwise((group - 1) * size + upto(F.get(F.array(*[F.array(*g) for g in groups]), group - 1), key))
    # a key may be costly to make, as a path is of hashes: made once a row, not once for each splitter
    return let(F.struct(*order), lambda key: let(upto(F.array(*[g[0] for g in groups]), key), lambda group: within(key, group)))


def _carried(df: DataFrame, summary: dict[str, Column], carry) -> DataFrame:
    """``df`` (with column _bucket) joined to what ``carry`` makes of one row of ``summary`` for each bucket."""
    per = df.groupBy("_bucket").agg(*[c.alias(n) for n, c in summary.items()])
    return df.join(carry(per), "_bucket", "left")


def running_sums(df: DataFrame, bucket: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """Columns of cumulative sums in order; nulls add nothing."""
    df = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": F.coalesce(c, F.lit(0.0)) for n, c in sums.items()})
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = _carried(df, {f"_s_{n}": F.sum(f"_v_{n}") for n in sums}, lambda per: per.select("_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_c_{n}") for n in sums]))
    out = carried.withColumns({n: F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(upto) for n in sums})
    return out.drop("_bucket", *[f"_{k}_{n}" for n in sums for k in "vc"])


def previous_row(df: DataFrame, bucket: Column, order: list[str], name: str, value: Column) -> DataFrame:
    """Column ``name``: ``value`` of the row before, across buckets; null for the first row."""
    df = df.withColumn("_bucket", bucket).withColumn("_v", F.struct(value.alias("v")))
    within = W.partitionBy("_bucket").orderBy(*order)
    key = F.struct(*order)
    carried = _carried(df, {"_last": F.max_by("_v", key)}, lambda per: per.select("_bucket", F.lag("_last").over(W.orderBy("_bucket")).alias("_in")))
    return carried.withColumn(name, F.coalesce(F.lag("_v").over(within), F.col("_in"))["v"]).drop("_bucket", "_v", "_in")


def last_known(df: DataFrame, bucket: Column, order: list[str], name: str, value: Column, inclusive: bool = False) -> DataFrame:
    """Column ``name``: the last non-null ``value`` before a row (or at it), across buckets."""
    df = df.withColumn("_bucket", bucket).withColumn("_v", value)
    frame = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carried = _carried(df, {"_last": last}, lambda per: per.select("_bucket", F.last("_last", ignorenulls=True).over(before).alias("_in")))
    return carried.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(frame), F.col("_in"))).drop("_bucket", "_v", "_in")


def next_known(df: DataFrame, bucket: Column, order: list[str], name: str, value: Column, inclusive: bool = False) -> DataFrame:
    """Column ``name``: the first non-null ``value`` after a row (or at it), across buckets."""
    df = df.withColumn("_bucket", bucket).withColumn("_v", value)
    # in reverse, as a frame that ends with the partition is gone through anew for each row
    frame = W.partitionBy("_bucket").orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    after = W.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    first = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carried = _carried(df, {"_first": first}, lambda per: per.select("_bucket", F.last("_first", ignorenulls=True).over(after).alias("_in")))
    return carried.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(frame), F.col("_in"))).drop("_bucket", "_v", "_in")


def streak(df: DataFrame, bucket: Column, order: list[str], name: str, active: Column) -> DataFrame:
    """Column ``name``: for how many rows up to this one, without a break, ``active`` has been true; across buckets."""
    df = df.withColumn("_bucket", bucket).withColumn("_a", F.coalesce(active, F.lit(False)))
    within = W.partitionBy("_bucket").orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(within))
    df = df.withColumn("_break", F.max(F.when(~F.col("_a"), F.col("_n"))).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))
    per = df.groupBy("_bucket").agg(F.max("_n").alias("_rows"), F.max("_break").alias("_b"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = per.withColumn("_all", F.sum("_rows").over(before)).withColumn("_at", F.when(F.col("_b").isNotNull(), F.col("_all") - F.col("_rows") + F.col("_b")))
    ends = ends.withColumn("_tail", F.col("_all") - F.coalesce(F.max("_at").over(before), F.lit(0)))
    carry = ends.select("_bucket", F.coalesce(F.lag("_tail").over(W.orderBy("_bucket")), F.lit(0)).alias("_in"))
    out = df.join(carry, "_bucket", "left")
    run = F.when(~F.col("_a"), 0).when(F.col("_break").isNull(), F.col("_n") + F.col("_in")).otherwise(F.col("_n") - F.col("_break"))
    return out.withColumn(name, run.cast("long")).drop("_bucket", "_a", "_n", "_break", "_in")
