"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for every node of ``edges`` (a, b); nodes without edges are not listed.

    Alternating star contraction: every node's neighbours are joined to its least neighbour, first the greater ones, then
    the lesser ones, until nothing changes; a logarithmic number of rounds. Least neighbours are found by aggregation, so a node with
    any number of neighbours is no single task's burden. Each round's edges are written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lesser = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lesser, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lesser.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, stored(small, "component-edges")
        discard(last)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
