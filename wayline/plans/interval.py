"""Joins of instants with intervals, and of intervals with one another, by equi-joins on the nodes of a segment tree over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stored import stored

#: A side of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 100_000
#: Levels above the cells: enough for any time span in cells of a thousandth of a second.
LEVELS = 52
#: A node of the tree that more points than this look up, and more than one in HOT_SHARE of all, is dealt out in parts.
HOT_POINTS, HOT_SHARE = 20_000, 64


def cover_nodes(first: str, last: str) -> Column:
    """The nodes (level, node) of a binary tree over whole-numbered cells that together cover ``first`` to ``last``: at most two a level, and no cell twice.

    At level k a node has 2 ** k cells. Of the nodes that lie inside, those count whose parent doesn't: the first if its number is odd and the
    last if its number is even.
    """
    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col(last) - F.col(first) + 1).cast("double"))).cast("int") + 1)

    def at(k: Column) -> Column:
        step = lambda c: F.call_function("shiftright", c, k)
        lo, hi = -step(-F.col(first)), step(F.col(last) + 1) - 1
        node = lambda n, fits: F.when(fits & (lo <= hi), F.struct(k.alias("level"), n.alias("node")))
        return F.filter(F.array(node(lo, lo % 2 != 0), node(hi, hi % 2 == 0)), lambda x: x.isNotNull())

    return F.flatten(F.transform(levels, at))


def laid_out(intervals: DataFrame, start: str, end: str, width_s: float) -> DataFrame:
    """``intervals`` with a row for each node (_level, _node) of their cover, in cells of ``width_s`` seconds; empty and null ones go."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width_s)).cast("long")
    whole = intervals.where(F.col(end) >= F.col(start)).withColumns({"_first": cell(start), "_last": cell(end)})
    return whole.withColumn("_at", F.explode(cover_nodes("_first", "_last"))).withColumns({"_level": F.col("_at.level"), "_node": F.col("_at.node")}).drop("_first", "_last", "_at")


def asked_for(points: DataFrame, t: str, width_s: float, levels: list[int]) -> DataFrame:
    """``points`` with a row for each of their ancestors at ``levels``."""
    cell = F.floor(F.col(t) / F.lit(width_s)).cast("long")
    return points.where(F.col(t).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_node", F.call_function("shiftright", cell, F.col("_level")))


def hot_nodes(points: DataFrame, t: str, width_s: float, levels: list[int], keys: list[str]) -> DataFrame | None:
    """keys, _level, _node, _parts of the nodes that over HOT_POINTS points, and over one in HOT_SHARE of all, look up; None if there are none.

    So there are HOT_SHARE of them a level at most, however many points and keys.
    """
    most = max(HOT_POINTS, points.count() // HOT_SHARE)
    cell = F.floor(F.col(t) / F.lit(width_s)).cast("long")
    cells = points.where(F.col(t).isNotNull()).groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    ancestors = cells.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_node", F.call_function("shiftright", F.col("_cell"), F.col("_level")))
    nodes = ancestors.groupBy(*keys, "_level", "_node").agg(F.sum("_n").alias("_n")).where(F.col("_n") > most)
    nodes = nodes.select(*keys, "_level", "_node", F.ceil(F.col("_n") / most).cast("long").alias("_parts"))
    found = nodes.collect()
    return points.sparkSession.createDataFrame(found, nodes.schema) if found else None


def interval_join(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, width_s: float, keys: list[str] | None = None, open_start: bool = True, n_points: int | None = None) -> DataFrame:
    """Pairs of points and intervals with start < t <= end (or start <= t), ``keys`` equal; all in seconds.

    An interval is entered into the nodes of its cover, at most two for each doubling of its length over ``width_s``; a point looks up its ancestors at the levels that
    occur. So an interval over all of time is one row, and a pair meets in one node only. A side that has been counted and is small is broadcast
    (``n_points``: how many points there are, if that is known); else a node that many points look up is dealt out: its points by a hash of the row, its
    intervals to each part. No part has more than some ``HOT_POINTS`` points or one in ``HOT_SHARE`` of all.
    """
    on = [*(keys or []), "_level", "_node"]
    if n_points is not None and n_points * LEVELS <= BROADCAST_ROWS:
        asked, laid = F.broadcast(asked_for(points, t, width_s, list(range(LEVELS)))), laid_out(intervals, start, end, width_s)
    else:
        laid = stored(laid_out(intervals, start, end, width_s), "intervals-laid")
        sizes = dict(laid.groupBy("_level").count().collect())  # a row a level
        levels = sorted(sizes) or [0]
        asked = asked_for(points, t, width_s, levels)
        if sum(sizes.values()) <= BROADCAST_ROWS:
            laid = F.broadcast(laid)
        elif (hot := hot_nodes(points, t, width_s, levels, keys or [])) is not None:
            parts, one = F.coalesce("_parts", F.lit(1).cast("long")), F.lit(1).cast("long")
            asked = asked.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts)).drop("_parts")
            laid = laid.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(one - one, parts - one))).drop("_parts")
            on = [*on, "_part"]
    after = (F.col(t) > F.col(start)) if open_start else (F.col(t) >= F.col(start))
    return asked.join(laid, on).where(after & (F.col(t) <= F.col(end))).drop("_level", "_node", "_part")


def place_in(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, keys: list[str]) -> DataFrame:
    """``points`` with the columns of the interval that holds each (start < t <= end, ``keys`` equal), nulls where none does. Intervals of equal keys must not overlap.

    So cells of one width do: a third of the mean length, whatever the density, which makes some four rows an interval. A point looks up one cell and stays one
    row, so nothing has to be joined back. What is broadcast or dealt out is as in ``interval_join``.
    """
    whole = stored(intervals.where(F.col(end) > F.col(start)), "intervals-apart")
    n, length = whole.agg(F.count("*"), F.sum(F.col(end) - F.col(start))).first()
    width_s = max(length / (3 * n), 1e-3) if n else 1.0
    cell, block = (lambda c: F.floor(F.col(c) / F.lit(width_s)).cast("long")), F.lit(1024).cast("long")
    laid = whole.withColumns({"_first": cell(start), "_last": cell(end)})
    # in blocks, as an interval may lie in very many cells
    laid = laid.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))))
    laid = laid.withColumn("_node", F.explode(F.sequence(F.greatest("_first", F.col("_block") * block), F.least("_last", F.col("_block") * block + block - 1)))).drop("_first", "_last", "_block")
    asked, on = points.withColumn("_node", cell(t)), [*keys, "_node"]
    laid = stored(laid, "intervals-laid")
    if laid.count() <= BROADCAST_ROWS:
        laid = F.broadcast(laid)
    elif (hot := hot_nodes(points, t, width_s, [0], keys)) is not None:
        parts, one = F.coalesce("_parts", F.lit(1).cast("long")), F.lit(1).cast("long")
        asked = asked.join(F.broadcast(hot.drop("_level")), on, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts)).drop("_parts")
        laid = laid.join(F.broadcast(hot.drop("_level")), on, "left").withColumn("_part", F.explode(F.sequence(one - one, parts - one))).drop("_parts")
        on = [*on, "_part"]
    a, b = asked.alias("a"), laid.alias("b")
    inside = (F.col(f"a.{t}") > F.col(f"b.{start}")) & (F.col(f"a.{t}") <= F.col(f"b.{end}"))
    for c in on:
        inside = inside & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, inside, "left").select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in intervals.columns if c not in keys])


def touching(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width_s: float) -> DataFrame:
    """Pairs of intervals of ``left`` and ``right`` with an instant in common, ends included, each pair once: the later of the two starts lies in the other interval."""
    (a, b), (c, d) = left_span, right_span
    valid = lambda x, lo, hi: x.where(F.col(hi) >= F.col(lo))
    left, right = valid(left, a, b), valid(right, c, d)
    inside = interval_join(left, right, a, c, d, width_s, open_start=False, n_points=left.count())
    return inside.unionByName(interval_join(right, left, c, a, b, width_s, n_points=right.count()))


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f
