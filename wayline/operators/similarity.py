"""Groups of similar items: the first free item leads and takes all later ones that are near it."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.stored import discard, stored

#: Once at most so many pairs are undecided, they are decided in one task.
LAST_PAIRS = 200_000
#: So many of a group's undecided items are gone through in order in the first round, and in any.
FIRST, MOST = 1000, 8192
#: So many of the others are compared with the leaders by one task at a time.
PART = 20_000
#: A row that is shuffled costs as much as so many comparisons of arrays.
ROW_COST = 200


def _met(keyed: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """Pairs (a before b) of rows with o, item and equal ``keys`` that are ``near`` (in terms of x and y), each once."""
    x, y = keyed.withColumnsRenamed({"o": "a", "item": "x"}), keyed.withColumnsRenamed({"o": "b", "item": "y"})
    return x.join(y, keys).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _bands(largest: int, most: int, bits: int = 64) -> tuple[float, int]:
    """How many rows and pairs an item of a group of ``largest`` makes at least, and for how many bands."""
    cost = lambda bands: comb(bands, most) * (1 + largest / 2 ** (bits * (bands - most) / bands))
    return min((cost(bands), bands) for bands in range(most + 1, min(bits, most + 4) + 1))


def hamming_pairs(nodes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """Pairs of 64-bit hashes of a group that differ in ``most`` bits at most.

    The bits are cut into bands. Of more bands than ``most`` some are equal, so pairs meet under one of the choices of that many bands; how many bands there
    are is chosen by the number of rows and pairs that this makes for the largest group.
    """
    n, largest = nodes.groupBy("group").count().agg(F.sum("count"), F.max("count")).first()
    if not n:
        return _met(nodes, ["group"], F.lit(False))
    bands = _bands(largest, most, bits)[1]
    band = [sum(1 << k for k in range(bits * i // bands, bits * (i + 1) // bands)) for i in range(bands)]
    masks = [sum(chosen) for chosen in combinations(band, bands - most)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    choices = F.array(*[F.struct(F.lit(k).alias("k"), F.col("item").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(masks)])
    keyed = nodes.withColumn("c", F.explode(choices)).select("group", "o", "item", "c.k", "c.part")
    return _met(keyed, ["group", "k", "part"], F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most)


def tag_pairs(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs of a group's tag lists (distinct, sorted) that share ``least`` tags or more: such lists meet in one of all but ``least`` - 1 of their rarest tags."""
    tags = nodes.withColumn("tag", F.explode("item"))
    counts = tags.groupBy("group", "tag").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(W.partitionBy("group", "o").orderBy("n", "tag")) <= F.size("item") - least + 1
    prefix = tags.join(counts, ["group", "tag"]).withColumn("in", rarest).where("in").select("group", "tag", "o", "item")
    return _met(prefix, ["group", "tag"], F.size(F.array_intersect("x", "y")) >= least)


def _hashes(items: pd.Series) -> np.ndarray:
    return items.to_numpy(np.int64)


def _directions(items: pd.Series) -> np.ndarray:
    v = np.array(items.tolist(), float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


#: Of each metric: the pairs, if they are found by parts; an item in the form that is compared; whether an item is near an equal one; and, if leaders may be compared with
#: all others: items as an array, which of an array's items are near one, and what an item costs by pairs in a group of some size.
METRICS = {
    "hamming": (hamming_pairs, lambda x: x, lambda x, t: F.lit(True), (_hashes, lambda x, y, t: np.bitwise_count(x ^ y) <= t, lambda n, t: _bands(n, t)[0] if t < 64 else np.inf)),
    "tags": (tag_pairs, lambda x: F.array_sort(F.array_distinct(x)), lambda x, t: F.size(x) >= t, None),
    "cosine": (None, lambda x: F.transform(x, lambda v: v.cast("double")), lambda x, t: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) > 0, (_directions, lambda x, y, t: x @ y >= t, lambda n, t: np.inf)),
}


def first_leaders(pairs: DataFrame, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """Rows (b, lead): the first leader near each item that doesn't lead. ``pairs``: near items (a, b), structs of order and id, a before b.

    An item leads if none of the items before it that it is near to does. In each round those without an undecided item before them lead, and
    those near them are decided; a handful of pairs is left after some rounds, unless items form long chains, and is gone through in order.
    """
    every = stored(pairs, "similar-pairs")
    left, gone, steps = every, [], []
    while (n := left.count()) > last_pairs:
        top = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        led = stored(left.join(top, "a", "left_semi").select("b").distinct(), "similar-led")
        gone.append(led)
        steps.append(left)
        left = stored(left.join(led, "b", "left_anti").join(led.withColumnRenamed("b", "a"), "a", "left_anti"), "similar-left")
    if n:
        flat = left.select(F.col("a.ord").alias("ao"), F.col("a.id").alias("ai"), F.col("b.id").alias("bi"), "b", F.lit(0).alias("all"))

        def decide(rows: pd.DataFrame) -> pd.DataFrame:
            led: set = set()
            for a, b in rows.sort_values(["ao", "ai"])[["ai", "bi"]].itertuples(index=False):
                if a not in led:
                    led.add(b)
            return pd.DataFrame({"bi": list(led)}, dtype=rows["bi"].dtype)

        kind = left.schema["b"].dataType["id"].dataType.simpleString()
        led = flat.drop("b").groupBy("all").applyInPandas(decide, f"bi {kind}")  # LAST_PAIRS rows at most
        gone.append(stored(flat.join(led, "bi").select("b").distinct(), "similar-led"))
    discard(*steps[1:])
    led = gone[0] if gone else every.select("b").limit(0)
    for more in gone[1:]:
        led = led.unionByName(more)
    return every.join(led.withColumnRenamed("b", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("lead"))


def _by_pairs(left: DataFrame, pairs_of, threshold: float, last_pairs: int) -> DataFrame:
    leads = first_leaders(pairs_of(left, threshold), last_pairs)
    return left.join(leads, left["o"] == leads["b"], "left").select("group", "item", F.coalesce("lead", "o").alias("lead"))


def leaders_in_rounds(firsts: DataFrame, metric: str, threshold: float, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """group, item, lead (struct of ord and id) of ``firsts`` (group, o: struct of ord and id, item; a group's items differ).

    In each round the first FIRST undecided items of each group (up to MOST, twice as many each time) are gone through in order, and all others are compared with
    the leaders among these, in parts of PART: the first that is near leads, since later leaders come later. So where many are near, few leaders decide nearly
    all, and no pair is ever a row. Where a round decides less than half of the others and pairs cost less than comparing all, the rest is decided by pairs.
    """
    pairs_of, _, _, (array, near, pair_cost) = METRICS[metric]
    group, id_ = firsts.schema["group"].dataType.simpleString(), firsts.schema["o"].dataType["id"].dataType.simpleString()

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        items, lead, free = array(rows["item"]), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(free):
            hit = near(items, items[0], threshold)
            hit[0] = True
            lead[free[hit]] = free[0]
            items, free = items[~hit], free[~hit]
        return pd.DataFrame({"group": rows["group"], "n": rows["n"], "lead": rows["n"].to_numpy()[lead]})

    def follow(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(heads):
            return pd.DataFrame({"group": [], "id": [], "lead": []})
        heads = heads.sort_values("lead", ignore_index=True)
        items, lead, free = array(rows["item"]), np.full(len(rows), -1), np.arange(len(rows))
        for n, head in zip(heads["lead"].to_numpy(), array(heads["item"]), strict=True):
            hit = near(items, head, threshold)
            if hit.any():
                lead[free[hit]] = n
                items, free = items[~hit], free[~hit]
        return pd.DataFrame({"group": rows["group"], "id": rows["id"], "lead": lead})[lead >= 0]

    left, known, take, steps = firsts, [], FIRST, []
    while True:
        sizes = left.groupBy("group").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
        n, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("size")).first()
        if not n:
            break
        dealt = left
        if largest > take:
            # the first of each part, so that no group is sorted whole
            dealt = left.join(sizes, "group").withColumn("part", F.expr("pmod(xxhash64(o), parts)").cast("int"))
            some = dealt.withColumn("n", F.row_number().over(W.partitionBy("group", "part").orderBy("o"))).where(F.col("n") <= take)
        else:
            some = left
        first = stored(some.withColumn("n", F.row_number().over(W.partitionBy("group").orderBy("o"))).where(F.col("n") <= take).select("group", "o", "item", "n"), "similar-first")
        decided = stored(first.select("group", "n", "item").groupBy("group").applyInPandas(decide, f"group {group}, n int, lead int"), "similar-decided")
        heads = first.join(decided.where("lead = n"), ["group", "n"]).select("group", "lead", "o", "item")
        leads = heads.select("group", "lead", F.col("o").alias("_lead"))
        known.append(first.select("group", "n", "item").join(decided, ["group", "n"]).join(leads, ["group", "lead"]).select("group", "item", F.col("_lead").alias("lead")))
        if largest <= take:
            break
        rest = stored(dealt.join(first.select("group", "o"), ["group", "o"], "left_anti").select("group", "part", "o", "item"), "similar-rest")
        n_rest = rest.count()
        shown = heads.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lead", "item")
        asked = rest.select("group", "part", F.col("o.id").alias("id"), "item").groupBy("group", "part")
        found = stored(asked.cogroup(shown.groupBy("group", "part")).applyInPandas(follow, f"group {group}, id {id_}, lead int"), "similar-followed")
        led = rest.withColumn("id", F.col("o.id")).join(found, ["group", "id"])
        known.append(led.join(leads, ["group", "lead"]).select("group", "item", F.col("_lead").alias("lead")))
        left = stored(rest.withColumn("id", F.col("o.id")).join(found, ["group", "id"], "left_anti").select("group", "o", "item"), "similar-left")
        n_left, largest = left.groupBy("group").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        discard(*steps)
        steps = [left]
        if n_left > n_rest / 2 and pair_cost(largest, threshold) * ROW_COST < largest:
            known.append(_by_pairs(left, pairs_of, threshold, last_pairs))
            break
        take = min(2 * take, MOST)
    out = firsts.select("group", "item", F.col("o").alias("lead")).limit(0)
    for more in known:
        out = out.unionByName(more)
    return out


def greedy_similarity_groups(rows: DataFrame, metric: str, threshold: float, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """id, lead over ``rows`` (group, ord, id, item): within each group, in the order of ord and id, the first free row leads and takes all later free rows that are near it.

    ``metric``: ``hamming`` (64-bit hashes that differ in ``threshold`` bits at most), ``tags`` (lists that share ``threshold`` tags or more) or ``cosine`` (vectors
    of one length with a cosine of ``threshold`` or more). Rows without an item, vectors of length 0 and lists of fewer tags lead themselves. Equal items of a
    group are one item to the search. Hashes and vectors are compared with leaders only, in rounds; lists, and hashes of which few are near, by joins on parts that near ones must share.
    """
    pairs_of, formed, near_itself, by_rounds = METRICS[metric]
    rows = rows.select("group", F.struct("ord", "id").alias("o"), formed(F.col("item")).alias("item"))
    fits = F.coalesce(F.col("item").isNotNull() & near_itself(F.col("item"), threshold), F.lit(False))
    alike = rows.where(fits)
    firsts = stored(alike.groupBy("group", "item").agg(F.min("o").alias("o")), "similar-firsts")
    known = leaders_in_rounds(firsts, metric, threshold, last_pairs) if by_rounds else _by_pairs(firsts, pairs_of, threshold, last_pairs)
    led = alike.join(known, ["group", "item"]).select("o.id", F.col("lead.id").alias("lead"))
    return led.unionByName(rows.where(~fits).select("o.id", F.col("o.id").alias("lead")))
