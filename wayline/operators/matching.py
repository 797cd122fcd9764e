"""Fuzzy names, repeated passages, pending rows and removal by link."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import fold
from ..plans.stored import stored


def pending(media: DataFrame, derived: DataFrame, keys: list[str], id_col: str = "media_id") -> DataFrame:
    """Media without a row under any of ``keys`` in ``derived``, sentinels of failed attempts included."""
    done = derived.where(F.col("key").isin(keys)).select(F.col(id_col).alias("id"))
    return media.join(done, "id", "left_anti")


def remove_linked(media: DataFrame, children: dict[str, DataFrame], links: DataFrame) -> dict[str, DataFrame]:
    """``media`` and its ``children`` (with media_id) without the media that ``links`` (media_id) names."""
    gone = links.select("media_id").distinct()
    out = {"media": media.join(gone.withColumnRenamed("media_id", "id"), "id", "left_anti")}
    return out | {n: c.join(gone, "media_id", "left_anti") for n, c in children.items()}


#: Two edits touch four pairs of letters at most, which is all that a name of so many letters has.
SHORT = 5


def match_place_names(tags: DataFrame, official: DataFrame) -> DataFrame:
    """tag, official, category, distance: equal once folded (A), else within two edits (B), else all its words among the official name's (C).

    ``tags``: tag, provinces (array); ``official``: name, provinces. B and C want a tag that is used in one province, one of the official
    name's if these are known. Names whose lengths differ by two at most are compared if they share a pair of letters, as any two within two
    edits do if one of them has more than SHORT letters; if neither has, they are compared if they share what is left after two
    deletions at most. Words are compared by equality. The closest wins, then the first by name.
    """
    t = tags.select("tag", F.col("provinces").alias("tp"), fold(F.col("tag")).alias("tn"))
    o = official.select("name", F.col("provinces").alias("op"), fold(F.col("name")).alias("on"))
    exact = t.join(o, F.col("tn") == F.col("on")).select("tag", "name", F.lit("A").alias("category"), F.lit(0).alias("distance"))
    focused = (F.size("op") == 0) | ((F.size("tp") == 1) & F.forall("tp", lambda p: F.array_contains("op", p)))

    def grams(df: DataFrame, name: str) -> DataFrame:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
        return df.withColumn("_g", F.explode(F.array_distinct(pairs)))

    def fewer(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, F.lit(SHORT))))

    def remains(df: DataFrame, name: str) -> DataFrame:
        once = fewer(F.col(name))
        return df.where(F.length(name) <= SHORT).withColumn("_g", F.explode(F.array_distinct(F.concat(F.array(name), once, F.flatten(F.transform(once, fewer))))))

    near = F.abs(F.length("tn") - F.length("on")) <= 2
    some = grams(t, "tn").join(grams(o, "on"), "_g").unionByName(remains(t, "tn").join(remains(o, "on"), "_g"))
    close = some.where(near).drop("_g").distinct().withColumn("distance", F.levenshtein("tn", "on", 2)).where((F.col("distance") > 0) & focused)
    close = close.select("tag", "name", F.lit("B").alias("category"), "distance")
    tw, ow = t.withColumn("_w", F.explode(F.array_distinct(F.split("tn", " ")))), o.where(F.contains("on", F.lit(" "))).withColumn("_w", F.explode(F.array_distinct(F.split("on", " "))))
    held = tw.join(ow, "_w").groupBy("tag", "tn", "tp", "name", "op", "on").agg(F.count("*").alias("n")).where((F.col("n") == F.size(F.array_distinct(F.split("tn", " ")))) & (F.col("tn") != F.col("on")) & focused)
    held = held.select("tag", "name", F.lit("C").alias("category"), F.size(F.split("on", " ")).alias("distance"))
    every = exact.unionByName(close).unionByName(held)
    return every.groupBy("tag").agg(F.min(F.struct("category", F.when(F.col("category") == "C", 0).otherwise(F.col("distance")).alias("d"), "name", "distance")).alias("b")).select("tag", F.col("b.name").alias("official"), "b.category", "b.distance")


def best_offsets(long: np.ndarray, shorts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``long`` each row of ``shorts``, all with their means removed, has the greatest cosine, and that cosine."""
    n = shorts.shape[1]
    s = shorts - shorts.mean(1, keepdims=True)
    windows = np.lib.stride_tricks.sliding_window_view(long, n)
    centred = windows - windows.mean(1, keepdims=True)
    norms = np.sqrt((centred**2).sum(1))[:, None] * np.sqrt((s**2).sum(1))
    scores = np.where(norms > 0, centred @ s.T / np.where(norms > 0, norms, 1), 0.0)
    k = scores.argmax(0)
    return k, scores[k, np.arange(len(shorts))]


def best_offset(long: np.ndarray, short: np.ndarray) -> tuple[int, float]:
    """Where in ``long`` the shorter sequence, both with their means removed, has the greatest cosine, and that cosine."""
    k, score = best_offsets(long, short[None])
    return int(k[0]), float(score[0])


#: Sequences, and values of sequences, that one task compares with so many others at a time; of few sequences, so many blocks are made.
BLOCK, BLOCK_VALUES, LEAST_BLOCKS = 8192, 1 << 19, 8
#: Values of windows, and scores, that are held at once.
HELD = 1 << 22


def _best_pairs(values: list[np.ndarray], ids: np.ndarray, own: np.ndarray, within: bool, least: float, top: int) -> pd.DataFrame:
    """a, b (a before b), offset, similarity: the ``top`` pairs, of ``least`` or more, of sequences in two blocks (``within``: in one).

    For each length all windows of that length in sequences at least as long are brought to mean 0 and norm 1, as are the sequences of that length, and
    multiplied in single precision. What may reach ``least``, or the ``top``-th pair found so far, given that precision's error, is scored again in double precision.
    """
    sizes = np.array([len(v) for v in values])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(values)
    found, floor, waiting = np.empty((0, 4)), least, []

    def unit(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(1, keepdims=True)
        norms = np.sqrt((x**2).sum(1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def settle() -> None:
        """Of each pair the first of the best offsets, then the best pairs."""
        nonlocal found, floor, waiting
        x = np.concatenate([found, *waiting])
        x = x[np.lexsort((x[:, 2], -x[:, 3], x[:, 1], x[:, 0]))]
        x = x[np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])] if len(x) else x
        found, waiting = x[np.lexsort((x[:, 1], x[:, 0], -x[:, 3]))][:top], []
        if len(found) == top:
            floor = found[-1, 3]

    for n in np.unique(sizes):
        windows_of = np.lib.stride_tricks.sliding_window_view(flat, n)
        error = (n + 16) * 2.0**-23
        for side in (0,) if within else np.unique(own):
            short = np.flatnonzero((sizes == n) & (within | (own == side)))
            long = np.flatnonzero((sizes >= n) & (within | (own != side)))
            if not len(short) or not len(long):
                continue
            exact = unit(windows_of[starts[short]])
            counts = sizes[long] - n + 1
            row = np.repeat(long, counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            each = max(1, HELD // n)
            for lo in range(0, len(row), each):
                r, o = row[lo : lo + each], offset[lo : lo + each]
                w = unit(windows_of[starts[r] + o])
                single, few = w.astype(np.float32), max(1, HELD // len(r))
                for k in range(0, len(short), few):
                    s = short[k : k + few]
                    i, j = np.nonzero(single @ exact[k : k + few].astype(np.float32).T >= np.float32(floor - error))
                    # of two of one length the lesser id has the part of the longer
                    other = (ids[r[i]] != ids[s[j]]) & ((sizes[r[i]] > n) | (ids[r[i]] < ids[s[j]]))
                    i, j = i[other], j[other]
                    for at in range(0, len(i), each):
                        x, y = i[at : at + each], j[at : at + each]
                        score = np.round(np.einsum("ij,ij->i", w[x], exact[k + y]), 9)
                        good = score >= floor
                        a, b = ids[r[x[good]]], ids[s[y[good]]]
                        waiting.append(np.stack([np.searchsorted(ids, np.minimum(a, b)), np.searchsorted(ids, np.maximum(a, b)), o[x[good]], score[good]], 1))
                        if sum(map(len, waiting)) > HELD // 64:
                            settle()
            settle()
    a, b = found[:, 0].astype(int), found[:, 1].astype(int)
    return pd.DataFrame({"id_a": ids[a], "id_b": ids[b], "offset": found[:, 2].astype(np.int32), "similarity": found[:, 3]})


def repeated_passages(sequences: DataFrame, least: float = 0.8, seconds: float = 4.0, step_s: float = 0.5, top: int = 20, key: str | None = None) -> DataFrame:
    """id_a, id_b, offset, similarity: the ``top`` pairs of ``sequences`` (id, values: numbers ``step_s`` apart) of which the shorter sounds like a part of the longer.

    All pairs are compared, with ``key`` those of equal keys. The sequences are dealt to blocks, and each pair of blocks goes to a group, so no
    task holds more than two blocks at a time; of each group the ``top`` pairs go on. Similarities have nine decimals; ties go to the lesser ids.
    """
    enough = stored(sequences.where(F.size("values") * step_s >= seconds).select("id", "values", (F.col(key) if key else F.lit(0)).alias("k")), "passages")
    n, n_values = enough.agg(F.count("*"), F.coalesce(F.sum(F.size("values")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK), -(-n_values // BLOCK_VALUES))
    rows = enough.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = rows.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "values")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        values = [np.asarray(v, float) for v in f["values"]]
        return _best_pairs(values, f.id.to_numpy(), f.own.to_numpy(), f.i[0] == f.j[0], least, top)

    # a pair of blocks is seconds of work, so as many tasks as there are cores, rather than as parts are large
    pairs = dealt.repartition(min(blocks * (blocks + 1) // 2, 2000), "k", "i", "j")
    return pairs.groupBy("k", "i", "j").applyInPandas(compare, "id_a long, id_b long, offset int, similarity double").orderBy(F.desc("similarity"), "id_a", "id_b").limit(top)
