"""An n-gram Jaccard join with count vectors in an R-tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .components import components
from .shared import arrow_stage, discard, stored, table
from .spans import lower_ascii, mixed, text_bytes, word_hashes
from .tokens import text_slices

#: Groups that shingles are hashed into; a set's point has a coordinate for each, its number of shingles there (65535 at most).
GROUPS = 96
#: Counters of the shingle frequencies: a fixed size, whatever the corpus.
COUNTERS = 1 << 18
#: A bucket over so many sets is dealt as pairs of blocks of so many.
BLOCK = 2048
#: What a task verifies at a time: so many shingles of its sets together, each set counted as 500 more.
UNIT = 1 << 20
_LEAF, _FANOUT = 32, 8
#: Bytes of text that a task hashes at a time; its arrays take some fifty times as much.
_SLICE = 1 << 20
#: A table of at most so many rows of ids is broadcast, after it has been counted.
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, ascending, and where each text's begin (one more at the end).

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    raw, starts = text_bytes(texts)
    words, _, _, first = word_hashes(lower_ascii(raw), starts)
    n = np.diff(first)
    factor = np.uint64(0x9FB21C651E98DF25)
    rolled = [np.empty(0, np.uint64)]
    owners = [np.empty(0, np.int64)]
    for size in range(1, width + 1):
        texts_of = np.flatnonzero(n >= width if size == width else n == size)
        if not len(texts_of):
            continue
        counts = n[texts_of] - size + 1
        at = np.repeat(first[texts_of] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * factor + words[at + k]
        rolled.append(mixed(h))
        owners.append(np.repeat(texts_of, counts))
    h, owner = np.concatenate(rolled), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _set_ids(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mixed(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64)


def _vectors(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    counts = np.bincount(owner * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=(len(starts) - 1) * GROUPS)
    return counts.reshape(-1, GROUPS)


def _overlap_bound(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """At most so many shingles are common: the summed minima of the coordinates (65535 stands for all above, see ``_possible``)."""
    return np.minimum(u, v).sum(-1, dtype=np.int64)


def _required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m with Jaccard similarity of ``percent`` / 100."""
    return -(-percent * (n + m) // (100 + percent))


def _least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """At least so many shingles do the prefixes of linked sets of n and m have in common: that of the two which ends first in the common
    order has n - percent * n / 100 + 1 of them, of which the other set lacks n less the required overlap at most."""
    return _required(n, m, percent) + 1 + np.minimum(-percent * n // 100, -percent * m // 100)


def _possible(u, n, v, m, percent: int) -> np.ndarray:
    """Whether sizes and count vectors allow a link."""
    fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (_overlap_bound(u, v) >= _required(n, m, percent))
    return fits | ((u == 65535) & (v == 65535)).any(-1)


class CountTree:
    """An R-tree over count vectors: points, sorted by size and first coordinates, are packed into leaves, these into nodes, and so on up to a root.

    A node has a box (here its greatest coordinates) and the least and greatest size of its points. Two nodes part if the summed minima of
    their boxes stay below what their least sizes require, or if their sizes are too far apart; else their children are compared.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves up
        top, lo, hi, each = self.points, self.sizes, self.sizes, _LEAF
        while not self.levels or len(lo) > 1:
            heads = np.arange(0, len(lo), each)
            top, lo, hi, each = np.maximum.reduceat(top, heads), np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), _FANOUT
            self.levels.append((top, lo, hi))

    def leaf_pairs(self, percent: int) -> Iterator[tuple[int, int]]:
        """Pairs of leaves (the first no later than the second) whose boxes allow a link."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            top, lo, hi = self.levels[level]
            near = (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
            near &= (_overlap_bound(top[a], top[b]) >= _required(lo[a], lo[b], percent)) | ((top[a] == 65535) & (top[b] == 65535)).any(-1)
            a, b = a[near], b[near]
            if level:
                child, below = np.arange(_FANOUT), len(self.levels[level - 1][1])
                x, y = np.broadcast_arrays(a[:, None, None] * _FANOUT + child[:, None], b[:, None, None] * _FANOUT + child)
                real = (x < below) & (y < below) & (x <= y)
                a, b = x[real], y[real]
        yield from zip(a.tolist(), b.tolist(), strict=True)

    def pairs(self, percent: int, labels: list[np.ndarray], sides: np.ndarray | None = None, shared: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For leaf after leaf, pairs of points whose bounds allow a link, that differ in each of ``labels``, and in ``sides`` if given.
        ``shared``: how many shingles of each set's prefix other sets' have too; neither of a pair may have fewer than linked ones must.

        Labels may be changed between one step and the next; leaves whose points all have one label aren't compared.
        """
        for i, j in self.leaf_pairs(percent):
            x, y = self.order[i * _LEAF : (i + 1) * _LEAF], self.order[j * _LEAF : (j + 1) * _LEAF]
            if any((label[x] == label[y[0]]).all() and (label[y] == label[y[0]]).all() for label in labels):
                continue
            u, v = slice(i * _LEAF, i * _LEAF + len(x)), slice(j * _LEAF, j * _LEAF + len(y))
            good = _possible(self.points[u][:, None], self.sizes[u][:, None], self.points[v][None], self.sizes[v][None], percent)
            if shared is not None:
                good &= np.minimum(shared[x][:, None], shared[y][None]) >= _least_common(self.sizes[u][:, None], self.sizes[v][None], percent)
            for label in labels if sides is None else [*labels, sides]:
                good &= label[x][:, None] != label[y][None]
            if i == j:
                good = np.triu(good, 1)
            p, q = np.nonzero(good)
            if len(p):
                yield x[p], y[q]


def _merged(label: np.ndarray, p: int, q: int) -> bool:
    """Give the points labelled as q the label of p; whether the two had different labels."""
    if label[p] == label[q]:
        return False
    label[label == label[q]] = label[p]
    return True


def candidate_links(points: np.ndarray, sizes: np.ndarray, root: np.ndarray, sides: np.ndarray | None, shared: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different roots that the bounds allow: each such pair lies in one tree, and there are fewer links than points."""
    group = np.arange(len(sizes))
    return [(p, q) for x, y in CountTree(points, sizes).pairs(percent, [root, group], sides, shared) for p, q in zip(x.tolist(), y.tolist(), strict=True) if _merged(group, p, q)]


def verified_links(h: np.ndarray, starts: np.ndarray, root: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect sets (runs of ``h``) of different roots, enough of them that all linked sets become connected.

    What the tree's bounds allow is verified by the sets' intersection, unless the two have become connected meanwhile.
    """
    n, out = np.diff(starts), []
    label = np.unique(root, return_inverse=True)[1]
    _, local = np.unique(h, return_inverse=True)
    inside = np.zeros(len(h), bool)
    for x, y in CountTree(np.minimum(_vectors(h, starts), 65535), n).pairs(percent, [label], sides):
        for p in np.unique(x).tolist():
            q = y[x == p]
            q = q[label[q] != label[p]]
            if len(q):
                mine = local[starts[p] : starts[p + 1]]
                inside[mine] = True
                ends = np.cumsum(n[q])
                at = np.repeat(starts[q] - (ends - n[q]), n[q]) + np.arange(ends[-1])
                common = np.add.reduceat(inside[local[at]], ends - n[q], dtype=np.int64)
                inside[mine] = False
                out += [(p, t) for t in q[100 * common >= percent * (n[p] + n[q] - common)].tolist() if _merged(label, p, t)]
    return out


def _sketch_and_sets(docs: DataFrame, width: int) -> DataFrame:
    """Of each row: doc_id, n, sid (the set's hash), point and digest. Of each task: the counters of its shingles, 64 blocks of them."""
    block = COUNTERS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("point", pa.binary()), ("block", pa.int32()), ("digest", pa.int64())])
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_slices(texts.fill_null(""), _SLICE):
                h, starts = shingle_sets(texts.slice(lo, hi - lo), width)
                counts += np.bincount((h >> np.uint64(64 - 18)).astype(np.int64), minlength=COUNTERS)
                n = np.diff(starts)
                points = np.minimum(_vectors(h, starts), 65535).astype("<u2")
                sid = pa.array(_set_ids(h, starts), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), sid, pa.array([p.tobytes() for p in points], pa.binary()), pa.nulls(hi - lo, pa.int32()), batch.column("digest").slice(lo, hi - lo)], schema=schema)
        from pyspark import TaskContext

        rows, task = range(64), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.nulls(64, pa.int64()), pa.array([task] * 64, pa.int64()), pa.nulls(64, pa.int64()), pa.array([counts[k * block : (k + 1) * block].astype("<i8").tobytes() for k in rows], pa.binary()), pa.array(rows, pa.int32()), pa.nulls(64, pa.int64())], schema=schema)

    return arrow_stage(docs, run, "doc_id long, n long, sid long, point binary, block int, digest long")


def shingle_levels(found: DataFrame) -> np.ndarray:
    """For each counter, 0 or, if shingles there are far more frequent than most, 1 and above: a doubling each."""

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), "<i8") for x in group.column("point")], axis=0)
        return pa.table({"block": group.column("block")[:1], "point": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    # tasks are added up 512 at a time, then these sums; COUNTERS numbers come to the driver
    each = found.where("block IS NOT NULL").select("block", F.floor(F.col("n") / 512).alias("n"), "point")
    summed = each.groupBy("block", "n").applyInArrow(added, "block int, point binary").groupBy("block").applyInArrow(added, "block int, point binary").collect()
    counts = np.concatenate([np.frombuffer(r["point"], "<i8") for r in sorted(summed, key=lambda r: r["block"])]) if summed else np.zeros(COUNTERS)
    usual = max(1.0, float(np.median(counts)))
    excess = counts - usual - 6 * np.sqrt(usual) - 8
    return np.where(excess > 0, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def prefix_rows(docs: DataFrame, levels: np.ndarray, percent: int, width: int, salt_over: int) -> DataFrame:
    """token, salt, sid: of each set the shingles that come first, rare before frequent, so many that linked sets must share one.

    Tokens in the most frequent counters get a salt, so that no task has all sets with one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_slices(texts.fill_null(""), _SLICE):
                h, starts = shingle_sets(texts.slice(lo, hi - lo), width)
                sid, n = _set_ids(h, starts), np.diff(starts)
                level = level_of[(h >> np.uint64(64 - 18)).astype(np.int64)]
                owner = np.repeat(np.arange(len(n)), n)
                hot = np.bincount(owner, level > 0, len(n)) > 0
                order = np.arange(len(h))
                mine = np.flatnonzero(hot[owner])
                order[mine] = mine[np.lexsort((h[mine], level[mine], owner[mine]))]
                keep = n - -(-percent * n // 100) + 1
                first = (np.arange(len(h)) - np.repeat(starts[:-1], n)) < np.repeat(keep, n)
                at = order[first]
                token, set_id, lev = h[at].view(np.int64), sid[owner[at]], level[at].astype(np.int64)
                parts = np.maximum(1, (1 << np.minimum(lev, 40)) // salt_over)
                salt = np.where(parts > 1, (mixed(set_id.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt), pa.array(set_id)], names=["token", "salt", "sid"])

    return arrow_stage(docs, run, "token long, salt int, sid long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches again, cut so that no run of equal ``keys`` is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        changes = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        fresh = bool(held) and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys)
        if fresh:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held = [batch.slice(changes[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, salt, sid: of each bucket with two sets or more, or a salted one (salt of 0 and above), its distinct sets with the first of them."""
    last = None  # token, salt, pivot, last sid, whether the pivot's own row is out
    for batch in batches:
        if not batch.num_rows:
            continue
        token, salt, sid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "sid"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        carried = last is not None and (last[0], last[1]) == (token[0], salt[0])
        new[0] = not carried
        group = np.cumsum(new)
        pivots = np.concatenate([[last[2] if carried else 0], sid[new]])
        pivot = pivots[group]
        fresh = new.copy()
        fresh[1:] |= sid[1:] != sid[:-1]
        fresh[0] = not carried or sid[0] != last[3]
        other = fresh & (sid != pivot)
        several = np.bincount(group[other], minlength=group[-1] + 1) > 0
        own = new & (several[group] | (salt >= 0))
        late = carried and not last[4] and several[0]
        keep = other | own
        out = [np.concatenate([[last[0]], token[keep]]), np.concatenate([[last[2]], pivot[keep]]), np.concatenate([[last[2]], sid[keep]])] if late else [token[keep], pivot[keep], sid[keep]]
        done = bool(several[group[-1]]) or bool(salt[-1] >= 0) or (bool(group[-1] == 0) and carried and last[4])
        last = (token[-1], salt[-1], pivot[-1], sid[-1], done)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["token", "pivot", "sid"])


def _bounded_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, GROUPS) for c in ("point_a", "point_b"))
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            yield batch.select(["a", "b", "weight"]).filter(pa.array(_possible(u, n, v, m, percent)))

    return run


def _tree_candidates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["token", "i", "j"]):
            i, j, n, sid, root, own, shared = (rows.column(c).to_numpy() for c in ("i", "j", "n", "sid", "root", "own", "shared"))
            points = np.frombuffer(b"".join(rows.column("point").to_pylist()), "<u2").reshape(-1, GROUPS)
            found = [np.empty((0, 2), np.int64)]
            for lo, hi in _runs(rows, ["token", "i", "j"]):
                links = candidate_links(points[lo:hi], n[lo:hi], root[lo:hi], own[lo:hi] if i[lo] != j[lo] else None, shared[lo:hi], percent)
                found.append(sid[lo:hi][np.array(links, np.int64).reshape(-1, 2)])
            ends = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

    return run


def _runs(rows: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Where each run of equal ``keys`` begins and ends."""
    k = np.stack([rows.column(c).to_numpy() for c in keys])
    cuts = (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(rows)], strict=True))


def _verified(placed: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, width: int, stars: bool) -> DataFrame:
    """Links (a, b) of the sets in each unit, a row of ``placed`` (unit, i, j, sid, root, own) for each set of a unit.

    A unit's task makes the sets again from texts that it is sent once each, and returns fewer links than it has sets: with ``stars``
    those of the unit's own set (that whose sid is ``unit``) with the others, else enough to connect all linked sets of different roots
    (and different ``own`` if i and j differ).
    """
    keys = ["unit", "i", "j"]
    wanted = placed.groupBy("sid").agg(F.collect_list(F.struct(*keys, "root", "own")).alias("places"))
    texts = _texts(wanted, docs, sets)
    rows = arrow_stage(texts, _once, texts.schema).select("sid", "text", F.explode("places").alias("p")).select("p.*", "sid", "text")
    dealt = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, keys):
            runs, found = _runs(rows, keys), [np.empty((0, 2), np.int64)]
            for first, last in text_slices(rows.column("text").combine_chunks(), _SLICE, [lo for lo, _ in runs]):
                part = rows.slice(first, last - first).combine_chunks()
                h, starts = _sets_of(part.column("text").combine_chunks(), width)
                sid, unit, i, j, root, own = (part.column(c).to_numpy() for c in ("sid", *keys, "root", "own"))
                fine = _set_ids(h, starts) == sid  # another text may have the same digest
                fine[1:] &= (sid[1:] != sid[:-1]) | (unit[1:] != unit[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
                for lo, hi in _runs(part, keys):
                    at = lo + np.flatnonzero(fine[lo:hi])
                    if len(at) < 2:
                        continue
                    links = _star_links(h, starts, at, int(np.flatnonzero(sid[at] == unit[lo])[0]), percent) if stars else None
                    if links is None:
                        mine = np.concatenate([h[starts[k] : starts[k + 1]] for k in at])
                        links = verified_links(mine, np.concatenate([[0], np.cumsum(starts[at + 1] - starts[at])]), root[at], own[at] if i[lo] != j[lo] else None, percent)
                    found.append(sid[at][np.array(links, np.int64).reshape(-1, 2)])
            ends = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

    return stored(arrow_stage(dealt, run, "a long, b long"), "jaccard-links")


def _texts(wanted: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (sid and more) with a text that has this set. The ids that choose the texts are broadcast if they have been
    counted and are few, else joined by a shuffle; rows of ``docs`` repeated in full may give a set once for each task."""
    named = stored(wanted.join(sets.select("sid", "doc", F.col("digest").alias("d")), "sid"), "jaccard-wanted")
    few = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return docs.join(few, docs["doc_id"].eqNullSafe(few["doc"]) & (docs["digest"] == few["d"])).select(*wanted.columns, "text")


def _refined(candidates: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, width: int, parts: int) -> DataFrame:
    """token, sid: prefixes of the sets that candidate links name, in the order of how many of these sets really have a shingle.

    The counters of the first order are shared by many shingles and know the frequent ones only, so long texts that share a few passages
    meet there. Here a set's shingles that no other has come first, and most such sets have enough of these to fill their prefix.
    """
    named = candidates.select(F.col("a").alias("sid")).unionByName(candidates.select(F.col("b").alias("sid"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):
            for lo, hi in text_slices(batch.column("text"), _SLICE):
                h, starts = shingle_sets(batch.column("text").slice(lo, hi - lo), width)
                sid = batch.column("sid").slice(lo, hi - lo).to_numpy()
                fine = np.repeat(_set_ids(h, starts) == sid, np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[fine]), pa.array(np.repeat(sid, np.diff(starts))[fine])], names=["token", "sid"])

    tokens = arrow_stage(_texts(named, docs, sets), run, "token long, sid long").repartition(parts, "token").distinct()
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "token").join(sets.select("sid", "n"), "sid")
    of = W.partitionBy("sid")  # at most a text's shingles
    placed = shared.withColumn("r", F.row_number().over(of.orderBy("sets", "token"))).withColumn("alone", F.col("n") - F.count("*").over(of))
    return placed.where(F.col("alone") + F.col("r") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).select("token", "sid")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each sid once a task: rows repeated in full would all go to one unit."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for s in batch.column("sid").to_pylist():
            fresh.append(s not in seen)
            seen.add(s)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, a bounded number of bytes at a time."""
    made = [shingle_sets(texts.slice(lo, hi - lo), width) for lo, hi in text_slices(texts, _SLICE)]
    return np.concatenate([h for h, _ in made]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in made]))])


def _star_links(h: np.ndarray, starts: np.ndarray, at: np.ndarray, hub: int, percent: int) -> list[tuple[int, int]]:
    """Which of the sets ``at`` link with that at ``hub`` among them."""
    mine = h[starts[at[hub]] : starts[at[hub] + 1]]
    out = []
    for k, s in enumerate(at):
        other = h[starts[s] : starts[s + 1]]
        common = int((mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other).sum())
        if k != hub and 100 * common >= percent * (len(mine) + len(other) - common):
            out.append((hub, k))
    return out


def _starred(best: DataFrame, sets: DataFrame) -> DataFrame:
    """Units of a set and those whose best partner it is; a set with many of them has a unit for each UNIT of weight."""
    weighed = best.join(sets.select(F.col("sid").alias("a"), (F.col("n") + 500).alias("w")), "a")
    slots = weighed.groupBy("b").agg(F.ceil(F.sum("w") / UNIT).cast("int").alias("slots"))
    spokes = weighed.join(slots, "b").select(F.col("b").alias("unit"), F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("i"), F.col("a").alias("sid"))
    hubs = spokes.select("unit", "i", F.col("unit").alias("sid")).distinct()
    return spokes.unionByName(hubs).select("unit", "i", F.col("i").alias("j"), "sid", F.col("sid").alias("root"), F.lit(0).alias("own"))


def _clustered(candidates: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Units of the sets that candidate links connect; clusters over UNIT of weight are dealt as pairs of parts.

    A part has sets of one band of sizes, and either none or only such as belong to the cluster's largest root. Sets of bands that aren't
    neighbours can't link, and those of one root need not.
    """
    clusters = components(candidates).select(F.col("node").alias("sid"), F.col("root").alias("unit"))
    sized = clusters.join(sets.select("sid", "n", (F.col("n") + 500).alias("w")), "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sized = stored(sized, "jaccard-clusters")
    main = sized.groupBy("unit", "root").agg(F.sum("w").alias("w")).groupBy("unit").agg(F.max_by("root", F.struct("w", "root")).alias("main"), F.sum("w").alias("all"))
    banded = sized.join(main, "unit").withColumn("whole", F.col("all") <= UNIT)
    banded = banded.withColumn("band", F.when(F.col("whole"), 0).otherwise(F.floor(F.log("n") / math.log(max(1.05, 100 / percent * 1.0001)))).cast("int")).withColumn("kin", ~F.col("whole") & (F.col("root") == F.col("main")))
    parts = banded.groupBy("unit", "band", "kin").agg(F.ceil(F.sum("w") / UNIT).cast("int").alias("slots"))
    placed = banded.join(parts, ["unit", "band", "kin"]).withColumn("slot", F.pmod(F.xxhash64("sid"), F.col("slots")).cast("int"))
    part = F.struct("band", "kin", "slot")
    each = parts.select("unit", "band", "kin", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).select("unit", part.alias("x"))
    other = each.withColumnRenamed("x", "y")
    # parts, not sets, meet here: as many as a cluster's weight has UNITs
    met = each.join(other, "unit").where("abs(x.band - y.band) <= 1 AND NOT (x.kin AND y.kin)")
    met = met.select("unit", F.col("x").alias("mine"), F.xxhash64(F.least("x", "y")).alias("i"), F.xxhash64(F.greatest("x", "y")).alias("j"))
    return placed.select("unit", "sid", "root", part.alias("mine")).join(met, ["unit", "mine"]).select("unit", "i", "j", "sid", "root", F.xxhash64("mine").alias("own"))


def jaccard_links(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", salt_over: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sid: the row's set, null without words), sets (sid, doc: the least id, n) and verified links (a, b) between sets.

    Links are enough to connect all sets that links of Jaccard similarity ``percent`` / 100 or more connect; each has been verified.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    found = stored(_sketch_and_sets(base, width), "jaccard-sets")
    rows = found.where("block IS NULL").select("doc_id", "n", "sid", "point", "digest")
    # the row that a set is made from again: nulls last
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("r")
    sets = rows.where("sid IS NOT NULL").groupBy("sid").agg(least, F.first("n").alias("n"), F.first("point").alias("point"))
    sets = stored(sets.select("sid", "r.doc_id", "r.digest", "n", "point").withColumnRenamed("doc_id", "doc"), "jaccard-distinct")
    tokens = prefix_rows(base.select("text"), shingle_levels(found), percent, width, salt_over)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "sid")
    first = stored(dealt.mapInArrow(_stars, "token long, pivot long, sid long"), "jaccard-members")
    members = _rejoined(first) if salt_over < (1 << 40) else first
    a, b = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("point_a")), sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("point_b"))
    pairs = members.where("sid <> pivot").groupBy(F.greatest("sid", "pivot").alias("a"), F.least("sid", "pivot").alias("b")).agg(F.count("*").alias("weight"))
    bounded = pairs.join(a, "a").join(b, "b").select("a", "b", "weight", "n_a", "n_b", "point_a", "point_b")
    bounded = arrow_stage(bounded, _bounded_pairs(percent), "a long, b long, weight long")
    # first each set's partner with which it shares most of its prefix
    best = stored(bounded.groupBy("a").agg(F.max_by("b", F.struct("weight", "b")).alias("b")), "jaccard-best")
    links = _verified(_starred(best, sets), base, sets, percent, width, stars=True)
    roots = stored(components(links), "jaccard-roots")
    candidates = stored(_bucket_candidates(members, sets, roots, percent, parts), "jaccard-candidates")
    discard(first, best)
    members = stored(_refined(candidates, base, sets, percent, width, parts), "jaccard-members")
    candidates = stored(_bucket_candidates(members, sets, roots, percent, parts), "jaccard-candidates")
    placed = _clustered(candidates, sets, roots, percent)
    links = links.unionByName(_verified(placed, base, sets, percent, width, stars=False))
    return rows.select("doc_id", "n", "sid"), sets.select("sid", "doc", "n"), links


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", salt_over: int = 50_000) -> DataFrame:
    """Groups of texts that links of Jaccard similarity ``percent`` / 100 or more connect: doc_id, n_shingles, component_id.

    A text's set has its distinct ``width``-word shingles (A-Z lower-cased; of a shorter text the whole as one). component_id is the
    smallest doc_id that can be reached by links. Every link between different sets counts and none is missed:

    1. Equal sets are one set. Shingles are ordered from rare to frequent by fixed-size counters over all texts, and each set's
       prefix in that order is dealt by shingle, so linked sets meet in a bucket.
    2. In each bucket all are compared with its first set: sizes and count vectors rule pairs out; each set's likeliest partner is verified. As a rule
       this connects large groups of copies, at a cost in proportion to their size.
    3. Buckets with sets that aren't connected yet index their count vectors in an R-tree. A pair that its bounds allow isn't listed: a bucket
       returns a spanning forest of such pairs. This is done twice: for the sets that such pairs name the shingles' true frequencies are
       counted and the prefixes taken anew. What the second forests connect is a cluster, in which every allowed pair lies.
    4. A cluster's task makes the sets, indexes them alike, verifies what isn't connected yet, and returns a spanning
       forest of the links. Large buckets and clusters are dealt as pairs of parts.

    Null or empty texts link with nothing and are their own component. One row per input row; rows that share an id are told apart by their
    texts but share that id's component only by links; rows with null ids link as others do, and are no component's id unless alone.
    """
    rows, sets, links = jaccard_links(docs, percent, width, id_col, text_col, salt_over)
    reached = sets.select("sid", "doc").join(stored(components(links), "jaccard-roots"), F.col("sid") == F.col("node"))
    least = reached.groupBy("root").agg(F.min("doc").alias("component"))
    known = reached.join(least, "root").select("sid", "component")
    alone = sets.select("sid", "doc").join(known, "sid", "left").select("sid", F.coalesce("component", "doc").alias("component"))
    return rows.join(alone, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _rejoined(members: DataFrame) -> DataFrame:
    """Salted buckets with the same token have a pivot each; a second, small star joins these pivots."""
    pivots = members.groupBy("token").agg(F.min("pivot").alias("p"), F.max("pivot").alias("q")).where("p <> q").select("token")  # in several parts
    several = members.select("token", "pivot").join(pivots, "token", "left_semi").distinct()
    least = several.groupBy("token").agg(F.min("pivot").alias("least"))
    return members.unionByName(several.join(least, "token").where("pivot <> least").select("token", F.col("least").alias("pivot"), F.col("pivot").alias("sid")))


def _bucket_candidates(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) that connect all sets of different roots that share a bucket and that the R-tree's bounds allow to link."""
    known = members.select("token", "sid").distinct().join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    counted = known.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = stored(known.join(counted, "token").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")), "jaccard-buckets")
    each = rows.groupBy("sid").agg(F.count("*").alias("shared")).join(sets.select("sid", "n", "point"), "sid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(each, "sid")
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "root", "n", "shared", "point")
    dealt = rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return arrow_stage(dealt, _tree_candidates(percent), "a long, b long").distinct()


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
