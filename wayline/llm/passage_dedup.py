"""Removal of word passages that stand earlier in the corpus, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import arrow_stage, discard, scaled_partitions, stored, table
from .spans import mixed, run_codes, text_bytes, tokens_between, white, word_codes
from .tokens import text_slices

#: Slices that a prefix may have in one subtree; prefixes of more are made longer.
GROUP = 4096
#: Words of slices that a task builds subtrees of at a time.
TREE_WORDS = 1 << 20
_SLICE = 1 << 20
_ROWS = "core long, whole long, doc_id long, tie long, place long"
_RUNS = "doc_id long, tie long, place long"


def suffix_runs(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes whose prefixes end with the same words: owner (text), end (the word where the common gram begins), hi and
    lo (how many words before it the first and the last suffix begin), core (code of the gram), whole (code of all words of the run's windows).

    A suffix is sorted by a prefix of variable length that ends with the least gram (of half the greatest power of two in ``length`` words)
    among its first ``length`` words, the leftmost of equals; so only the suffix's own words choose it, in whatever text it stands.
    """
    cover = 1 << (length.bit_length() - 1)
    gram = max(1, cover // 2)
    lo_byte, hi_byte = tokens_between(white(raw), starts)
    first = np.searchsorted(lo_byte, starts)
    codes = word_codes(raw, lo_byte, hi_byte)
    n, span = len(codes) - length + 1, length - gram + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    grams = run_codes(codes, gram)
    places = np.uint64((1 << 30) - 1)
    least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[span - reach : span - reach + n])
    end = (least & places).astype(np.int64)
    window = np.arange(n)
    inside = window + length <= np.repeat(first[1:], np.diff(first))[:n]
    end, window = end[inside], window[inside]
    new = np.ones(len(end), bool)
    new[1:] = (end[1:] != end[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    p1, p2, end = window[at], window[np.append(at[1:], len(window)) - 1] if len(at) else at, end[at]
    owner = np.searchsorted(first, p1, "right") - 1
    hi, lo = end - p1, end - p2
    covers = run_codes(mixed(codes ^ np.uint64(0xD1342543DE82EF95)), cover)
    whole = ((hi << 16) + lo).astype(np.uint64)
    for k in range(4):
        whole = mixed(whole * np.uint64(0xE7037ED1A0B428DB) + covers[np.minimum(p1 + k * cover, p2 + length - cover)])
    return owner, end - first[owner], hi, lo, grams[end].view(np.int64), whole.view(np.int64)


def packed_place(end: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (end << 32) + (hi << 16) + lo


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in text_slices(batch.column("text"), _SLICE):
                part = batch.slice(x, y - x)
                owner, end, hi, lo, core, whole = suffix_runs(*text_bytes(part.column("text")), length)
                taken = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole), part.column("doc_id").take(taken), part.column("tie").take(taken), pa.array(packed_place(end, hi, lo))], names=[c.split()[0] for c in _ROWS.split(", ")])

    return arrow_stage(docs.select("doc_id", "tie", "text"), run, _ROWS)


def _contents(docs: DataFrame, spots: DataFrame, length: int, single: bool) -> DataFrame:
    """The words of ``spots`` (doc_id, tie, places, cores): a row for each run, or, if ``single``, for each window of it, with a digest for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, tie, text, places, cores in zip(*(batch.column(c) for c in ("doc_id", "tie", "text", "places", "cores")), strict=True):
                words, key = text.as_buffer().to_pybytes().split(), (doc_id.as_py(), tie.as_py())
                for place, core in zip(places.values.to_pylist(), cores.values.to_pylist(), strict=True):
                    end, hi, lo = place >> 32, place >> 16 & 65535, place & 65535
                    if single:
                        rows += [(core, *key, (end << 32) + (k << 16) + k, hashlib.blake2b(b" ".join(words[end - k : end - k + length]), digest_size=16).digest()) for k in range(lo, hi + 1)]
                    else:
                        rows.append((core, *key, place, b" ".join(words[end - hi : end - lo + length])))
                if len(rows) > 50_000:
                    yield _content_batch(rows)
                    rows = []
            yield _content_batch(rows)

    return arrow_stage(docs.join(spots.withColumnsRenamed({"doc_id": "id", "tie": "other"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("other"))).select("doc_id", "tie", "text", "places", "cores"), run, "core long, doc_id long, tie long, place long, words binary")


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["core", "doc_id", "tie", "place", "words"])


def subtree_repeats(slices: list[bytes], hi: np.ndarray, lo: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (slice, words before its gram) that stand earlier too, by the suffix tree of ``slices``.

    Each level of the tree names the nodes of twice the depth by pairs of nodes, down to ``length`` words; an inner node of that depth is a passage
    that repeats. Of its suffixes the earliest by ``order`` (of the slices), then by place, stays; the others are returned. Words are compared as they are.
    """
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s in slices]
    sizes = np.array([len(w) for w in words], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    level = np.concatenate([np.array(w, np.int64) for w in words])
    names, depth = {1: level}, 1
    while 2 * depth <= length:
        names[2 * depth] = _pair_names(names[depth][: max(0, len(names[depth]) - depth)], names[depth][depth:])
        depth *= 2
    count = hi - lo + 1
    owner = np.repeat(np.arange(len(slices)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, node, have = base[owner] + step, None, 0
    for size in sorted(names, reverse=True):
        if length - have >= size:
            here = names[size][at + have]
            node = here if node is None else _pair_names(node, here)
            have += size
    end_before = hi[owner] - step
    sequence = np.lexsort((-end_before, order[owner], node))
    again = np.zeros(len(node), bool)
    again[sequence[1:]] = node[sequence[1:]] == node[sequence[:-1]]
    return owner[again], end_before[again]


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _subtrees(slices: DataFrame, length: int, tree_words: int = TREE_WORDS) -> DataFrame:
    """Runs of repeats. Slices are dealt out by prefix and sorted by it; a task takes the slices of whole prefixes, some ``tree_words`` words together."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        place = rows["place"].to_numpy()
        end, hi, lo = place >> 32, place >> 16 & 65535, place & 65535
        ids = rows["doc_id"].combine_chunks()
        null, doc, tie = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), rows["tie"].to_numpy()
        order = np.empty(len(place), np.int64)
        order[np.lexsort((end, tie, doc, ~null))] = np.arange(len(place))
        which, before = subtree_repeats(rows["words"].to_pylist(), hi, lo, order, length)
        by = np.lexsort((before, which))
        which, before = which[by], before[by]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (before[1:] != before[:-1] + 1)
        at = np.flatnonzero(new)
        upto = np.append(at[1:], len(which)) - 1 if len(at) else at
        taken = pa.array(which[at])
        return pa.RecordBatch.from_arrays([ids.take(taken), pa.array(tie[which[at]]), pa.array(packed_place(end[which[at]], before[upto], before[at]))], names=["doc_id", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            cores = batch.column("core").to_numpy()
            edges = np.flatnonzero(np.append(True, cores[1:] != cores[:-1])) if len(cores) else np.empty(0, np.int64)
            if held and len(cores) and held[-1].column("core")[-1].as_py() == cores[0]:
                edges = edges[1:]
            lo = 0
            for edge in edges.tolist():
                held.append(batch.slice(lo, edge - lo))
                size += (edge - lo) * (length + length // 2)
                lo = edge
                if size >= tree_words:
                    yield found(pa.Table.from_batches(held))
                    held, size = [], 0
            if len(cores) > lo:
                held.append(batch.slice(lo))
                size += (len(cores) - lo) * (length + length // 2)
            held = [b for b in held if b.num_rows]
        if held:
            yield found(pa.Table.from_batches(held))

    return arrow_stage(slices, run, _RUNS)


def repeated_runs(docs: DataFrame, length: int = 20, group: int = GROUP) -> DataFrame:
    """doc_id, tie, place: runs of windows of ``length`` words that also start earlier. ``docs`` has distinct rows (doc_id, tie, text), no text null.

    1. Runs of suffixes with a common end of their prefixes become a row each, with a code for all their words. Of rows with equal codes, counted
    with partial sums on each task, the earliest stands for all: the others' windows stand earlier.
    2. Where rows of one gram differ, the words of those that stand for others are cut out and dealt by the gram to subtrees that fit in memory, whose inner nodes
    of depth ``length`` are the passages that repeat.
    3. Grams with more than ``group`` different rows get longer prefixes: all ``length`` words of each suffix, so that a passage is a group and the
    earliest of it a minimum.
    """
    rows = stored(_runs(docs, length), "passage-rows")
    kinds = stored(rows.groupBy("core", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tie", "place")).alias("one")), "passage-kinds")
    repeated = kinds.where("copies > 1").select("core", "whole", "one")
    found = [stored(rows.join(repeated, ["core", "whole"]).where(~F.struct("doc_id", "tie", "place").eqNullSafe(F.col("one"))).select("doc_id", "tie", "place"), "passage-found")]
    discard(rows)
    unlike = kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    spots = kinds.join(unlike, "core").groupBy("one.doc_id", "one.tie", (F.col("n") > group).alias("long")).agg(F.collect_list("one.place").alias("places"), F.collect_list("core").alias("cores"))
    spots = stored(spots, "passage-spots")
    discard(kinds)
    few, many = (spots.where(F.col("long") == long).drop("long") for long in (False, True))
    slices = stored(_contents(docs, few, length, False), "passage-slices")
    n_bytes = slices.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    n = scaled_partitions(n_bytes, 32 << 20, docs.sparkSession.sparkContext.defaultParallelism)
    found.append(stored(_subtrees(slices.repartition(n, "core").sortWithinPartitions("core"), length), "passage-found"))
    discard(slices)
    if not many.isEmpty():
        windows = stored(_contents(docs, many, length, True).drop("core"), "passage-windows")
        classes = windows.groupBy("words").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tie", "place")).alias("one")).where("copies > 1").drop("copies")
        found.append(stored(windows.join(classes, "words").where(~F.struct("doc_id", "tie", "place").eqNullSafe(F.col("one"))).select("doc_id", "tie", "place"), "passage-found"))
        discard(windows)
    discard(spots)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def passage_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, group: int = GROUP) -> DataFrame:
    """Remove each word that a passage of ``length`` consecutive words covers which also starts earlier: in a row with a smaller id, or
    before in the same text. The first of all copies stays.

    Passages are judged on the texts as given. Returns per input row doc_id, n_words, n_removed, kept_sha256, and kept (the other words,
    joined by a space) if asked for. Null and empty texts have no words. Null ids come first; rows that share an id come in the order of a hash of the text; of
    rows repeated in full one is the first and the others copies of it. Other columns are not read; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    repeats = stored(base.groupBy("doc_id", "tie").count().where("count > 1").withColumnsRenamed({"doc_id": "id", "tie": "other"}), "passage-repeats")
    again = None
    if not repeats.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("other"))
        again = stored(base.join(repeats, same, "left_semi").groupBy("doc_id", "tie", "text").count(), "passage-again")
        base = base.join(repeats, same, "left_anti").unionByName(again.drop("count"))
    runs = repeated_runs(base, length, group).groupBy("doc_id", "tie").agg(F.collect_list("place").alias("runs")).withColumnsRenamed({"doc_id": "id", "tie": "other"})
    kind = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, runs_of in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                if runs_of.is_valid:
                    place = runs_of.values.to_numpy(zero_copy_only=False)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, (place >> 32) - (place >> 16 & 65535), 1)
                    np.add.at(change, (place >> 32) - (place & 65535) + length, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_kept))
            columns = list(zip(*out, strict=True)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kind, strict=True)], schema=pa.schema(kind))

    joined = base.join(runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("other")), "left").select("doc_id", "text", "runs")
    if again is not None:  # copies of a row: all windows stand earlier, so one run goes over the whole text
        n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        whole = F.when(n >= length, F.transform(F.sequence(F.lit(0).cast("long"), n - length), lambda k: F.shiftleft(k, 32)))
        more = again.withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("count"))))
        joined = joined.unionByName(more.select("doc_id", "text", whole.alias("runs")))
    return arrow_stage(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept)


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"), with_kept=False)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT row, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT row, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
k AS (SELECT h, min((row, s)) AS first FROM p GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT row, unnest(range(s, s + 20)) AS place FROM (SELECT p.row, p.s FROM p JOIN k USING (h) WHERE (p.row, p.s) <> first)),
t AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
r AS (SELECT t.row, count(g.place) AS n, string_agg(word, ' ' ORDER BY t.place) FILTER (WHERE g.place IS NULL) AS kept FROM t LEFT JOIN g ON g.row = t.row AND g.place = t.place GROUP BY t.row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (row)
"""
