"""Ranked lexical search by NRA: impact-sorted lists are read in sequence, and each document's score lies in an interval that closes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .exprs import ascii_words
from .shared import arrow_stage, discard, stored, table

#: Items are searched for in blocks of so many terms, twice as many at most, if no single item has more; bounds what tasks are sent.
BLOCK_TERMS = 400_000
#: Documents and postings that a task holds at a time, as a part of the index with its own impact-sorted lists.
PART_DOCS, PART_POSTINGS = 8192, 1 << 20
#: How many entries of each list are read first; every later read is four times as long.
FIRST_READ = 128
#: One document in so many, by a hash, is searched first, to learn scores below which no other document need be reported.
FIRST_WAVE = 16

#: Bytes of terms, A-Z in lower case; others become blanks.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[list]:
    """Rows (item_id, terms) of one block of items after another; every block's size is known before it is fetched."""
    size = F.size("terms")
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_terms)
    while blocks:
        cut = items.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
        over = cut.groupBy("block").agg(F.sum(size).alias("n"), F.count("*").alias("items")).where((F.col("n") > 2 * block_terms) & (F.col("items") > 1))
        if over.isEmpty():
            break
        blocks *= 2
    for k in range(blocks):
        rows = cut.where(F.col("block") == k).select("item_id", "terms").collect()
        if rows:
            yield rows


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), terms and tfs (numbers of those of ``terms`` that it holds, and how often); documents without any term have no row."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            ids, n, found, often, starts = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                if words:
                    counts = Counter(words)
                    held = counts.keys() & numbers.keys()
                    ids.append(doc_id.as_py())
                    n.append(len(words))
                    found += [numbers[w] for w in held]
                    often += [counts[w] for w in held]
                    starts.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return arrow_stage(docs.where("text IS NOT NULL").select("doc_id", "text"), run, "doc_id long, n long, terms array<int>, tfs array<int>")


class ImpactLists:
    """Part of the index: for each term the documents that hold it, by falling impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, k: int, floor: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in this part) and full scores of the best for ``terms``: all that can be among the ``k`` best, those that tie with the
        last included, of scores above 0 and not below ``floor``.

        Lists are read in step, never by document. What has been read of a document is its score's lower bound; its upper bound adds, for
        every list that it wasn't met in, the impact read there last. The reading ends when no document outside can reach the k-th lower bound, and
        the two bounds of all that could be among the best are equal.
        """
        at, end = self.starts[terms], self.starts[terms + 1]
        at, end = at[at < end], end[at < end]
        lower = np.zeros(self.n_docs, np.int64)
        met = np.zeros((len(at), self.n_docs), bool)
        alive, closed, read = np.ones(self.n_docs, bool), False, first_read
        last = self.impact[at]
        while True:
            bar = max(floor, 1, int(np.partition(lower, -k)[-k]) if self.n_docs >= k else 0)
            beyond = int(last.sum())
            closed = closed or beyond < bar
            if closed:
                inside = np.flatnonzero(alive & (lower + beyond >= bar))
                upper = lower[inside] + last @ ~met[:, inside]
                kept = upper >= bar
                inside, upper = inside[kept], upper[kept]
                if (upper == lower[inside]).all():
                    return inside, upper
                alive[:] = False
                alive[inside] = True
            size = np.minimum(end - at, read)
            entries = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            lists, docs = np.repeat(np.arange(len(at)), size), self.doc[entries]
            if closed:
                wanted = alive[docs]
                entries, lists, docs = entries[wanted], lists[wanted], docs[wanted]
            np.add.at(lower, docs, self.impact[entries])
            met[lists, docs] = True
            at = at + size
            last = np.where(at < end, self.impact[np.minimum(at, len(self.impact) - 1)], 0)
            read *= 4


def _best_of_parts(counts: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_all: int, n_terms_all: int, k: int, floors: np.ndarray) -> DataFrame:
    """item (its place in the block), doc_id, score: the ``k`` best of each task's documents, and of scores not below ``floors``."""
    sent = counts.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = sent.value
        floors = floors.copy()
        best: list[tuple | None] = [None] * len(items)  # ids, are they null, scores

        def search(ids: np.ndarray, null: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * n * n_all) // n_terms_all
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            held = impact > 0
            lists = ImpactLists(term[held], doc[held], impact[held], len(ids), len(weights))
            for i, terms in enumerate(items):
                docs, scores = lists.best(terms, k, int(floors[i]))
                if not len(docs):
                    continue
                have = (ids[docs], null[docs], scores)
                if best[i] is not None:
                    have = tuple(np.concatenate(x) for x in zip(best[i], have, strict=True))
                order = np.lexsort((have[0], ~have[1], -have[2]))[:k]
                best[i] = tuple(x[order] for x in have)
                if len(order) == k:
                    floors[i] = max(floors[i], best[i][2][-1])

        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            sizes = np.diff(np.asarray(terms.offsets)).astype(np.int64)
            term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, n = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(ids):
                hi = min(max(lo + 1, int(np.searchsorted(upto, upto[lo] + PART_POSTINGS, "right")) - 1), lo + PART_DOCS, len(ids))
                own = slice(upto[lo], upto[hi])
                search(ids[lo:hi], null[lo:hi], n[lo:hi], sizes[lo:hi], term[own], tf[own])
                lo = hi
        for i, found in enumerate(best):
            if found is not None:
                ids, null, scores = found
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=null), pa.array(scores)], names=["item", "doc_id", "score"])

    return arrow_stage(counts.select("doc_id", "n", "terms", "tfs"), run, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` documents with the highest scores for each item: item_id, rank from 1, doc_id, score. Documents of score 0 are never among them.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Equal scores go by ascending doc_id, null ids
    first. Null and empty texts have no terms. Rows of ``docs`` repeated in full rank one after the other; rows of ``items`` repeated in full
    are one item, rows that share an id but not the text are ranked each; an item that finds nothing has no row. Other columns are not read.

    All documents are counted, by one pass over the texts for each block of items (one block, unless the items have some 400,000 terms). Tasks
    hold parts of the index as impact-sorted lists and search each by NRA for all items of the block; only their best leave a task. The
    scores that a first wave of documents reaches hold for the rest as a floor, so what tasks report doesn't grow with their number.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    asked = stored(asked.select("item_id", F.array_distinct(ascii_words(F.col("text"))).alias("terms")).where(F.size("terms") > 0), "search-items")
    found = []
    for rows in _item_blocks(asked, block_terms):
        names = sorted({t for r in rows for t in r["terms"]})
        numbers = {t.encode(): i for i, t in enumerate(names)}
        sought = [np.array([numbers[t.encode()] for t in r["terms"]], np.int64) for r in rows]
        counts = stored(term_counts(base, numbers).withColumn("wave", F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_WAVE)) == 0), "search-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            discard(counts)
            continue
        df = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # as many rows as the block has terms
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))], np.int64)
        search = lambda part, floors: _best_of_parts(part, sought, weights, n_docs, n_terms, k, floors)  # noqa: B023, E731
        first = stored(search(counts.where("wave"), np.zeros(len(rows), np.int64)), "search-first")
        floors = np.zeros(len(rows), np.int64)
        for item, score in _ranked(first, k).where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block at most
            floors[item] = score
        rest = stored(search(counts.where("NOT wave"), floors), "search-rest")
        discard(counts)
        block = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found.append(_ranked(first.unionByName(rest), k).join(F.broadcast(block), "item").select("item_id", "rank", "doc_id", "score"))
    out = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for more in found:
        out = out.unionByName(more)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item, ranked; first within shares of the rows, so that no task gets all rows of an item, however many tasks found some."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    shares = W.partitionBy("item", "share").orderBy(*order)
    some = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= k).drop("rank", "share")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT count(*) AS all_docs, sum(len(words))::BIGINT AS all_terms FROM w WHERE len(words) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, unnest(terms) AS term FROM i),
p AS (SELECT row, doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, term),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * all_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
r AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item, item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) <= 50
"""
