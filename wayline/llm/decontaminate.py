"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .exprs import ascii_words, union_length
from .shared import stored, table

#: A side of at most so many rows (of a word and a few numbers) is broadcast, after it has been counted.
BROADCAST_ROWS = 200_000


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, gram (the words of each window), len: windows of ``width`` words, or the whole of a shorter item."""
    words = items.select("item_id", ascii_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.least(n, F.lit(width))))).alias("gram"))
    return grams.select("item_id", "gram", F.size("gram").alias("len")).distinct()


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def window_anchors(windows: DataFrame, doc_words: DataFrame) -> DataFrame:
    """Each distinct window's necessary token: its word that is rarest in the documents, with its place in the window.

    A window is contained only if all its words are, so a prefix of one token suffices. The counts are those of all
    documents' words.
    """
    grams = stored(windows.select("gram", "len").distinct(), "decon-grams")
    vocabulary = stored(grams.select(F.explode("gram").alias("word")).distinct(), "decon-words")
    seen = doc_words.join(_bounded(vocabulary, vocabulary.count()), "word").groupBy("word").agg(F.count("*").alias("df"))
    places = grams.select("gram", "len", F.posexplode("gram").alias("place", "word"))
    ranked = places.join(seen, "word").groupBy("gram", "len").agg(F.min(F.struct("df", "word", "place")).alias("a"), F.count("*").alias("known"))
    # a window with a word that no document has is nowhere
    return stored(ranked.where(F.col("known") == F.col("len")).select(F.col("a.word").alias("word"), F.col("a.place").alias("place"), "len").distinct(), "decon-anchors")


def matched_windows(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and occurrence of an item's window: doc_id, digest, n_words, start, len, item_id.

    Documents without any have one row with nulls. Candidate places come from the anchors alone; those that would begin
    before the document or end after it go (positional and length bounds); the rest are verified word by word.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    windows = stored(item_windows(items, width), "decon-windows")
    words = base.select("doc_id", "digest", ascii_words(F.col("text")).alias("words"))
    anchors = window_anchors(windows, words.select(F.explode("words").alias("word")))
    rows = words.select("doc_id", "digest", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    found = rows.join(_bounded(anchors, anchors.count()), "word").withColumn("start", F.col("at") - F.col("place"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    places = found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "len")).alias("places"))
    joined = base.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.digest") == F.col("p.digest")), "left")
    split = joined.select("d.doc_id", "d.digest", "p.places", ascii_words(F.col("d.text")).alias("words"))
    grams = F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.slice("words", p["start"] + 1, p["len"]).alias("gram")))
    candidates = split.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.explode_outer(grams).alias("c"))
    return candidates.select("doc_id", "digest", "n_words", "c.start", "c.gram").join(windows, "gram", "left").select(
        "doc_id", "digest", "n_words", F.when(F.col("item_id").isNotNull() | F.col("len").isNotNull(), F.col("start")).alias("start"), "len", "item_id"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, **columns: str) -> DataFrame:
    """How far each document is made of benchmark items: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    A word inside any occurrence of an item's window of ``width`` consecutive words is hit (an item of fewer words is one
    window). Null and empty texts have no words; items without words match nothing; a null item_id still hits, and is
    not listed. One row per row: rows repeated in full are judged once and returned each; null ids are kept, an empty
    benchmark leaves all documents clean. Other columns are not read.
    """
    hits = matched_windows(docs, benchmark, width, **columns)
    rows = docs.select(F.col(columns.get("id_col", "doc_id")).alias("doc_id"), F.xxhash64(columns.get("text_col", "text")).alias("digest"))
    repeats = stored(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).where("copies > 1").withColumnsRenamed({"doc_id": "id", "digest": "of"}), "decon-repeats")
    span = F.when(F.col("len").isNotNull(), F.struct("start", "len"))
    by_doc = hits.groupBy("doc_id", "digest", "n_words").agg(
        F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    n_hit = union_length(F.col("spans"), "start", "len")
    if not repeats.isEmpty():
        again = by_doc.join(_bounded(repeats, repeats.count()), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
        by_doc = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return by_doc.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids").withColumn("contaminated", F.col("n_hit") > 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT row, n, s, w[s:s + n - 1] AS gram FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT p.row, p.s, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram),
h AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS spot FROM m) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)
"""
