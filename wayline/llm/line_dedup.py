"""Removal of lines that many sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import discard, stored, table

#: At most so many keys of lines (16 bytes each) are broadcast, after they have been counted.
BROADCAST_KEYS = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def _has_words(stripped: Column, least: int) -> Column:
    """Whether a stripped line has ``least`` words or more; reads no further than these."""
    return F.rlike(stripped, F.lit(r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (least - 1))) if least > 0 else F.lit(True)


def exploded_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line of ``min_words`` words or more: doc_id, digest, site, place, key (16 bytes of the stripped line)."""
    lines = docs.select("doc_id", "digest", "site", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    stripped = _stripped(F.col("line"))
    return lines.where(_has_words(stripped, min_words)).select("doc_id", "digest", "site", "place", F.unhex(F.md5(stripped)).alias("key"))


def _of_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines with one of ``keys``, a written table. Keys that have been counted and are few are broadcast, so no line moves, however
    frequent; more are joined by a shuffle, in which Spark's adaptive plans cut up large parts of one key."""
    return lines.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 10, sigmas: float = 5.0) -> DataFrame:
    """Keys of the lines that stand on ``min_sites`` distinct sites or more, as a written table.

    Lines of one site go first, by the least and the greatest hash (64 bits) of the site. The others get a HyperLogLog sketch of their sites,
    built on each task and merged by the aggregation. An estimate further from the threshold than ``sigmas`` standard
    errors decides; the lines nearer to it get an exact distinct count. A sketch never sees line texts and its size is
    fixed, so a line on every site costs no more than another.
    """
    near = 1.04 / (2 ** (lg_k / 2)) * sigmas
    least = max(1, min_sites)
    hashed = F.xxhash64("site")  # numbers, unlike strings, are aggregated without a sort
    several = lines.groupBy("key").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where(F.lit(least == 1) | (F.col("a") != F.col("b")))
    several = stored(several.select("key"), "lines-several")
    sketched = _of_keys(lines, several).groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    sketched = stored(sketched.where(F.col("sites") >= least * (1 - near) - 1), "lines-sketched")
    sure = sketched.where(F.col("sites") > least * (1 + near) + 1).select("key")
    close = sketched.where(F.col("sites") <= least * (1 + near) + 1).select("key")
    exact = _of_keys(lines, close).groupBy("key").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= least).select("key")
    out = stored(sure.unionByName(exact), "lines-spread")
    discard(several, sketched)
    return out


def removed_lines(docs: DataFrame, min_sites: int, min_words: int) -> DataFrame:
    """doc_id, digest, gone: the places of the lines to remove, of each text that has any."""
    lines = stored(exploded_lines(docs, min_words), "lines-all")  # read up to four times; texts are split and hashed once
    boiler = spread_lines(lines, min_sites)
    gone = stored(_of_keys(lines, boiler).groupBy("doc_id", "digest").agg(F.collect_set("place").alias("gone")), "lines-gone")
    discard(lines, boiler)
    return gone


def without_shared_lines(
    docs: DataFrame, min_sites: int = 8, min_words: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """``docs`` with every line removed that ``min_sites`` distinct sites share, wherever it stands; all columns stay, and n_lines and
    n_removed are added (columns of these names are replaced).

    Lines are compared without white space at their ends; lines under ``min_words`` words are never removed. A null site
    counts as one site of its own; a null text has no lines and stays null. Rows keep their number, repeated ones too; rows that
    share an id but not the text are told apart; an empty table gives an empty result.
    """
    keyed = docs.withColumn("_digest", F.xxhash64(text_col))
    base = keyed.select(F.col(id_col).alias("doc_id"), F.col("_digest").alias("digest"), F.col(text_col).alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"))
    gone = removed_lines(base, min_sites, min_words)
    joined = keyed.alias("t").join(gone.alias("g"), F.col(f"t.{id_col}").eqNullSafe(F.col("g.doc_id")) & (F.col("t._digest") == F.col("g.digest")), "left")
    text = F.col(f"t.{text_col}")
    kept = F.when(F.col("g.gone").isNull(), text).otherwise(F.array_join(F.filter(_lines(text), lambda _, i: ~F.array_contains("g.gone", i)), "\n"))
    counts = [
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_removed"),
    ]
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"t.{c}") for c in docs.columns if c not in ("n_lines", "n_removed")], *counts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT doc_id, text, site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM d),
s AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
w AS (SELECT *, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS words FROM s),
b AS (SELECT bare FROM w WHERE words >= 3 GROUP BY bare HAVING count(DISTINCT site) >= 8),
k AS (SELECT w.*, (w.words >= 3 AND b.bare IS NOT NULL) AS gone FROM w LEFT JOIN b ON w.bare = b.bare)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE count(*) END AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id, text
"""
