"""Quality rules with risk-controlled thresholds (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .exprs import SPACE, UPPER, let, space_words, union_length
from .shared import stored, table

#: Measures of a text, each 0 to 1 and worse the higher; a rule rejects what lies above its cutoff.
MEASURES = ("symbols", "repeats", "dup_lines", "capitals", "bars", "same_words")
#: Cutoffs that are tried, from the mildest; they don't depend on any data.
GRID = tuple(round(0.9 * 0.85**k, 4) for k in range(24))


def repeated_words(words: Column, width: int = 8) -> Column:
    """How many words lie in ``width``-word windows that occur twice or more among ``words``, the first included."""

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(rows: Column) -> Column:
            def twin(s: Column, j: Column) -> Column:
                same = lambda k: F.coalesce(F.get(rows, k)["h"] == s["h"], F.lit(False))
                return F.when(same(j + 1) | ((j > 0) & same(j - 1)), F.struct(s["i"].alias("i"), F.lit(width).alias("n")))

            return union_length(F.sort_array(F.filter(F.transform(rows, twin), lambda x: x.isNotNull())), "i", "n")

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(hashes, count))


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts and measures of each whole text; null texts have none of anything. One scan, no shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = base.select(
        "doc_id",
        "stratum",
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER + "!", ""))).alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "|", ""))).alias("n_bars"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(
            space_words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"), (F.size(w) - F.size(F.array_distinct(w))).alias("same")),
        ).alias("words"),
    )
    n, chars = F.greatest(F.col("words.n"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        "doc_id",
        "stratum",
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.repeat").alias("n_repeat_words"),
        ((F.col("words.n") < 20) | (100 * F.col("words.repeat") > 30 * F.col("words.n"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbols"),
        (F.col("words.repeat") / n).alias("repeats"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_lines"),
        (F.col("n_upper") / chars).alias("capitals"),
        (F.col("n_bars") / n).alias("bars"),
        (F.col("words.same") / n).alias("same_words"),
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exactly, term by term in logarithms; 1 where k reaches the mean."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    zero = F.struct(first.alias("term"), F.exp(first).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, step, lambda acc: acc["total"])
    return F.when((n == 0) | (k >= n * rate), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def controlled_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """One row per stratum with a cutoff for each measure, null where none can be justified.

    Promise: with probability 1 - ``error``, in every stratum together, the rules reject at most a share ``risk`` of the
    good texts. Each measure gets an equal part of ``risk``. A cutoff is tested by the exact binomial probability of as few false
    rejections as the labelled holdout shows, were the true rate its part of the risk. Cutoffs of one measure and stratum
    are tested from the mildest, and stop at the first that fails (fixed-sequence testing needs no correction within);
    across measures and strata ``error`` is divided (Bonferroni).
    """
    part = risk / len(MEASURES)
    good = labels.where(F.col(label_col) == 1).select(F.col(label_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    held = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    false = [F.sum((F.col(m) > t).cast("long")).alias(f"{m}_{j}") for m in MEASURES for j, t in enumerate(GRID)]
    counts = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *false), "rules-counts")
    tests = counts.select(
        "stratum",
        "n",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(j).alias("j"), F.lit(t).alias("cutoff"), F.col(f"{m}_{j}").alias("k")) for m in MEASURES for j, t in enumerate(GRID)])).alias("t"),
    ).select("stratum", "n", "t.*")
    level = F.lit(error) / (F.lit(float(len(MEASURES))) * F.lit(float(max(1, counts.count()))))
    passed = tests.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), part) <= level)
    so_far = W.partitionBy("stratum", "measure").orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    held_up = passed.withColumn("ok", F.min("ok").over(so_far)).where("ok")
    return held_up.groupBy("stratum").agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"max_{m}") for m in MEASURES])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Judge every text: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken.

    A text fails the base under 20 words, or with over 30 % of its words in repeated 8-word windows. Else it is kept
    unless a measure exceeds the cutoff of its stratum (``controlled_cutoffs``); broken lists those measures. A stratum with too few
    labels has no cutoffs and rejects nothing. One row per input row, repeated rows included; null texts have no words
    and fail the base; null strata form one stratum; labels may be empty, repeated or null. Other columns are not read.
    """
    measured = stored(text_measures(docs, id_col, text_col, stratum_col), "rules-measured")
    cutoffs = controlled_cutoffs(measured, labels, risk, error)
    judged = measured.join(cutoffs, "stratum", "left")
    broken = F.filter(F.array(*[F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    return judged.withColumn("broken", broken).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
