"""Glossaries: translation of lists and labels, merging by origin, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PRIORITY = {"manual": 3, "db_seed": 2, "auto": 1}


def glossary_translation(lists: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, translated, unknown of ``lists`` (id, words): a whole item's entry first, else word by word; unknown words stay and are listed once, in order.

    The glossary may be of any size; items and words are joined to it.
    """
    g = glossary.select(F.lower("word").alias("_w"), F.col("translation").alias("_t"))
    items = lists.select("id", F.posexplode("words").alias("i", "item")).withColumn("item", F.trim("item")).where("item <> ''")
    whole = items.join(g.withColumnRenamed("_t", "_whole"), F.lower("item") == F.col("_w"), "left").drop("_w")
    words = whole.select("id", "i", "item", "_whole", F.posexplode(F.when(F.col("_whole").isNull(), F.split(F.lower("item"), r"\s+")).otherwise(F.array(F.lower("item")))).alias("j", "word"))
    known = words.join(g, F.col("word") == F.col("_w"), "left")
    single = F.size(F.split("item", r"\s+")) == 1
    shown = F.coalesce("_whole", "_t", F.when(single, F.col("item")).otherwise(F.col("word")))
    missing = F.when(F.coalesce("_whole", "_t").isNull(), F.struct("i", "j", "word"))
    by_item = known.groupBy("id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", shown.alias("s")))), lambda x: x["s"]), " ").alias("s"), F.collect_list(missing).alias("m"))
    lists_of = by_item.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("t"), F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    return lists_of.select("id", F.transform("t", lambda x: x["s"]).alias("translated"), F.array_distinct(F.transform("m", lambda x: x["word"])).alias("unknown"))


def translate_labels(labels: DataFrame, glossary: DataFrame, junk: str = "^$") -> DataFrame:
    """label, translated: the parts of a label between commas and brackets, each by the glossary; parts that match ``junk`` go."""
    parts = labels.select("label", F.filter(F.transform(F.split(F.lower("label"), r"[,()]"), F.trim), lambda p: ~p.rlike(junk)).alias("words"))
    out = glossary_translation(parts.select(F.col("label").alias("id"), "words"), glossary)
    return out.select(F.col("id").alias("label"), F.array_join("translated", ", ").alias("translated"))


def merge_glossary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both (word, translation, origin); of one word the one with the higher origin, the new one if they are equal."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), "origin"), F.lit(0))
    both = old.withColumn("_n", F.lit(0)).unionByName(new.where(F.col("origin").isin(*PRIORITY)).withColumn("_n", F.lit(1)))
    best = both.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.max_by(F.struct("translation", "origin"), F.struct(rank, "_n", "translation")).alias("b"))
    return best.select("word", "b.translation", "b.origin")


def glossary_votes(lists: DataFrame) -> DataFrame:
    """word, translation, votes: majority over ``lists`` (media_id, source, target arrays of equal length, aligned by place); ties to the first media_id and place."""
    aligned = lists.where(F.size("source") == F.size("target")).select("media_id", F.posexplode(F.arrays_zip("source", "target")).alias("i", "p"))
    counted = aligned.groupBy(F.lower(F.trim("p.source")).alias("word"), F.trim("p.target").alias("translation")).agg(F.count("*").alias("votes"), F.min(F.struct("media_id", "i")).alias("first"))
    best = counted.where("word <> '' AND translation <> ''").groupBy("word").agg(F.min_by(F.struct("translation", "votes"), F.struct(-F.col("votes"), "first")).alias("b"))
    return best.select("word", "b.translation", "b.votes")
