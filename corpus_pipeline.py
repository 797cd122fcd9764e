"""A training-data pipeline: documents are filtered, cleaned, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm.decontaminate import matched_windows
from wayline.llm.exprs import space_words
from wayline.llm.jaccard_join import jaccard_components
from wayline.llm.line_dedup import without_shared_lines
from wayline.llm.packing import pack_documents
from wayline.llm.quality_crf import fit_quality, score_quality
from wayline.llm.shared import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels, predicts to be good."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; those with no word left go."""
    cleaned = without_shared_lines(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.size(space_words(F.col("text"))) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (nulls last), of each group of near duplicates; texts without words link with nothing and all stay.

    Ids may be null or repeated, so rows are numbered; the numbers are written down once, since a later reading could deal the rows otherwise.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("_group").agg(least.alias("_least")).select("_least._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item; rows that share an id, or have none, are judged by their own texts."""
    hit = matched_windows(docs, table(spark, sf_dir, "benchmark")).where("len IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_digest"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in sequences of 4096."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", own_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Neither the classifier nor the packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
