"""Media with their metadata in one row, for publishing and for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cut_at_word, split_keywords, strip
from ..functions.weather import local_time


def joined_segments(segments: DataFrame) -> DataFrame:
    """media_id, transcript: texts of all segments in order of their starts."""
    kept = segments.where(F.trim("texto") != "").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("inicio", F.trim("texto").alias("x")))).alias("s"))
    return kept.select("media_id", F.array_join(F.transform("s", lambda x: x["x"]), " ").alias("transcript"))


def wide_metadata(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """One row per medium with a column for each of ``keys``; of a repeated key the least value."""
    return metadata.where(F.col("key").isin(keys)).groupBy("media_id").pivot("key", keys).agg(F.min("value"))


def _words(column: str) -> Column:
    return F.array_join(F.filter(F.array_distinct(F.transform(split_keywords(F.col(column)), lambda w: strip(w, " \t.,;:¿?¡!\"'()[]{}"))), lambda w: w != ""), " ")


def embedding_text(media: DataFrame, metadata: DataFrame, segments: DataFrame, messages: DataFrame | None = None, most: int = 6000) -> DataFrame:
    """media_id, text: transcript, description, keywords of vision, speech and sound, message; joined in this order, cut at a word. Media without any text are left out."""
    keys = ["ia_description", "ia_keywords", "ia_keywords_transcripcion", "ia_keywords_sonido"]
    rows = media.select(F.col("id").alias("media_id")).join(joined_segments(segments), "media_id", "left").join(wide_metadata(metadata, keys), "media_id", "left")
    if messages is not None:
        rows = rows.join(messages.select("media_id", F.trim("text").alias("_message")), "media_id", "left")
    else:
        rows = rows.withColumn("_message", F.lit(None).cast("string"))
    parts = [F.col("transcript"), F.trim("ia_description"), *[F.when(F.col(k).isNotNull(), _words(k)) for k in keys[1:]], F.col("_message")]
    text = F.trim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    return rows.select("media_id", cut_at_word(text, most).alias("text")).where("text <> ''")


def published_media(media: DataFrame, metadata: DataFrame, segments: DataFrame, most: int = 600, offset_hours: float = -3) -> DataFrame:
    """One row per medium: local date, hour, month, year; description (a text's own words first); keywords of its kind, each once whatever its case; transcript cut to ``most``."""
    keys = ["ia_description", "texto_completo", "titulo_seccion", "ia_keywords", "ia_keywords_texto", "ia_keywords_transcripcion", "ia_keywords_sonido", "ia_keywords_video"]
    rows = media.join(wide_metadata(metadata, keys).withColumnRenamed("media_id", "id"), "id", "left").join(joined_segments(segments).withColumnRenamed("media_id", "id"), "id", "left")
    sound = F.concat(split_keywords(F.col("ia_keywords_transcripcion")), split_keywords(F.col("ia_keywords_sonido")))
    words = (
        F.when(F.col("type") == "text", split_keywords(F.col("ia_keywords_texto")))
        .when(F.col("type") == "audio", sound)
        .when(F.col("type") == "video", F.concat(split_keywords(F.col("ia_keywords")), split_keywords(F.col("ia_keywords_video")), sound))
        .otherwise(split_keywords(F.col("ia_keywords")))
    )
    first = F.filter(words, lambda w, i: (F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1) & (w != ""))
    t = local_time(F.col("timestamp_utc"), offset_hours)
    return rows.select(
        "id", "type", "subtype", F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "HH:mm").alias("time"), F.month(t).alias("month"), F.year(t).alias("year"),
        "latitude", "longitude", "municipio", "provincia", "author", "color_1_hex", "color_2_hex", "color_3_hex",
        F.when(F.col("type") == "text", F.coalesce("texto_completo", "ia_description")).otherwise(F.col("ia_description")).alias("description"),
        F.array_join(first, ", ").alias("keywords"), F.substring("transcript", 1, most).alias("transcript"), F.when(F.col("type") == "text", F.col("titulo_seccion")).alias("title"),
    )
