"""Questions to the catalogue: values, searches, selections and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import split_keywords
from ..functions.weather import local_hour, local_time

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|attach|detach|pragma|replace|truncate|vacuum|union|merge|grant)\b|--|/\*|\*/|;", re.I)
KEYWORD_KEYS = ["ia_keywords", "ia_keywords_transcripcion", "ia_keywords_texto", "ia_keywords_sonido", "ia_keywords_video"]


def seeded(ids: Column, seed: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(ids.cast("string"), F.lit("|" + seed)))


def safe_where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a user's predicate holds; one expression only, so no statements, unions or comments (words within quotes are free)."""
    if not predicate or not predicate.strip():
        return df
    if m := _FORBIDDEN.search(re.sub(r"'(?:[^']|'')*'", "''", predicate)):
        raise ValueError(f"not allowed in a predicate: {m[0]}")
    return df.where(F.expr(predicate))


def describe_catalog(tables: dict[str, DataFrame], top_keys: int = 50) -> DataFrame:
    """what, name, n: rows of each table, and the most frequent keys of those with a column ``key`` (ties by name)."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit("table").alias("what"), F.lit(name).alias("name"), "n"))
        if "key" in df.columns:
            parts.append(df.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top_keys).select(F.lit(name).alias("what"), F.col("key").alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_values(df: DataFrame, column: str, limit: int = 50, where: str = "") -> DataFrame:
    """value, n, percent of all rows returned, the most frequent first, at most ``limit`` (1 to 500)."""
    counted = safe_where(df, where).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "value").limit(max(1, min(limit, 500)))
    total = top.agg(F.sum("n").alias("total"))  # of at most 500 rows
    return top.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def distinct_key(metadata: DataFrame, media: DataFrame, key: str, limit: int = 50, where: str = "") -> DataFrame:
    """As ``distinct_values``, of the values under ``key``; the predicate may use the media's columns."""
    chosen = metadata.where(F.col("key") == key).join(media.withColumnRenamed("id", "media_id"), "media_id")
    return distinct_values(chosen, "value", limit, where)


def search_text(media: DataFrame, metadata: DataFrame, keypoints: DataFrame, text: str, limit: int = 30, shown: int = 120) -> DataFrame:
    """id, source, value of rows that contain ``text`` whatever its case: half of ``limit`` from media columns, 30 % from metadata, the rest from keypoints.

    What a source leaves over goes to metadata. Within a source rows come by id and source.
    """
    limit = max(1, min(limit, 200))
    first = max(1, int(limit * 0.5))
    second = max(1, int(limit * 0.3)) if limit >= 3 else min(1, limit - first)
    third = max(0, limit - first - second)
    names = [f.name for f in media.schema if f.dataType.simpleString() == "string"]
    hit = F.contains(F.lower("value"), F.lit(text.lower()))
    wide = media.select("id", *names).unpivot("id", names, "source", "value").where(hit)
    meta = metadata.select(F.col("media_id").alias("id"), F.concat(F.lit("metadata:"), "key").alias("source"), "value").where(hit)
    points = keypoints.select(F.col("media_id").alias("id"), F.concat(F.lit("keypoints:"), "key").alias("source"), "value").where(hit)
    order = ["id", "source", "value"]
    a, c = wide.orderBy(*order).limit(first), points.orderBy(*order).limit(third)
    b = meta.orderBy(*order).limit(limit).withColumn("_r", F.row_number().over(W.orderBy(*order)))  # at most ``limit`` rows
    used = a.unionByName(c).agg(F.count("*").alias("used"))
    b = b.crossJoin(F.broadcast(used)).where(F.col("_r") <= F.lit(limit) - F.col("used")).drop("_r", "used")
    return a.unionByName(b).unionByName(c).select("id", "source", F.substring("value", 1, shown).alias("value"))


def _any_colour(colours: list[str]) -> Column:
    return F.arrays_overlap(F.array("color_1_hex", "color_2_hex", "color_3_hex"), F.array(*map(F.lit, colours)))


def tag_match(metadata: DataFrame, tags: list[str], mode: str, keys: list[str] = KEYWORD_KEYS) -> DataFrame:
    """media_id of media that have any of ``tags`` under ``keys``: as a part of the value ('substring') or as one of its words ('token')."""
    low = [t.strip().lower() for t in tags if t.strip()]
    rows = metadata.where(F.col("key").isin(keys))
    if mode == "substring":
        hit = F.exists(F.array(*map(F.lit, low)), lambda t: F.contains(F.lower("value"), t))
    else:
        hit = F.arrays_overlap(F.transform(split_keywords(F.col("value")), F.lower), F.array(*map(F.lit, low)))
    return rows.where(hit).select("media_id").distinct()


def filtered_media(media: DataFrame, metadata: DataFrame, municipalities=(), provinces=(), subtypes=(), colours=(), tags=(), hours=(), types=("image", "video", "audio", "text"), mode: str = "token", offset_hours: float = -3) -> DataFrame:
    """Media that meet every given choice; within a choice any value does. ``hours`` span a band of whole local hours, both ends included."""
    out = media.where(F.col("type").isin(*types))
    for column, values in (("municipio", municipalities), ("provincia", provinces), ("subtype", subtypes)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if colours:
        out = out.where(_any_colour(list(colours)))
    if hours:
        out = out.where(F.hour(local_time(F.col("timestamp_utc"), offset_hours)).between(min(hours), max(hours)))
    if tags:
        out = out.join(tag_match(metadata, list(tags), mode).withColumnRenamed("media_id", "id"), "id", "left_semi")
    return out


def sample_per_type(media: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` media of each type in a reproducible random order."""
    ranked = media.withColumn("_r", F.row_number().over(W.partitionBy("type").orderBy(seeded(F.col("id"), seed), "id")))
    return ranked.where(F.col("_r") <= n).drop("_r")


def map_points(media: DataFrame, metadata: DataFrame, **choices) -> DataFrame:
    """As ``filtered_media`` for located media, with tags as parts of values."""
    return filtered_media(media.where("latitude IS NOT NULL AND longitude IS NOT NULL"), metadata, mode="substring", **choices)


def loop_candidates(media: DataFrame, metadata: DataFrame, municipalities=(), days=(), weather=(), tags=(), hour_range=None, offset_hours: float = -3) -> DataFrame:
    """Media for a loop, with ``hour``: every given choice holds, and the local hour with its fraction lies in ``hour_range``. Texts without a time count as noon; other media without one are left out."""
    hour = F.coalesce(local_hour(F.col("timestamp_utc"), offset_hours), F.when(F.col("type") == "text", F.lit(12.0)))
    out = media.withColumn("hour", hour)
    if municipalities:
        out = out.where(F.col("municipio").isin(*municipalities))
    for key, values in (("dia_semana", days), ("weather_label", weather)):
        if values:
            have = metadata.where((F.col("key") == key) & F.col("value").isin(*values)).select(F.col("media_id").alias("id"))
            out = out.join(have, "id", "left_semi")
    if tags:
        out = out.join(tag_match(metadata, list(tags), "substring").withColumnRenamed("media_id", "id"), "id", "left_semi")
    return out.where(F.col("hour").between(*hour_range)) if hour_range else out


def active_between(media: DataFrame, start: Column, end: Column) -> DataFrame:
    """Media whose time or span meets [start, end]; at one instant if both are equal."""
    last = F.coalesce("end_time", "timestamp_utc")
    return media.where((F.col("timestamp_utc") <= end) & (last >= start))


def keypoints_sample(keypoints: DataFrame, kind: str, n: int, seed: str) -> DataFrame:
    """``n`` keypoints of a kind in a reproducible random order, with available: how many there are. 'contexto' stands for all keys that begin with 'contexto_'."""
    kind = {"": "transcription", "transcripcion": "transcription"}.get(kind.lower(), kind.lower())
    chosen = keypoints.where(F.col("key").startswith("contexto_") if kind == "contexto" else F.col("key") == kind)
    total = chosen.agg(F.count("*").alias("available"))
    return chosen.orderBy(seeded(F.col("id"), seed), "id").limit(max(1, min(n, 100))).crossJoin(F.broadcast(total))


def texts_for_display(texts: DataFrame, least_words: int, n: int, seed: str, exclude=()) -> DataFrame:
    """``n`` rows of ``texts`` (id, type, folder, text) to show: texts, then audio, then video; those of the chat last; of ``least_words`` words or more, white space collapsed."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = texts.where(~F.col("id").isin(*exclude) if exclude else F.lit(True)).withColumn("text", flat).where(F.size(F.split("text", " ")) >= least_words)
    rank = F.when(F.col("type") == "text", 0).when(F.col("type") == "audio", 1).when(F.col("type") == "video", 2).otherwise(3)
    return rows.orderBy(rank, F.coalesce(F.col("folder") == "telegram", F.lit(False)), seeded(F.col("id"), seed), "id").limit(n)


def media_detail(media: DataFrame, metadata: DataFrame, keypoints: DataFrame, per_child: int, shown: int = 80) -> DataFrame:
    """One row per medium with its first metadata and keypoints, cut, and how many it has of each."""

    def first(children: DataFrame, name: str, order: list[str], value: Column) -> DataFrame:
        ranked = children.withColumn("_r", F.row_number().over(W.partitionBy("media_id").orderBy(*order)))
        shown_ = F.when(F.col("_r") <= per_child, F.struct("_r", value.alias("v")))
        return ranked.groupBy("media_id").agg(F.count("*").alias(f"n_{name}"), F.array_join(F.transform(F.array_sort(F.collect_list(shown_)), lambda x: x["v"]), " | ").alias(name))

    pair = F.concat("key", F.lit("="), F.substring("value", 1, shown))
    m = first(metadata, "metadata", ["key", "value"], pair)
    k = first(keypoints, "keypoints", ["offset_secs", "key", "value"], pair)
    out = media.withColumnRenamed("id", "media_id").join(m, "media_id", "left").join(k, "media_id", "left")
    return out.fillna(0, ["n_metadata", "n_keypoints"]).fillna("", ["metadata", "keypoints"])


def pending_work(media: DataFrame, metadata: DataFrame, keypoints: DataFrame) -> DataFrame:
    """step, total, pending, done of each enrichment, in one pass over media."""
    flags = metadata.groupBy("media_id").agg(F.bool_or(F.col("key").isin(KEYWORD_KEYS)).alias("words"), F.bool_or(F.col("key") == "weather_label").alias("weather")).withColumnRenamed("media_id", "id")
    points = keypoints.select(F.col("media_id").alias("id")).distinct().withColumn("points", F.lit(True))
    rows = media.join(flags, "id", "left").join(points, "id", "left")
    steps = {
        "timestamps": (F.lit(True), F.col("timestamp_utc").isNotNull()),
        "gps": (F.col("timestamp_utc").isNotNull(), F.col("latitude").isNotNull()),
        "geocode": (F.col("latitude").isNotNull(), F.col("municipio").isNotNull()),
        "weather": (F.col("latitude").isNotNull() & F.col("timestamp_utc").isNotNull(), F.coalesce("weather", F.lit(False))),
        "keywords": (F.col("type").isin("image", "video", "audio"), F.coalesce("words", F.lit(False))),
        "keypoints": (F.col("type").isin("video", "audio"), F.coalesce("points", F.lit(False))),
    }
    sums = rows.agg(*[F.count_if(c).alias(f"{s}_total") for s, (c, _) in steps.items()], *[F.count_if(c & d).alias(f"{s}_done") for s, (c, d) in steps.items()])
    each = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"{s}_total").alias("total"), (F.col(f"{s}_total") - F.col(f"{s}_done")).alias("pending"), F.col(f"{s}_done").alias("done")) for s in steps])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def integrity_report(media: DataFrame, metadata: DataFrame) -> DataFrame:
    """measure, n: batches, rows without one, located and not, coordinates of positive sign, repeated hashes, coverage."""
    single = media.agg(
        F.countDistinct("ingest_batch_id").alias("batches"), F.count_if(F.col("ingest_batch_id").isNull()).alias("without_batch"), F.count("latitude").alias("located"),
        F.count_if(F.col("latitude").isNull()).alias("not_located"), F.count_if((F.col("latitude") > 0) | (F.col("longitude") > 0)).alias("positive_sign"), F.count("municipio").alias("geocoded"),
    )
    repeated = media.groupBy("content_hash").count().where("count > 1").agg(F.count("*").alias("repeated_hashes"))
    weather = metadata.where("key = 'weather_label'").agg(F.countDistinct("media_id").alias("with_weather"))
    row = single.crossJoin(repeated).crossJoin(weather)  # one row each
    names = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("x.*")
