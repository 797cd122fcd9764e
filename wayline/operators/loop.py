"""A selection of media composed into a looped programme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.weather import hour_band
from ..plans.scan import ordered_bucket, streak
from .catalog import loop_candidates

#: Families of ambient events that must hold for so many media in a row.
SUSTAINED = ("viento", "lluvia", "nublado", "despejado", "sol")
LEAST_RUN = 2


def affinity_score(media: DataFrame, keywords: DataFrame, colours: list[str], tags: list[str]) -> DataFrame:
    """``media`` with score: one for each colour slot of a picture among ``colours``, one for each of ``tags`` that its vision keywords (id, value) contain."""
    low = [c.strip().lower() for c in colours if c.strip()]
    slots = [F.coalesce(F.lower(F.trim(c)).isin(*low), F.lit(False)).cast("int") for c in ("color_1_hex", "color_2_hex", "color_3_hex")] if low else [F.lit(0)]
    named = [F.coalesce(F.contains(F.lower("_words"), F.lit(t.strip().lower())), F.lit(False)).cast("int") for t in tags if t.strip()] or [F.lit(0)]
    out = media.join(keywords.select("id", F.col("value").alias("_words")), "id", "left")
    return out.withColumn("score", F.when(F.col("type") == "image", sum(slots[1:], slots[0])).otherwise(0) + sum(named[1:], named[0])).drop("_words")


def select_for_loop(media: DataFrame, metadata: DataFrame, hours: list[int], colours: list[str] = (), tags: list[str] = (), **choices) -> DataFrame:
    """Candidates with hour and score, by hour, then the best score, then id. Tags that leave no medium are dropped as a filter (they still count for the score)."""
    keywords = metadata.where("key = 'ia_keywords'").groupBy(F.col("media_id").alias("id")).agg(F.min("value").alias("value"))
    band = hour_band(hours)
    chosen = loop_candidates(media, metadata, tags=tags, hour_range=band, **choices)
    if tags:
        found = chosen.agg(F.count("*").alias("_found"))  # one row
        without = loop_candidates(media, metadata, hour_range=band, **choices).crossJoin(F.broadcast(found)).where("_found = 0").drop("_found")
        chosen = chosen.unionByName(without)
    return affinity_score(chosen, keywords, list(colours), list(tags)).orderBy("hour", F.desc("score"), "id")


def loop_segments(hours: list[int], seconds: float) -> list[tuple[int, float, float, float, float]]:
    """i, first hour, hours of the arc, start and length in the loop: an arc between each two chosen hours; one that doesn't go forward passes midnight."""
    if len(hours) < 2 or seconds <= 0:
        raise ValueError("a loop needs two hours and a positive length")
    part = seconds / (len(hours) - 1)
    return [(i, float(a), float(b - a if b > a else 24 + b - a), i * part, part) for i, (a, b) in enumerate(zip(hours, hours[1:], strict=False))]


def position_in_loop(items: DataFrame, hours: list[int], seconds: float, slack: float = 1e-6) -> DataFrame:
    """``items`` (with hour, 0 to under 24) that lie in an arc, with seg_i and t_loop: the first arc that holds the hour, and its share of that arc's time."""
    arcs = items.sparkSession.createDataFrame(loop_segments(hours, seconds), "_i int, _from double, _arc double, _start double, _length double")
    # at most 23 arcs: an array in each row instead of a join
    listed = F.broadcast(arcs.agg(F.array_sort(F.collect_list(F.struct("_i", "_from", "_arc", "_start", "_length"))).alias("_arcs")))

    def at(a: Column) -> Column:
        h = F.when((F.col("hour") < a["_from"]) & (a["_from"] + a["_arc"] >= 24), F.col("hour") + 24).otherwise(F.col("hour"))
        f = (h - a["_from"]) / a["_arc"]
        return F.when(f.between(-slack, 1 + slack), F.struct(a["_i"].alias("i"), (a["_start"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)) * a["_length"]).alias("t")))

    placed = items.where((F.col("hour") >= 0) & (F.col("hour") < 24)).crossJoin(listed).withColumn("_p", F.get(F.filter(F.transform("_arcs", at), lambda x: x.isNotNull()), F.lit(0)))
    return placed.where("_p IS NOT NULL").withColumns({"seg_i": F.col("_p.i"), "t_loop": F.col("_p.t")}).drop("_arcs", "_p")


def ambient_conditions() -> list[tuple[str, str, Column]]:
    """family, text and condition over sun_elevation, secs_since_noon, twilight_period, temp_c, wind_kmh, precip_mm, cloud_pct, code."""
    c = F.col
    cloudy = F.when(c("cloud_pct") >= 70, True).when(c("cloud_pct") <= 20, False).otherwise(c("code") == 3)
    clear = F.when(c("cloud_pct") <= 20, True).when(c("cloud_pct") >= 70, False).otherwise(c("code").isin(0, 1))
    day = F.coalesce("twilight_period", F.lit("")).isin("dia", "")
    # fixed values: families, their texts and bounds
    return [
        ("alba", "Salió el sol", c("sun_elevation").between(0, 3)),
        ("mediodia", "Es el mediodía", F.abs("secs_since_noon") <= 900),
        ("calor", "Hace calor", c("temp_c") > 30),
        ("frio", "Hace frío", c("temp_c") < 10),
        ("viento", "Hay mucho viento", c("wind_kmh") > 40),
        ("lluvia", "Está lloviendo", c("precip_mm") > 1),
        ("nublado", "Está nublado", cloudy),
        ("despejado", "Cielo despejado", clear),
        ("sol", "Pega el sol", clear & (c("temp_c") > 28) & (c("sun_elevation") > 20) & day),
        ("noche", "Es la noche", c("twilight_period").isin("noche", "crepuculo_astronomico", "crepuculo_nautico")),
    ]


def ambient_events(media: DataFrame, order: list[str] | None = None) -> DataFrame:
    """id, hour, family, text: what can be felt at each medium in order (hour and id, as a rule); each family once per whole hour, the first time. Wind, rain, clouds,
    clear sky and strong sun count from the second medium in a row on."""
    order = order or ["hour", "id"]
    rows, bucket = media, ordered_bucket(media, order)
    for family, _, condition in ambient_conditions():
        on = F.coalesce(condition, F.lit(False))
        rows = streak(rows, bucket, order, f"_r_{family}", on) if family in SUSTAINED else rows.withColumn(f"_r_{family}", F.when(on, LEAST_RUN).otherwise(0))
    listed = F.array(*[F.when(F.col(f"_r_{f}") >= LEAST_RUN, F.struct(F.lit(f).alias("family"), F.lit(t).alias("text"))) for f, t, _ in ambient_conditions()])
    events = rows.select("id", "hour", *[o for o in order if o not in ("id", "hour")], F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("e")).select("*", "e.*").drop("e")
    first = events.groupBy("family", F.floor("hour").alias("_h")).agg(F.min_by(F.struct("id", "hour", "text"), F.struct(*order)).alias("x"))
    return first.select("x.id", "x.hour", "family", "x.text")


def loop_spec(media: DataFrame, events: DataFrame, hours: list[int], seconds: float) -> DataFrame:
    """kind, id, seg_i, t_loop, text of all media (by their type, videos all around apart) and events that the loop holds, in its order."""
    kind = F.when((F.col("type") == "video") & (F.col("subtype") == "360"), "video360").otherwise(F.col("type"))
    m = position_in_loop(media, hours, seconds).select(kind.alias("kind"), "id", "seg_i", "t_loop", F.lit("").alias("text"))
    e = position_in_loop(events, hours, seconds).select(F.lit("event").alias("kind"), "id", "seg_i", "t_loop", "text")
    return m.unionByName(e).orderBy("t_loop", "kind", "id")


def nested_spec(spec: DataFrame, page: int = 1000) -> DataFrame:
    """kind, page, n, items: each kind's items in order, ``page`` of them a row, as for a JSON file; pages count from 0.

    Items are dealt by ranges of their order; a page is cut from consecutive items of one range, so no task has all items of a kind and only
    a range's last page may be shorter.
    """
    order = ["kind", "t_loop", "id"]
    ranged = spec.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    k = F.row_number().over(W.partitionBy("kind", "_part").orderBy(*order[1:])) - 1
    paged = ranged.withColumn("_k", F.floor(k / page))
    items = F.array_sort(F.collect_list(F.struct("t_loop", "id", "seg_i", "text")))
    rows = paged.groupBy("kind", "_part", "_k").agg(F.count("*").cast("long").alias("n"), items.alias("items"))
    # a row for each page: all of a kind's are few
    number = F.row_number().over(W.partitionBy("kind").orderBy("_part", "_k")) - 1
    return rows.withColumn("page", number).select("kind", "page", "n", "items")


def timeline(media: DataFrame) -> DataFrame:
    """All media by day, time and id; those without a time first. A range-partitioned sort."""
    return media.orderBy(F.col("timestamp_utc").asc_nulls_first(), "id")
