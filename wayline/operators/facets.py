"""Counts over the catalogue: facets, tags, colours, totals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import SEGMENTS, fold, reliable_segments, split_keywords
from ..functions.weather import WEEKDAYS
from .catalog import KEYWORD_KEYS


def weighted(counts: DataFrame, digits: int = 3) -> DataFrame:
    """value, freq with weight: freq over the greatest one."""
    top = counts.agg(F.max("freq").alias("_top"))
    return counts.crossJoin(F.broadcast(top)).select("value", "freq", F.round(F.col("freq") / F.greatest(F.col("_top"), F.lit(1)), digits).alias("weight"))


def facet_counts(media: DataFrame, metadata: DataFrame, group: str) -> DataFrame:
    """value, freq, weight of 'hours' (UTC, all 24), 'municipalities', 'colours' (first slot), 'weekdays' (Monday first), 'weather'; the others in order without case and accents."""
    count = lambda df, c: df.where(c.isNotNull() & (c.cast("string") != "")).groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("freq"))
    if group == "hours":
        seen = count(media, F.date_format("timestamp_utc", "HH:00"))
        hours = media.sparkSession.range(24).select(F.format_string("%02d:00", "id").alias("value"))
        return weighted(hours.join(seen, "value", "left").fillna(0, ["freq"])).orderBy("value")
    if group == "weekdays":
        rows = weighted(count(metadata.where("key = 'dia_semana'"), F.col("value")))
        place = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower("value"))
        return rows.orderBy(F.when(place > 0, place).otherwise(99), fold(F.col("value")))
    source = {"municipalities": (media, F.col("municipio")), "colours": (media, F.col("color_1_hex")), "weather": (metadata.where("key = 'weather_label'"), F.col("value"))}[group]
    return weighted(count(*source)).orderBy(fold(F.col("value")), "value")


def tag_facet(metadata: DataFrame, keys: list[str] = KEYWORD_KEYS, ignore: list[str] = (), sensitive: list[str] = (), quarter: bool = True, most: int = 200) -> DataFrame:
    """value, freq, weight of the most frequent tags: a quarter of them, ``most`` at most (or simply the first ``most``), in alphabetic order.

    Tags of up to two letters go, and those that contain any of ``ignore`` or are one of ``sensitive``. Ties are cut by tag.
    """
    tags = metadata.where(F.col("key").isin(keys)).select(F.explode(F.transform(split_keywords(F.col("value")), lambda x: F.lower(F.trim(x)))).alias("value"))
    bad = [F.contains("value", F.lit(i)) for i in ignore] + ([F.col("value").isin(*sensitive)] if sensitive else [])
    kept = tags.where((F.length("value") > 2) & ~(F.greatest(*bad, F.lit(False)) if bad else F.lit(False)))
    counted = kept.groupBy("value").agg(F.count("*").alias("freq"))
    n = counted.agg(F.count("*").alias("_n"))
    bound = F.least(F.greatest(F.lit(1), F.floor((F.col("_n") + 3) / 4)), F.lit(most)) if quarter else F.lit(most)
    # ``most`` rows leave the top-k before the row numbers are given
    first = counted.orderBy(F.desc("freq"), "value").limit(most).withColumn("_r", F.row_number().over(W.orderBy(F.desc("freq"), "value")))
    return weighted(first.crossJoin(F.broadcast(n)).where(F.col("_r") <= bound).select("value", "freq")).orderBy(fold(F.col("value")), "value")


def tag_cloud(keywords: DataFrame, limit: int, stop: list[str] = ()) -> DataFrame:
    """value, freq, weight of the ``limit`` most frequent tags of ``keywords`` (keywords: comma lists): letters, blanks and hyphens only, three bytes or more, not in ``stop``; phrases that occur once go."""
    clean = F.trim(F.regexp_replace(F.lower(F.trim("k")), r"[^a-záéíóúüñ\s-]", ""))
    tags = keywords.select(F.explode(F.split("keywords", ",")).alias("k")).select(clean.alias("value")).where((F.octet_length("value") >= 3) & ~F.col("value").isin(*stop, ""))
    counted = tags.groupBy("value").agg(F.count("*").alias("freq")).where((F.col("freq") > 1) | ~F.contains("value", F.lit(" ")))
    return weighted(counted.orderBy(F.desc("freq"), "value").limit(limit), 2)


def colour_slot_counts(media: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """colour, total over the three slots, hex: its canonical code, grey-blue for unknown names."""
    slots = media.select("id", "color_1_hex", "color_2_hex", "color_3_hex").unpivot("id", ["color_1_hex", "color_2_hex", "color_3_hex"], "slot", "colour").where("colour IS NOT NULL")
    known = F.create_map(*[F.lit(x) for kv in (canonical or {"": ""}).items() for x in kv])
    return slots.groupBy("colour").agg(F.count("*").alias("total")).withColumn("hex", F.coalesce(F.try_element_at(known, "colour"), F.lit("#607d8b")))


def catalog_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """what, n: rows of each table, and media by type."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, df in tables.items()]
    parts.append(tables["media"].groupBy(F.concat(F.lit("type:"), "type").alias("what")).agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batches(media: DataFrame) -> DataFrame:
    return media.where("ingest_batch_id IS NOT NULL").groupBy("ingest_batch_id").agg(F.min("timestamp_utc").alias("first"), F.count("*").alias("n")).orderBy(F.desc("ingest_batch_id"))


def daily_distribution(media: DataFrame) -> DataFrame:
    return media.groupBy(F.to_date("timestamp_utc").alias("day")).agg(F.count("*").alias("n"))


def sound_tags(windows: DataFrame, top: int = 5, least: float = 0.15, excluded: list[str] = ()) -> DataFrame:
    """media_id, label, probability, rank: a label's probabilities summed over a medium's windows and divided by their number; excluded labels go first."""
    n = windows.groupBy("media_id").agg(F.countDistinct("window").alias("_n"))
    kept = windows.where(~F.col("label").isin(*excluded)) if excluded else windows
    mean = kept.groupBy("media_id", "label").agg(F.sum("prob").alias("_s")).join(n, "media_id").withColumn("probability", F.col("_s") / F.col("_n"))
    ranked = mean.where(F.col("probability") >= least).withColumn("rank", F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("probability"), "label")))
    return ranked.where(F.col("rank") <= top).select("media_id", "label", "probability", "rank")


def dominant_colours(cells: DataFrame, n: int = 3, columns: int = 4, rows: int = 4) -> DataFrame:
    """media_id, rank, hex: a picture's ``n`` dominant colours from histograms of its cells (media_id, cell, hex, freq).

    A colour's frequency, cells at the centre weighing more, times the square of how few cells have it, times its saturation against the
    picture's greatest. Greys and near-blacks are passed over once a real colour is chosen, and used again, then #808080, to fill up.
    """
    from ..functions.colour import channel, hsv_saturation

    cx, cy = (columns - 1) / 2, (rows - 1) / 2
    dx, dy = (F.col("cell") % columns - cx) / max(1.0, cx), (F.floor(F.col("cell") / columns) - cy) / max(1.0, cy)
    weight = F.greatest(F.lit(0.3), 1 - F.sqrt(dx * dx + dy * dy) * 0.7)
    rgb = [channel(F.col("hex"), k) for k in range(3)]
    # all that follows works within a picture, whose cells are brought together once
    each = cells.repartition("media_id").groupBy("media_id", "hex", "cell").agg(F.sum(F.col("freq") * weight).alias("f"))
    colours = each.groupBy("media_id", "hex").agg(F.sum("f").alias("f"), F.count("cell").alias("c")).withColumns({f"_{c}": v for c, v in zip("rgb", rgb, strict=True)})
    rgb = [F.col(f"_{c}") for c in "rgb"]
    colours = colours.withColumn("s", hsv_saturation(*rgb)).withColumn("grey", (F.greatest(*rgb) < 30) | (F.col("s") < 0.08))
    top = F.greatest(F.max("s").over(W.partitionBy("media_id")), F.lit(0.1))
    score = F.col("f") * F.pow(F.lit(columns * rows) / F.col("c"), F.lit(2)) * (0.05 + 0.95 * F.col("s") / top)
    scored = colours.withColumn("score", score)
    w = W.partitionBy("media_id").orderBy(F.desc("score"), "hex")
    before = F.max(F.when(~F.col("grey"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    passed = scored.withColumn("late", F.col("grey") & (F.coalesce(before, F.lit(0)) == 1))
    ranked = passed.withColumn("rank", F.row_number().over(W.partitionBy("media_id").orderBy("late", F.desc("score"), "hex"))).where(F.col("rank") <= n)
    first = ranked.groupBy("media_id").agg(*[F.max(F.when(F.col("rank") == k, F.col("hex"))).alias(f"_{k}") for k in range(1, n + 1)])
    listed = F.array(*[F.struct(F.lit(k).alias("rank"), F.coalesce(f"_{k}", F.lit("#808080")).alias("hex")) for k in range(1, n + 1)])
    return first.select("media_id", F.explode(listed).alias("x")).select("media_id", "x.rank", "x.hex")


def description_audit(descriptions: DataFrame, prefixes: list[str], openers: list[str]) -> DataFrame:
    """key, n, with_prefix, residue, openers, unpaired over ``descriptions`` (media_id, key, value): rows, those with an opening phrase, with one further inside, with a
    legitimate opening, and media that have this key but not the other one."""
    low = F.lower(F.trim("value"))
    starts = lambda words: F.greatest(*[low.startswith(w) for w in words], F.lit(False))
    inside = F.greatest(*[F.contains(low, F.lit(w)) & ~low.startswith(w) for w in prefixes], F.lit(False))
    counts = descriptions.groupBy("key").agg(F.count("*").alias("n"), F.count_if(starts(prefixes)).alias("with_prefix"), F.count_if(inside).alias("residue"), F.count_if(starts(openers)).alias("openers"))
    keys = descriptions.select("media_id", "key").distinct().groupBy("media_id").agg(F.collect_set("key").alias("k"))
    single = keys.where(F.size("k") == 1).groupBy(F.col("k")[0].alias("key")).agg(F.count("*").alias("unpaired"))
    return counts.join(single, "key", "left").fillna(0, ["unpaired"])


def transcript_states(transcripts: DataFrame) -> DataFrame:
    """media_id, state: 'ok' if any segment of a transcript (a JSON list) is reliable, else 'sin_voz'."""
    segments = F.coalesce(F.from_json("segments", SEGMENTS), F.array().cast(SEGMENTS))
    return transcripts.select("media_id", F.when(F.size(reliable_segments(segments)) > 0, "ok").otherwise("sin_voz").alias("state"))


def snapshot_summary(media: DataFrame, keypoints: DataFrame) -> DataFrame:
    """what, name, value: media by type, keypoints by key, first and last day, coverage, and each province's municipalities."""
    row = lambda df, what, name, value: df.select(F.lit(what).alias("what"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    n = F.col("n")
    parts = [
        row(media.groupBy("type").agg(F.count("*").alias("n")), "type", F.col("type"), n),
        row(keypoints.groupBy("key").agg(F.count("*").alias("n")), "keypoints", F.col("key"), n),
        row(media.agg(F.to_date(F.min("timestamp_utc")).alias("n")), "days", F.lit("first"), n),
        row(media.agg(F.to_date(F.max("timestamp_utc")).alias("n")), "days", F.lit("last"), n),
        row(media.agg(F.count("latitude").alias("n")), "coverage", F.lit("located"), n),
        row(media.agg(F.count("timestamp_utc").alias("n")), "coverage", F.lit("timed"), n),
        row(media.where("provincia IS NOT NULL").groupBy("provincia").agg(F.array_join(F.array_sort(F.collect_set("municipio")), ", ").alias("n")), "province", F.col("provincia"), n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def max_gap(gaps: Column) -> Column:
    """The greatest number in a JSON list of gaps ({"gap_s": ...} or bare); null if there is none."""
    records = F.transform(F.from_json(gaps, "array<struct<gap_s:double>>"), lambda g: g["gap_s"])
    return F.coalesce(F.array_max(F.from_json(gaps, "array<double>")), F.array_max(records))
