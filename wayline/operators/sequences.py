"""Samples, transitions, sessions and groups along time."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, radians, sin, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import describe_place, haversine_m
from ..functions.sun import epoch_seconds, sun_position, twilight_class
from ..functions.text import SEGMENTS
from ..functions.weather import describe_weather, wmo_label
from ..plans.scan import last_known, next_known, ordered_bucket, previous_row
from ..plans.stored import stored
from .similarity import greedy_similarity_groups
from .spacetime import choose_track, place_on_track

#: An island with more instants is grouped by pointer doubling, not in one task.
ISLAND_ROWS = 100_000


def track_samples(media: DataFrame, points: DataFrame, tracks: DataFrame, every_s: int, ends: bool = False, **more: Column) -> DataFrame:
    """media_id, offset_s, t_s, p (place on the medium's best track, null off it), seg_s (length of the track's segment there), is_end and ``more`` of the medium: instants every ``every_s`` seconds
    within each medium, both ends included; one at the start of a medium without length. With ``ends`` one more at each medium's exact end, whose is_end is true."""
    start = epoch_seconds(F.col("timestamp_utc"))
    length = F.greatest(F.coalesce("duration_secs", F.lit(0.0)), F.lit(0.0))
    spans = media.where("timestamp_utc IS NOT NULL").select(F.col("id").alias("media_id"), start.alias("start_s"), (start + length).alias("end_s"), F.floor(length / every_s).cast("int").alias("_last"), *[c.alias(name) for name, c in more.items()])
    spans = stored(choose_track(spans, tracks).select("media_id", "start_s", "end_s", "_last", *more, "track_id"), "media-spans")
    # by medium, so that windows over a medium's samples need not move these
    rows = spans.repartition("media_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_last") + int(ends)))).withColumn("is_end", F.col("_k") > F.col("_last"))
    offset, t = F.col("_k") * every_s, F.col("start_s") + F.col("_k") * every_s
    if ends:
        offset, t = F.when(F.col("is_end"), F.col("end_s") - F.col("start_s")).otherwise(offset), F.when(F.col("is_end"), F.col("end_s")).otherwise(t)
    return place_on_track(rows.select("media_id", "track_id", *more, offset.alias("offset_s"), t.alias("t_s"), "is_end"), points).drop("track_id")


def sample_media(media: DataFrame, points: DataFrame, tracks: DataFrame, every_s: int) -> DataFrame:
    """media_id, offset_s, t_s, lat, lon, ele, source of samples: on the best track of the medium, else at the medium's own place."""
    own = F.when(F.col("latitude").isNotNull(), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("altitude").alias("ele")))
    placed = track_samples(media, points, tracks, every_s, o=own)
    source = F.when(F.col("p").isNotNull(), "track_interpolado").when(F.col("o").isNotNull(), "gps_propio")
    at = F.coalesce("p", F.when(F.col("o.lon").isNotNull(), F.col("o")))
    return placed.select("media_id", "offset_s", "t_s", at["lat"].alias("lat"), at["lon"].alias("lon"), at["ele"].alias("ele"), source.alias("source"))


def _per() -> W:
    return W.partitionBy("media_id").orderBy("offset_s")


def elevation_transitions(samples: DataFrame, least_m: float = 50) -> DataFrame:
    """media_id, offset_s, value where the height differs by ``least_m`` or more from the sample before."""
    d = samples.withColumn("d", F.col("ele") - F.lag("ele").over(_per())).where(F.abs("d") >= least_m)
    return d.select("media_id", "offset_s", F.format_string("%s sostenida %+.0fm", F.when(F.col("d") > 0, "subida").otherwise("bajada"), "d").alias("value"))


def changes(rows: DataFrame, state: Column) -> DataFrame:
    """Rows whose ``state`` differs from that of the row before; a null state is no row but makes the next one a change."""
    s = rows.withColumn("value", state)
    return s.withColumn("_p", F.lag("value").over(_per())).where("value IS NOT NULL AND NOT (value <=> _p)").drop("_p")


def daylight_transitions(samples: DataFrame) -> DataFrame:
    """Where the class of the sun's height changes; without a place it is unknown. The height is a column of its own, as the class compares it several times."""
    s = samples.withColumn("_height", sun_position(F.col("lat"), F.col("lon"), F.col("t_s"))["elevation"])
    return changes(s, twilight_class(F.col("_height"))).select("media_id", "offset_s", "value")


def motion_transitions(samples: DataFrame, least_kmh: float = 3) -> DataFrame:
    """Where a medium begins to move or stops, by the speed from the sample before; an unknown place resets, samples at the same time don't count."""
    prev = lambda c: F.lag(c).over(_per())
    s = samples.withColumns({"_la": prev("lat"), "_lo": prev("lon"), "_dt": F.col("t_s") - prev("t_s")}).where("_dt > 0")
    kmh = haversine_m(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")) / F.col("_dt") * 3.6
    return changes(s, F.when(kmh >= least_kmh, "en movimiento").when(kmh.isNotNull(), "detenido")).select("media_id", "offset_s", "value")


def coarse_samples(samples: DataFrame, every_s: float) -> DataFrame:
    """The sample nearest to each multiple of ``every_s`` up to the last sample, the earlier of two, each once."""
    last = samples.groupBy("media_id").agg(F.max("offset_s").alias("_last"))
    wanted = last.select("media_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / every_s).cast("int"))).alias("_m")).select("media_id", (F.col("_m") * every_s).cast("double").alias("at"), F.lit(None).cast("double").alias("o"))
    both = wanted.unionByName(samples.select("media_id", F.col("offset_s").cast("double").alias("at"), F.col("offset_s").cast("double").alias("o")))
    known = lambda *order: F.last("o", ignorenulls=True).over(W.partitionBy("media_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before, after = known("at", F.col("o").isNull()), known(F.desc("at"), F.col("o").isNull().desc())
    near = both.withColumns({"_b": before, "_a": after}).where("o IS NULL")
    best = F.when(F.col("_a").isNull() | (F.col("at") - F.col("_b") <= F.col("_a") - F.col("at")), F.col("_b")).otherwise(F.col("_a"))
    return samples.join(near.select("media_id", best.alias("offset_s")).distinct(), ["media_id", "offset_s"], "left_semi")


def place_transitions(samples: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Where the described place changes, that of ``places`` (media_id, offset_s, municipio, provincia) or, without them, of the samples' own columns; an unknown one resets."""
    named = samples if places is None else samples.join(places, ["media_id", "offset_s"], "left")
    return changes(named, describe_place(F.col("municipio"), F.col("provincia"))).select("media_id", "offset_s", "value")


def weather_transitions(samples: DataFrame, weather: DataFrame, least_degrees: float = 5) -> DataFrame:
    """Where the weather's label changes or the temperature is ``least_degrees`` or more from the last known one since the last gap. ``weather``: media_id, offset_s, code, temperature."""
    s = samples.join(weather, ["media_id", "offset_s"], "left").withColumn("_run", F.sum(F.col("code").isNull().cast("int")).over(_per()))
    run = W.partitionBy("media_id", "_run").orderBy("offset_s")
    label = wmo_label(F.col("code"))
    s = s.where("code IS NOT NULL").withColumns({"_label": label, "_pl": F.lag(label).over(run), "_pt": F.last("temperature", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))})
    new = ~F.col("_label").eqNullSafe(F.col("_pl")) | F.coalesce(F.abs(F.col("temperature") - F.col("_pt")) >= least_degrees, F.lit(False))
    return s.where(new).select("media_id", "offset_s", describe_weather(F.col("_label"), F.col("temperature")).alias("value"))


def video_positions(samples: DataFrame, gap_s: float, least_m: float, moving_kmh: float = 3) -> DataFrame:
    """media_id, offset_s, kind, lat, lon: positions along a video, without its track's gaps. ``samples``: media_id, offset_s, t_s, lat, lon, seg_s (length of the track segment), is_end (true for
    one more row at the video's exact end, which has no part in speeds).

    Samples off the track (no position) are left out. One in a segment over ``gap_s`` long is in a gap: a 'gap' row stands for each run, and for an end in one. Of the others
    the first is taken, the first of each slow run, one that is ``least_m`` or more from the last taken while moving, and the end; a gap forgets
    neither the last taken nor a pause. Taken rows nearer than ``least_m`` to the last kept go. Speeds, runs and gaps are windows in one order, so
    samples are made and moved once; only what was taken and kept last is state, so a task goes through the rows of its videos in order, and holds none of them.
    """
    order = W.partitionBy("media_id").orderBy("offset_s", "is_end")  # an end at a sample's own time comes after it
    before, sample = order.rowsBetween(W.unboundedPreceding, -1), ~F.col("is_end")
    last = lambda of, c: F.last(F.when(of, c), ignorenulls=True).over(before)
    rows = samples.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_gap", F.coalesce(F.col("seg_s") > gap_s, F.lit(False)))
    along = F.max(sample).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumns({"_p": last(sample, F.struct("t_s", "lat", "lon", "_gap")), "_along": along})
    kmh = haversine_m(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")) / F.nullif(F.col("t_s") - F.col("_p.t_s"), F.lit(0.0)) * 3.6
    going = sample & ~F.col("_gap")
    rows = rows.withColumn("_slow", F.coalesce(kmh, F.lit(0.0)) < moving_kmh)
    rows = rows.withColumns({"_n": F.count(F.when(going, 1)).over(before), "_was_slow": last(going, F.col("_slow"))})
    of_end = F.when(F.col("_along"), F.when(F.col("_gap"), "gap").otherwise("the end"))
    of_gap = F.when(~F.coalesce("_p._gap", F.lit(False)), "gap")
    of_slow = F.when((F.col("_n") == 1) | ~F.col("_was_slow"), "pause")
    way = F.when(~sample, of_end).when(F.col("_gap"), of_gap).when(F.col("_n") == 0, "first").when(F.col("_slow"), of_slow).otherwise("moving")
    steps = rows.withColumn("way", way).where("way IS NOT NULL").withColumn("n", F.row_number().over(order))
    is_gap = F.col("way") == "gap"
    place = [F.when(~is_gap, F.col(c)).cast("double").alias(c) for c in ("lat", "lon")]
    steps = steps.select("n", "way", F.col("media_id").cast("long"), F.col("offset_s").cast("double"), F.when(is_gap, "gap").otherwise("position").alias("kind"), *place)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, kept = None, None  # of the video that rows are at, which may have begun in an earlier batch
        for rows in batches:
            chosen = []
            for i, (n, way, *r) in enumerate(zip(*[rows[c].to_pylist() for c in ("n", "way", "offset_s", "lat", "lon")], strict=True)):
                if n == 1:
                    taken, kept = None, None
                if way == "gap":
                    chosen.append(i)
                    continue
                if way == "moving" and (taken is None or _metres(taken, r) < least_m):
                    continue
                if way == "the end" and (taken is None or taken[0] >= r[0]):
                    continue
                taken = r
                if kept is None or _metres(kept, r) >= least_m:
                    chosen.append(i)
                    kept = r
            yield rows.select(["media_id", "offset_s", "kind", "lat", "lon"]).take(pa.array(chosen, pa.int64()))

    return steps.mapInArrow(fold, "media_id long, offset_s double, kind string, lat double, lon double")


def _metres(a: list[float], b: list[float]) -> float:
    """Between two of offset, lat, lon."""
    x = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_000 * asin(sqrt(min(1.0, x)))


def infer_timestamps_by_rank(media: DataFrame, order: str = "id", bucket: Column | None = None) -> DataFrame:
    """id, timestamp_utc of media without a time that stand, in their folder's order, between two that have one: equally spaced between these.

    ``order`` is any column that can be sorted (a number, or a path as text); ties go by id, nulls come first. The anchors come from the whole folder, so that gaps
    between them exist at all. Folders are cut into ranges of that order, which hold about as many rows each (or by ``bucket``, which must rise with the
    order): ranks and anchors are found within each range, and one row a range carries them over the folder. Rows without a folder have no result.
    """
    rows, place = media.where("carpeta IS NOT NULL"), list(dict.fromkeys([order, "id"]))
    bucket = ordered_bucket(rows, ["carpeta", *place]) if bucket is None else bucket
    rows = rows.withColumns({"_b": bucket, "_s": epoch_seconds(F.col("timestamp_utc"))})
    w = W.partitionBy("carpeta", "_b").orderBy(*place)
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_a", F.when(F.col("_s").isNotNull(), F.struct(F.col("_n").alias("n"), F.col("_s").alias("s"))))
    parts = rows.groupBy("carpeta", "_b").agg(F.count("*").alias("_c"), F.min("_a").alias("_first"), F.max("_a").alias("_last"))
    before = W.partitionBy("carpeta").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("carpeta").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    moved = lambda a: F.when(F.col(a).isNotNull(), F.struct((F.col(a)["n"] + F.col("_base")).alias("n"), F.col(a)["s"].alias("s")))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumns({"_first": moved("_first"), "_last": moved("_last")})
    parts = parts.select("carpeta", "_b", "_base", F.last("_last", ignorenulls=True).over(before).alias("_in"), F.last("_first", ignorenulls=True).over(after).alias("_out"))
    rows = rows.join(parts, ["carpeta", "_b"]).withColumn("_a", moved("_a")).withColumn("_n", F.col("_n") + F.col("_base"))
    near = lambda o: F.last("_a", ignorenulls=True).over(W.partitionBy("carpeta", "_b").orderBy(o).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"_p": F.coalesce(near("_n"), "_in"), "_q": F.coalesce(near(F.desc("_n")), "_out")})
    s = F.col("_p.s") + (F.col("_q.s") - F.col("_p.s")) * (F.col("_n") - F.col("_p.n")) / (F.col("_q.n") - F.col("_p.n"))
    return rows.where("timestamp_utc IS NULL AND _p IS NOT NULL AND _q IS NOT NULL").select("id", s.alias("t_s"))


def place_entry_exit(media: DataFrame, levels: list[str] = ("provincia", "municipio"), order: Column | None = None) -> DataFrame:
    """id, hour, kind, text: 'enter' and 'leave' where a level's name differs from the last known one along the route; each text once per whole hour, the first."""
    rows = media.withColumn("_o", order if order is not None else F.coalesce(epoch_seconds(F.col("timestamp_utc")), F.col("id").cast("double")))
    bucket = ordered_bucket(rows, ["_o", "id"])
    out = None
    for k, level in enumerate(levels):
        now = F.nullif(F.trim(level), F.lit(""))
        r = last_known(rows, bucket, ["_o", "id"], "_before", now).withColumn("_now", now).where("_now IS NOT NULL AND NOT (_now <=> _before)")
        events = F.filter(F.array(F.when(F.col("_before").isNotNull(), F.struct(F.lit(f"{level}_sale").alias("kind"), F.concat(F.lit("Salimos de "), "_before").alias("text"), F.lit(2 * k).alias("_k"))), F.struct(F.lit(f"{level}_entra").alias("kind"), F.concat(F.lit("Entramos a "), "_now").alias("text"), F.lit(2 * k + 1).alias("_k"))), lambda x: x.isNotNull())
        r = r.select("id", "hour", "_o", F.explode(events).alias("e")).select("id", "hour", "_o", "e.*")
        out = r if out is None else out.unionByName(r)
    first = out.groupBy("text", F.floor("hour").alias("_h")).agg(F.min_by(F.struct("id", "hour", "kind"), F.struct("_o", "id", "_k")).alias("x"))
    return first.select("x.id", "x.hour", "x.kind", "text")


def gap_sessions(rows: DataFrame, seconds: float, ts: str = "ts", key: str = "id") -> DataFrame:
    """``rows`` with session: the first row's key of its session; a new one begins when more than ``seconds`` have passed since the row before."""
    s = epoch_seconds(F.col(ts))
    bucket = ordered_bucket(rows, [ts, key])
    r = previous_row(rows, bucket, [ts, key], "_before", s)
    start = F.when(F.col("_before").isNull() | (s - F.col("_before") > seconds), F.col(key))
    return last_known(r, bucket, [ts, key], "session", start, inclusive=True).drop("_before")


def anchored_time_groups(rows: DataFrame, minutes: float, ts: str = "ts", key: str = "id", island_rows: int = ISLAND_ROWS) -> DataFrame:
    """``rows`` with group: the first row's key; a new group begins when a row is more than ``minutes`` after its group's first.

    Rows at one instant are in one group, whose key is the least of the first instant's, so only distinct instants are grouped. Gaps longer than
    that are borders of groups in any case, and cut them into islands that are independent. Each island is folded in
    order. An island of more than ``island_rows`` instants is solved by doubling instead: each knows the one that would begin the next
    group after it, and those reached from the island's first are found in a logarithmic number of joins.
    """
    width = minutes * 60
    instants = stored(rows.groupBy(F.col(ts).alias("_ts")).agg(F.min(key).alias("_key")), "group-instants")
    sessions = stored(gap_sessions(instants, width, "_ts", "_key").withColumn("_s", epoch_seconds(F.col("_ts"))), "group-islands")
    sizes = sessions.groupBy("session").agg(F.count("*").alias("_n"))
    sized = sessions.join(sizes, "session")

    def fold(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values(["_s", "_key"])
        lead, first, out = None, None, []
        for k, s in zip(r._key, r._s, strict=True):
            if first is None or s - first > width:
                lead, first = k, s
            out.append((k, lead))
        return pd.DataFrame(out, columns=["_key", "group"])

    grouped = sized.where(F.col("_n") <= island_rows).groupBy("session").applyInPandas(fold, "_key long, group long")
    if sizes.where(F.col("_n") > island_rows).take(1):
        grouped = grouped.unionByName(_doubled(sized.where(F.col("_n") > island_rows), width))
    of_instant = instants.join(grouped, "_key").select("_ts", "group")
    return rows.join(of_instant, F.col(ts).eqNullSafe(F.col("_ts"))).drop("_ts")


def _doubled(rows: DataFrame, width: float) -> DataFrame:
    marks = rows.select("session", "_key", "_s", F.lit(0).alias("_q")).unionByName(rows.select("session", "_key", (F.col("_s") + width).alias("_s"), F.lit(1).alias("_q")))
    marks = marks.withColumn("_o", F.when(F.col("_q") == 1, F.lit(1 << 62)).otherwise(F.col("_key")))
    nxt = next_known(marks, ordered_bucket(marks, ["_s", "_o", "_q"]), ["_s", "_o", "_q"], "_next", F.when(F.col("_q") == 0, F.struct("session", "_key"))).where("_q = 1 AND _next.session = session")
    jump = stored(nxt.select(F.col("_key").alias("k"), F.col("_next._key").alias("n")), "group-jumps")
    heads = stored(rows.groupBy("session").agg(F.min_by("_key", F.struct("_s", "_key")).alias("k")).select("k"), "group-heads")
    while True:
        more = stored(heads.unionByName(heads.join(jump, "k").select(F.col("n").alias("k"))).distinct(), "group-heads")
        grown = more.count() > heads.count()
        heads = more
        if not grown:
            break
        jump = stored(jump.alias("a").join(jump.alias("b"), F.col("a.n") == F.col("b.k")).select("a.k", F.col("b.n").alias("n")), "group-jumps")
    lead = rows.join(heads.select(F.col("k").alias("_key"), F.col("k").alias("_lead")), "_key", "left")
    return last_known(lead, ordered_bucket(rows, ["_s", "_key"]), ["_s", "_key"], "group", F.col("_lead"), inclusive=True).select("_key", "group")


def best_of_group(rows: DataFrame, group: str, score: str, n: int = 1, key: str = "id") -> DataFrame:
    """The ``n`` rows of the greatest score of each group; ties to the lesser key."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(score), key)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def clean_bursts(rows: DataFrame, minutes: float, bits: int) -> DataFrame:
    """id, group, lead, kept, reason over ``rows`` (id, ts, hash, score): of the similar pictures of each few minutes the best is kept."""
    grouped = anchored_time_groups(rows, minutes)
    leads = greedy_similarity_groups(grouped.select("group", F.col("ts").alias("ord"), "id", F.col("hash").alias("item")), "hamming", bits)
    scored = grouped.join(leads, "id")
    w = W.partitionBy("lead")
    best = F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "id")) == 1
    out = scored.withColumns({"kept": best, "_n": F.count("*").over(w)})
    return out.select("id", "group", "lead", "kept", F.when(F.col("_n") == 1, "unica").when(F.col("kept"), "mejor de su tanda").otherwise("similar a otra mejor").alias("reason"))


def scenes(cuts: DataFrame, longest_s: float, per_scene: int, least_s: float = 0.05) -> DataFrame:
    """media_id, scene, start_s, end_s, sample, t_s: cuts (media_id, cut_s, duration_s) make contiguous scenes; those under ``least_s`` go, longer ones than ``longest_s`` are divided evenly, each gets ``per_scene`` evenly spaced instants."""
    bounds = cuts.select("media_id", "duration_s", F.explode(F.array(F.lit(0.0), F.col("cut_s"), F.col("duration_s"))).alias("a")).where("a >= 0 AND a <= duration_s").distinct()
    w = W.partitionBy("media_id").orderBy("a")
    spans = bounds.withColumn("b", F.lead("a").over(w)).where(F.col("b") - F.col("a") >= least_s)
    n = F.ceil((F.col("b") - F.col("a")) / longest_s).cast("int")
    parts = spans.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    size = (F.col("b") - F.col("a")) / F.col("_n")
    cut = parts.select("media_id", (F.col("a") + F.col("_k") * size).alias("start_s"), (F.col("a") + (F.col("_k") + 1) * size).alias("end_s"))
    numbered = cut.withColumn("scene", F.row_number().over(W.partitionBy("media_id").orderBy("start_s")))
    at = F.transform(F.sequence(F.lit(1), F.lit(per_scene)), lambda k: F.col("start_s") + (F.col("end_s") - F.col("start_s")) * (k - 0.5) / per_scene)
    return numbered.select("media_id", "scene", "start_s", "end_s", F.posexplode(at).alias("sample", "t_s"))


def transcript_keypoints(media: DataFrame, transcripts: DataFrame) -> DataFrame:
    """media_id, offset_secs, t_s, key, value: a keypoint for each spoken segment of transcripts (media_id, segments: a JSON list) of media that have a time."""
    base = media.where("timestamp_utc IS NOT NULL").select(F.col("id").alias("media_id"), epoch_seconds(F.col("timestamp_utc")).alias("_s"))
    said = transcripts.select("media_id", F.explode(F.from_json("segments", SEGMENTS)).alias("x")).where(F.trim("x.texto") != "")
    offset = F.coalesce("x.inicio", F.lit(0.0))
    return said.join(base, "media_id").select("media_id", offset.alias("offset_secs"), (F.col("_s") + offset).alias("t_s"), F.lit("transcription").alias("key"), F.trim("x.texto").alias("value"))


#: What the analysis of a video says of each scene.
ANALYSIS = "struct<escenas:array<struct<inicio:double,keywords:array<string>,descripcion:string>>>"


def scene_keypoints(media: DataFrame, analyses: DataFrame) -> DataFrame:
    """media_id, offset_secs, t_s, key, value: keypoints of the scenes in analyses (media_id, analysis: JSON) of media that have a time.

    A scene with keywords has one keypoint with all of them and one for each; one with a description has one for that. Blank ones don't count; analyses that
    aren't JSON objects have no scenes. A scene without a start begins at 0.
    """
    base = media.where("timestamp_utc IS NOT NULL").select(F.col("id").alias("media_id"), epoch_seconds(F.col("timestamp_utc")).alias("_s"))
    scene = analyses.select("media_id", F.explode(F.from_json("analysis", ANALYSIS)["escenas"]).alias("x"))
    words = F.filter(F.transform(F.coalesce("x.keywords", F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != "")
    told = F.trim(F.coalesce("x.descripcion", F.lit("")))
    scene = scene.select("media_id", F.coalesce("x.inicio", F.lit(0.0)).alias("offset_secs"), words.alias("w"), told.alias("d"))
    row = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    some = lambda when, rows: F.when(when, rows).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    all_words = some(F.size("w") > 0, F.array(row("escena", F.array_join("w", ", "))))
    each = some(F.size("w") > 0, F.transform("w", lambda w: row("keyword", w)))
    keypoints = F.concat(all_words, each, some(F.col("d") != "", F.array(row("descripcion_escena", F.col("d")))))
    out = scene.join(base, "media_id").select("media_id", "offset_secs", (F.col("_s") + F.col("offset_secs")).alias("t_s"), F.explode(keypoints).alias("k"))
    return out.select("media_id", "offset_secs", "t_s", "k.key", "k.value")
