"""Exports, snapshots, merging by key and removal of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def exportable(name: str, df: DataFrame, big_keys: list[str] = (), most: int = 65_536) -> DataFrame:
    """What of a table goes into an export: no vectors, and no metadata under ``big_keys`` or with values over ``most`` characters."""
    out = df.drop("embedding")
    if name == "metadata":
        out = out.where((~F.col("key").isin(*big_keys) if big_keys else F.lit(True)) & (F.length(F.coalesce("value", F.lit(""))) <= most))
    return out


def export_csv(tables: dict[str, DataFrame], out: str, big_keys: list[str] = (), most: int = 65_536) -> DataFrame:
    """Write each table under ``out`` and return how many rows of each are in the files: table, n. Values may hold line ends."""
    counts = None
    for name, df in tables.items():
        rows = exportable(name, df, big_keys, most)
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/{name}")
        back = df.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/{name}")
        n = back.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts


def write_snapshot(df: DataFrame, out: str, by: str = "type") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(out)


def write_loop_spec(spec: DataFrame, out: str) -> None:
    spec.write.mode("overwrite").json(out)


def merge_by_mode(target: DataFrame, source: DataFrame, keys: list[str], mode: str, derived: Column | None = None) -> DataFrame:
    """``target`` after ``source``: 'skip' adds rows with new keys; 'update' also replaces those with the same keys; 'replace' first removes the rows that ``derived`` marks. Of equal keys in ``source`` one row stays."""
    fresh = source.dropDuplicates(keys)
    if mode == "skip":
        return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))
    kept = target.where(~F.coalesce(derived, F.lit(False))) if mode == "replace" and derived is not None else target
    if mode not in ("update", "replace"):
        raise ValueError(mode)
    return kept.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def dedup_ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose file_hash is not in ``existing``, the least id of each hash."""
    fresh = new.join(existing.select("file_hash"), "file_hash", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(W.partitionBy("file_hash").orderBy("id"))).where("_r = 1").drop("_r")


def same_content(media: DataFrame) -> DataFrame:
    """Rows whose content_hash others share, with copies."""
    counts = media.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return media.join(counts, "content_hash")


def undo_batch(media: DataFrame, children: dict[str, DataFrame], batch: int, links: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What a batch's removal would delete or unlink (what, n), and the tables that are left: ``children`` lose the rows of its media, ``links`` (chat attachments) only their media_id."""
    gone = media.where(F.col("ingest_batch_id") == batch).select(F.col("id").alias("media_id"))
    preview = gone.agg(F.count("*").alias("n")).select(F.lit("media").alias("what"), "n")
    left = {"media": media.where(~F.coalesce(F.col("ingest_batch_id") == batch, F.lit(False)))}
    for name, df in {**children, **(links or {})}.items():
        preview = preview.unionByName(df.join(gone, "media_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
        if name in children:
            left[name] = df.join(gone, "media_id", "left_anti")
        else:
            marked = df.join(gone.withColumn("_gone", F.lit(True)), "media_id", "left")
            left[name] = marked.withColumn("media_id", F.when(F.col("_gone").isNull(), F.col("media_id"))).select(*df.columns)
    return preview, left


#: Where positions come from, and keys of what is derived from a track.
FROM_TRACK, HEIGHT_FROM_TRACK = "track_interpolado", "track_gps"
TRACK_KEYPOINT, TRACK_METADATA = "ubicacion_video", ["ubicacion_video_estado", "ubicacion_video_gaps"]


def undo_track(tables: dict[str, DataFrame], track_id: int, heights_without_range: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What a track's removal would touch (what, n), and the tables that are left. ``tables``: tracks (track_id, start_time, end_time), waypoints (track_id), media, keypoints (media_id, key, source), metadata (media_id, key).

    The track and its waypoints go. Of media in its time range, ends included, those whose height came from a track lose it, those whose position did lose
    position and height, and both their source; whatever their source, video positions (keypoints and two metadata keys) go, and context keypoints that
    were made from a track. A track without a range resets nothing, unless ``heights_without_range`` says to reset all heights from tracks.
    """
    track = tables["tracks"].where(F.col("track_id") == track_id).agg(F.min("start_time").alias("_from"), F.max("end_time").alias("_to"))  # one row
    media = tables["media"].crossJoin(F.broadcast(track))
    inside = F.coalesce(F.col("timestamp_utc").between(F.col("_from"), F.col("_to")), F.lit(False))
    no_range = F.col("_from").isNull() | F.col("_to").isNull()
    source = F.coalesce("geolocation_source", F.lit(""))
    height, place = (source == HEIGHT_FROM_TRACK) & (inside | (no_range & F.lit(heights_without_range))), (source == FROM_TRACK) & inside
    reset = lambda c, when: F.when(~when, F.col(c)).alias(c)
    changed = {"latitude": place, "longitude": place, "altitude": height | place, "geolocation_source": height | place}
    left = {"media": media.select(*[reset(c, changed[c]) if c in changed else F.col(c) for c in tables["media"].columns])}
    own = media.where(inside).select(F.col("id").alias("media_id"), F.lit(True).alias("_mine"))

    def without(name: str, marked: Column) -> DataFrame:
        rows = tables[name].join(own, "media_id", "left")
        return rows.where(F.col("_mine").isNull() | ~F.coalesce(marked, F.lit(False))).select(*tables[name].columns)

    of_context = F.col("key").startswith("contexto_") & (F.col("source") == FROM_TRACK)
    left["keypoints"] = without("keypoints", (F.col("key") == TRACK_KEYPOINT) | of_context)
    left["metadata"] = without("metadata", F.col("key").isin(TRACK_METADATA))
    for name in ("tracks", "waypoints"):
        left[name] = tables[name].where(~F.coalesce(F.col("track_id") == track_id, F.lit(False)))
    count = lambda rows, what: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    within = inside | no_range
    preview = count(tables["waypoints"].where(F.col("track_id") == track_id), "waypoints")
    for what in (HEIGHT_FROM_TRACK, FROM_TRACK):
        preview = preview.unionByName(count(media.where((source == what) & within), what))
    return preview.unionByName(count(tables["keypoints"].where(F.col("key") == TRACK_KEYPOINT), TRACK_KEYPOINT)), left


def reroot_paths(path: Column, old: str, new: str) -> Column:
    """``path`` with its beginning ``old`` replaced, at a separator only."""
    old, new = old.rstrip("/\\"), new.rstrip("/\\")
    inside = path.startswith(old + "/") | path.startswith(old + "\\")
    return F.when(path == old, F.lit(new)).when(inside, F.concat(F.lit(new), path.substr(F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def group_by_root(paths: DataFrame, column: str = "path", depth: int = 2) -> DataFrame:
    """root (the first ``depth`` parts), n: how many paths lie under each."""
    root = F.array_join(F.slice(F.split(F.regexp_replace(column, r"\\", "/"), "/"), 1, depth), "/")
    return paths.groupBy(root.alias("root")).agg(F.count("*").alias("n"))
