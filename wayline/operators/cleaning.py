"""Corrections of single media: signs, clocks, cameras, times, positions, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import fix_sign
from ..functions.text import strip
from ..functions.weather import weekday_local


def fix_gps_sign(media: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Coordinates that lost their sign are negated if that puts them in ``box``; an altitude of 0 there becomes null and the place is reset. fixed tells which."""
    wrong = F.coalesce(fix_sign(F.col("latitude"), F.col("longitude"), box), F.lit(False))
    reset = {c: F.when(~wrong, F.col(c)) for c in ("municipio", "provincia") if c in media.columns}
    out = media.withColumns({"fixed": wrong})
    return out.withColumns(
        {
            "latitude": F.when(F.col("fixed"), -F.col("latitude")).otherwise(F.col("latitude")),
            "longitude": F.when(F.col("fixed"), -F.col("longitude")).otherwise(F.col("longitude")),
            "altitude": F.when(F.col("fixed"), F.nullif("altitude", F.lit(0.0))).otherwise(F.col("altitude")),
            **{c: F.when(~F.col("fixed"), F.col(c)) for c in reset},
        }
    )


def classify_camera(bitrate_mbps: Column, fps: Column, offset_s: Column, profiles: list[tuple[str, float, float, float]]) -> Column:
    """profile and note: the first of ``profiles`` (name, least and greatest bitrate, fps) that fits; the note names a clock that is off by over a minute or a missing profile."""
    name = F.coalesce(*[F.when(bitrate_mbps.between(lo, hi) & (F.abs(fps - f) < 0.5), F.lit(n)) for n, lo, hi, f in profiles])
    note = F.when(name.isNull(), "perfil desconocido").when(F.abs(offset_s) > 60, "reloj desfasado").otherwise("")
    return F.struct(name.alias("profile"), note.alias("note"))


def correct_clock(media: DataFrame, created: Column, mode: str = "skip", least_s: float = 600) -> DataFrame:
    """timestamp_utc and end_time from a trusted creation time; in mode 'skip' rows that are marked and off by ``least_s`` or less stay. corrected tells which change."""
    off = F.abs(F.timestamp_diff("MICROSECOND", F.col("timestamp_utc"), created) / 1e6)
    change = created.isNotNull() & (~(F.coalesce("clock_marked", F.lit(False)) & (F.coalesce(off, F.lit(1e18)) <= least_s)) if mode == "skip" else F.lit(True))
    out = media.withColumn("corrected", change)
    out = out.withColumn("timestamp_utc", F.when(F.col("corrected"), created).otherwise(F.col("timestamp_utc")))
    return out.withColumn("end_time", end_time(F.col("timestamp_utc"), F.col("duration_secs")))


def container_status(type_: Column, streams: Column) -> Column:
    """What a file lacks, given its list of streams ('video', 'audio'); 'error' if the list could not be read (null)."""
    has = lambda s: F.array_contains(streams, s)
    return (
        F.when(streams.isNull(), "error")
        .when(F.size(streams) == 0, "sin_contenido")
        .when((type_ == "video") & ~has("video"), "sin_video")
        .when(type_.isin("video", "audio") & ~has("audio"), "sin_audio")
        .otherwise("ok")
    )


def is_360(metadata: DataFrame) -> DataFrame:
    """media_id, is_360: any key that speaks of a sphere or of stereo with a truthy value, or an equirectangular projection."""
    truthy = F.lower(F.trim("value")).isin("1", "true", "yes", "si", "sí", "s")
    named = F.lower("key").rlike("spherical|equirectangular|stereo")
    projected = F.lower("key").contains("projection") & (F.lower(F.trim("value")) == "equirectangular")
    return metadata.groupBy("media_id").agg(F.bool_or((named & truthy) | projected).alias("is_360"))


def infer_author(media: DataFrame, metadata: DataFrame, folder_map: DataFrame) -> DataFrame:
    """id, author, author_source: an artist in the metadata, else the folder's entry in ``folder_map`` (folder, name; a lookup
    of bounded size; either name may hold the other, the shortest first), else the camera, else the folder's name."""
    keys = metadata.where(F.col("key").isin("artist", "make", "model")).groupBy(F.col("media_id").alias("id")).pivot("key", ["artist", "make", "model"]).agg(F.min("value"))
    folder, known = F.lower("carpeta"), F.lower("folder")
    folders = media.select("carpeta").distinct().join(F.broadcast(folder_map), F.contains(folder, known) | F.contains(known, folder))
    best = folders.groupBy("carpeta").agg(F.min_by("name", F.struct(F.length("folder"), "folder")).alias("_mapped"))
    rows = media.select("id", "carpeta").join(keys, "id", "left").join(best, "carpeta", "left")
    camera = F.nullif(F.trim(F.concat_ws(" ", "make", "model")), F.lit(""))
    found = [("metadata", F.nullif(F.trim("artist"), F.lit(""))), ("carpeta_mapa", F.col("_mapped")), ("camara", camera), ("carpeta", F.col("carpeta"))]
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in found])
    return rows.select("id", F.coalesce(*[c for _, c in found]).alias("author"), source.alias("author_source"))


def resolve_timestamp(raw: Column, filename: Column, offset_hours: float = -3) -> Column:
    """ts (UTC, without zone) and note: from a text with zone, else one without (local), else from digits in the file's name (local; missing parts 0)."""
    zoned = F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.current_timezone()).cast("timestamp_ntz")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset_hours * 3600.0))
    plain = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")]) - shift
    digits = F.regexp_extract(filename, r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})[-_ T]?(\d{0,2})[-_:.]?(\d{0,2})[-_:.]?(\d{0,2})", 0)
    padded = F.rpad(F.regexp_replace(digits, r"\D", ""), 14, "0")
    named = F.when(digits != "", F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")) - shift
    note = F.when(zoned.isNotNull(), "metadata con zona").when(plain.isNotNull(), "metadata local").when(named.isNotNull(), "nombre de archivo")
    return F.struct(F.coalesce(zoned, plain, named).alias("ts"), note.alias("note"))


def resolve_coordinate(raw: Column, hemisphere: Column) -> Column:
    """Signed degrees of a decimal number or of degrees, minutes and seconds; south and west are negative. Null if unreadable."""
    text = strip(raw)
    decimal = text.try_cast("double")
    part = lambda k: F.nullif(F.regexp_extract(text, r"^\D*?(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)", k), F.lit("")).try_cast("double")
    value = F.coalesce(decimal, part(1) + part(2) / 60 + part(3) / 3600)
    side = F.upper(F.coalesce(F.nullif(F.trim(hemisphere), F.lit("")), F.regexp_extract(text, "([NSEWnsew])", 1)))
    return F.when(side.startswith("S") | side.startswith("W"), -F.abs(value)).otherwise(value)


def end_time(ts: Column, duration: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(duration, F.lit(0.0)).cast("decimal(18,6)"))


def weekday_rows(media: DataFrame, offset_hours: float = -3) -> DataFrame:
    """media_id, key, value: the Spanish name of each medium's local weekday."""
    return media.where("timestamp_utc IS NOT NULL").select(F.col("id").alias("media_id"), F.lit("dia_semana").alias("key"), weekday_local(F.col("timestamp_utc"), offset_hours).alias("value"))
