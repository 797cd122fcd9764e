"""Queries to the catalogue (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C, cleaning as K
from .book import Book

book = Book()
query = book.query

_LOCAL = "(timestamp_utc - INTERVAL 3 HOUR)"
_TOKENS = "list_transform(CASE WHEN value LIKE '[%' THEN from_json(value, '[\"VARCHAR\"]') ELSE string_split(value, ',') END, lambda x: lower(trim(trim(x), '''\"')))"
_KEYS = "('ia_keywords', 'ia_keywords_transcripcion', 'ia_keywords_texto', 'ia_keywords_sonido', 'ia_keywords_video')"


@query("F1_safe_where", "SELECT id, type, municipio FROM {media} WHERE type IN ('image', 'video') AND duration_secs IS NULL AND municipio <> 'union; --'")
def safe_where(v):
    return C.safe_where(v.media, "type IN ('image', 'video') AND duration_secs IS NULL AND municipio <> 'union; --'").select("id", "type", "municipio")


@query("F2_describe_catalog", """
SELECT 'table' AS what, 'media' AS name, count(*) AS n FROM {media} UNION ALL SELECT 'table', 'metadata', count(*) FROM {metadata} UNION ALL SELECT 'table', 'keypoints', count(*) FROM {keypoints}
UNION ALL SELECT 'metadata', key, count(*) FROM {metadata} GROUP BY key UNION ALL SELECT 'keypoints', key, count(*) FROM {keypoints} GROUP BY key""")
def describe(v):
    return C.describe_catalog({"media": v.media, "metadata": v.metadata, "keypoints": v.keypoints})


@query("F3_distinct_values", "WITH c AS (SELECT municipio AS value, count(*) AS n FROM {media} WHERE municipio IS NOT NULL AND type = 'image' GROUP BY municipio ORDER BY n DESC, value LIMIT 10) SELECT value, n, round(100.0 * n / sum(n) OVER (), 1) AS percent FROM c")
def distinct_values(v):
    return C.distinct_values(v.media, "municipio", 10, "type = 'image'")


@query("F4_distinct_key", "WITH c AS (SELECT value, count(*) AS n FROM {metadata} JOIN {media} m ON m.id = media_id WHERE key = 'weather_label' AND m.type = 'video' GROUP BY value) SELECT value, n, round(100.0 * n / sum(n) OVER (), 1) AS percent FROM c")
def distinct_key(v):
    return C.distinct_key(v.metadata, v.media, "weather_label", 50, "type = 'video'")


_TEXT_COLUMNS = "type subtype carpeta geolocation_source municipio provincia author color_1_hex color_2_hex color_3_hex content_hash file_hash".split()


@query("F5_search_text", "WITH m AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS source, {c} AS value FROM {{media}}" for c in _TEXT_COLUMNS) + """),
a AS (SELECT * FROM m WHERE contains(lower(value), 're') ORDER BY id, source, value LIMIT 15), c AS (SELECT media_id, 'keypoints:' || key, value FROM {keypoints} WHERE contains(lower(value), 're') ORDER BY 1, 2, 3 LIMIT 6),
b AS (SELECT media_id, 'metadata:' || key, value, row_number() OVER (ORDER BY media_id, key, value) AS r FROM {metadata} WHERE contains(lower(value), 're'))
SELECT id, source, value[:120] AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * EXCLUDE r FROM b WHERE r <= 30 - (SELECT count(*) FROM a) - (SELECT count(*) FROM c))""")
def search(v):
    return C.search_text(v.media, v.metadata, v.keypoints, "RE", 30)


@query("F6_faceted_media", f"""
WITH t AS (SELECT DISTINCT media_id FROM {{metadata}} WHERE key IN {_KEYS} AND list_has_any({_TOKENS}, ['red', 'gear'])),
f AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY md5(id || '|s1'), id) AS r FROM {{media}} JOIN t ON media_id = id WHERE type IN ('image', 'video', 'audio', 'text') AND provincia IN ('ASIA', 'EUROPE', 'AMERICA') AND hour({_LOCAL}) BETWEEN 6 AND 18)
SELECT id, type FROM f WHERE r <= 5""")
def faceted(v):
    return C.sample_per_type(C.filtered_media(v.media, v.metadata, provinces=["ASIA", "EUROPE", "AMERICA"], tags=["Red", "gear"], hours=[18, 6]), 5, "s1").select("id", "type")


@query("F7_loop_candidates", f"""
WITH h AS (SELECT *, coalesce(hour({_LOCAL}) + minute({_LOCAL}) / 60.0 + second({_LOCAL}) / 3600.0, CASE WHEN type = 'text' THEN 12.0 END) AS hour FROM {{media}})
SELECT id, round(hour, 6) AS hour FROM h WHERE hour BETWEEN 7 AND 16 AND id IN (SELECT media_id FROM {{metadata}} WHERE key = 'weather_label' AND value IN ('despejado', 'nublado'))
AND id IN (SELECT media_id FROM {{metadata}} WHERE key IN {_KEYS} AND (contains(lower(value), 'steel') OR contains(lower(value), 'old')))""")
def candidates(v):
    out = C.loop_candidates(v.media, v.metadata, weather=["despejado", "nublado"], tags=["STEEL", "old"], hour_range=(7, 16))
    return out.select("id", F.round("hour", 6).alias("hour"))


@query("F8_map_points", f"SELECT id, latitude, longitude FROM {{media}} WHERE latitude IS NOT NULL AND type IN ('image', 'video', 'audio', 'text') AND id IN (SELECT media_id FROM {{metadata}} WHERE key IN {_KEYS} AND contains(lower(value), 'mal'))")
def points(v):
    return C.map_points(v.media, v.metadata, tags=["mal"]).select("id", "latitude", "longitude")


@query("F9_active_between", """
WITH m AS (SELECT id, timestamp_utc AS a, timestamp_utc + to_microseconds(CAST(coalesce(duration_secs, 0) * 1000000 AS BIGINT)) AS b FROM {media} WHERE timestamp_utc IS NOT NULL)
SELECT id, 'active' AS relation FROM m WHERE a <= TIMESTAMP '2024-01-10 12:00:00' AND b >= TIMESTAMP '2024-01-10 11:00:00'
UNION ALL (SELECT id, 'next' FROM m WHERE a > TIMESTAMP '2024-01-10 12:00:00' ORDER BY a, id LIMIT 1) UNION ALL (SELECT id, 'previous' FROM m WHERE a < TIMESTAMP '2024-01-10 11:00:00' ORDER BY a DESC, id LIMIT 1)""")
def active(v):
    m = v.media.where("timestamp_utc IS NOT NULL").withColumn("end_time", K.end_time(F.col("timestamp_utc"), F.col("duration_secs")))
    lo, hi = F.lit("2024-01-10 11:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    following = m.where(F.col("timestamp_utc") > hi).orderBy("timestamp_utc", "id").limit(1)
    before = m.where(F.col("timestamp_utc") < lo).orderBy(F.desc("timestamp_utc"), "id").limit(1)
    named = lambda df, what: df.select("id", F.lit(what).alias("relation"))
    return named(C.active_between(m, lo, hi), "active").unionByName(named(following, "next")).unionByName(named(before, "previous"))


@query("F10_keypoints_sample", "SELECT id, key, (SELECT count(*) FROM {keypoints} WHERE starts_with(key, 'contexto_')) AS available FROM {keypoints} WHERE starts_with(key, 'contexto_') ORDER BY md5(id || '|k'), id LIMIT 20")
def keypoints(v):
    return C.keypoints_sample(v.keypoints, "contexto", 20, "k").select("id", "key", "available")


@query("F11_texts_for_display", """
SELECT id, type, t[:60] AS text FROM (SELECT m.id, m.type, m.carpeta, trim(regexp_replace(coalesce(x.value, k.value), '\\s+', ' ', 'g')) AS t FROM {media} m
 LEFT JOIN (SELECT media_id, min(value) AS value FROM {metadata} WHERE key = 'texto_completo' GROUP BY media_id) x ON x.media_id = m.id LEFT JOIN (SELECT media_id, min(value) AS value FROM {keypoints} GROUP BY media_id) k ON k.media_id = m.id)
WHERE len(string_split(t, ' ')) >= 5 AND id NOT IN (11, 12) ORDER BY CASE type WHEN 'text' THEN 0 WHEN 'audio' THEN 1 WHEN 'video' THEN 2 ELSE 3 END, carpeta = 'folder_1', md5(id || '|t'), id LIMIT 8""")
def display(v):
    texts = v.metadata.where("key = 'texto_completo'").groupBy(F.col("media_id").alias("id")).agg(F.min("value").alias("a"))
    spoken = v.keypoints.groupBy(F.col("media_id").alias("id")).agg(F.min("value").alias("b"))
    folder = F.when(F.col("carpeta") == "folder_1", "telegram").otherwise(F.col("carpeta")).alias("folder")
    rows = v.media.join(texts, "id", "left").join(spoken, "id", "left").select("id", "type", folder, F.coalesce("a", "b").alias("text"))
    return C.texts_for_display(rows, 5, 8, "t", [11, 12]).select("id", "type", F.substring("text", 1, 60).alias("text"))


@query("F12_media_detail", """
WITH a AS (SELECT media_id, key || '=' || value[:80] AS p, row_number() OVER (PARTITION BY media_id ORDER BY key, value) AS r FROM {metadata}),
b AS (SELECT media_id, key || '=' || value[:80] AS p, row_number() OVER (PARTITION BY media_id ORDER BY offset_secs, key, value) AS r FROM {keypoints})
SELECT id AS media_id, type, coalesce((SELECT count(*) FROM a WHERE a.media_id = id), 0) AS n_metadata, coalesce((SELECT string_agg(p, ' | ' ORDER BY r) FROM a WHERE a.media_id = id AND r <= 2), '') AS metadata,
 coalesce((SELECT count(*) FROM b WHERE b.media_id = id), 0) AS n_keypoints, coalesce((SELECT string_agg(p, ' | ' ORDER BY r) FROM b WHERE b.media_id = id AND r <= 2), '') AS keypoints FROM {media}""")
def detail(v):
    return C.media_detail(v.media, v.metadata, v.keypoints, 2).select("media_id", "type", "n_metadata", "metadata", "n_keypoints", "keypoints")


@query("F13_pending_work", f"""
WITH r AS (SELECT m.*, id IN (SELECT media_id FROM {{metadata}} WHERE key IN {_KEYS}) AS words, id IN (SELECT media_id FROM {{metadata}} WHERE key = 'weather_label') AS weather, id IN (SELECT media_id FROM {{keypoints}}) AS points FROM {{media}} m),
s AS (SELECT 'timestamps' AS step, true AS due, timestamp_utc IS NOT NULL AS ok FROM r UNION ALL SELECT 'gps', timestamp_utc IS NOT NULL, latitude IS NOT NULL FROM r UNION ALL SELECT 'geocode', latitude IS NOT NULL, municipio IS NOT NULL FROM r
 UNION ALL SELECT 'weather', latitude IS NOT NULL AND timestamp_utc IS NOT NULL, weather FROM r UNION ALL SELECT 'keywords', type IN ('image', 'video', 'audio'), words FROM r UNION ALL SELECT 'keypoints', type IN ('video', 'audio'), points FROM r)
SELECT step, count(*) FILTER (WHERE due) AS total, count(*) FILTER (WHERE due AND NOT ok) AS pending, count(*) FILTER (WHERE due AND ok) AS done FROM s GROUP BY step""")
def pending(v):
    return C.pending_work(v.media, v.metadata, v.keypoints)


@query("F14_integrity_report", """
SELECT 'batches' AS measure, count(DISTINCT ingest_batch_id) AS n FROM {media} UNION ALL SELECT 'without_batch', count(*) FROM {media} WHERE ingest_batch_id IS NULL UNION ALL SELECT 'located', count(latitude) FROM {media}
UNION ALL SELECT 'not_located', count(*) FROM {media} WHERE latitude IS NULL UNION ALL SELECT 'positive_sign', count(*) FROM {media} WHERE latitude > 0 OR longitude > 0 UNION ALL SELECT 'geocoded', count(municipio) FROM {media}
UNION ALL SELECT 'repeated_hashes', count(*) FROM (SELECT content_hash FROM {media} GROUP BY content_hash HAVING count(*) > 1) UNION ALL SELECT 'with_weather', count(DISTINCT media_id) FROM {metadata} WHERE key = 'weather_label'""")
def integrity(v):
    return C.integrity_report(v.media, v.metadata)


@query("F15_fix_gps_sign", """
SELECT id, f AS fixed, CASE WHEN f THEN -lat ELSE lat END AS latitude, CASE WHEN f THEN -lon ELSE lon END AS longitude, CASE WHEN f THEN nullif(alt, 0) ELSE alt END AS altitude, CASE WHEN NOT f THEN municipio END AS municipio FROM (
 SELECT *, coalesce(lat > 0 AND lon > 0 AND -lat BETWEEN -34 AND -27 AND -lon BETWEEN -65 AND -58, false) AS f FROM (
  SELECT id, CASE WHEN id % 4 = 0 THEN -latitude ELSE latitude END AS lat, CASE WHEN id % 4 = 0 THEN -longitude ELSE longitude END AS lon, CASE WHEN id % 8 = 0 THEN 0.0 ELSE altitude END AS alt, municipio FROM {media}))""")
def sign(v):
    lost = F.col("id") % 4 == 0
    m = v.media.withColumns({"latitude": F.when(lost, -F.col("latitude")).otherwise(F.col("latitude")), "longitude": F.when(lost, -F.col("longitude")).otherwise(F.col("longitude")), "altitude": F.when(F.col("id") % 8 == 0, 0.0).otherwise(F.col("altitude"))})
    return K.fix_gps_sign(m, (-34, -27, -65, -58)).select("id", "fixed", "latitude", "longitude", "altitude", "municipio")


@query("F16_classify_camera", """
SELECT id, CASE WHEN b BETWEEN 50 AND 70 AND f = 30 THEN 'A' WHEN b BETWEEN 90 AND 130 AND f = 25 THEN 'B' END AS profile,
 CASE WHEN NOT coalesce((b BETWEEN 50 AND 70 AND f = 30) OR (b BETWEEN 90 AND 130 AND f = 25), false) THEN 'perfil desconocido' WHEN abs(o) > 60 THEN 'reloj desfasado' ELSE '' END AS note
FROM (SELECT id, id % 150 AS b, CASE WHEN id % 2 = 0 THEN 30 ELSE 25 END AS f, id % 120 AS o FROM {media} WHERE type = 'video')""")
def camera(v):
    fps = F.when(F.col("id") % 2 == 0, 30.0).otherwise(25.0)
    c = K.classify_camera(F.col("id") % 150, fps, F.col("id") % 120, [("A", 50, 70, 30), ("B", 90, 130, 25)])
    return v.media.where("type = 'video'").select("id", c.alias("c")).select("id", "c.profile", "c.note")


@query("F17_correct_clock", """
SELECT id, c AS corrected, strftime(CASE WHEN c THEN created ELSE timestamp_utc END, '%Y-%m-%d %H:%M:%S') AS ts, strftime(CASE WHEN c THEN created ELSE timestamp_utc END + to_seconds(CAST(coalesce(duration_secs, 0) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS end_ts FROM (
 SELECT *, created IS NOT NULL AND NOT (id % 3 = 0 AND coalesce(abs(epoch_us(created) - epoch_us(timestamp_utc)) / 1e6 <= 600, false)) AS c FROM (SELECT *, timestamp_utc + to_seconds(CAST(id % 1200 AS BIGINT)) AS created FROM {media} WHERE type = 'video'))""")
def clock(v):
    m = v.media.where("type = 'video'").withColumn("clock_marked", F.col("id") % 3 == 0)
    created = F.col("timestamp_utc") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 1200).cast("decimal(18,6)"))
    out = K.correct_clock(m.withColumn("created", created), F.col("created"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("id", "corrected", shown("timestamp_utc").alias("ts"), shown("end_time").alias("end_ts"))


_STREAMS = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['video'] WHEN 3 THEN ['audio'] ELSE ['video', 'audio'] END"


@query("F18_container_status", f"""SELECT id, CASE WHEN s IS NULL THEN 'error' WHEN len(s) = 0 THEN 'sin_contenido' WHEN type = 'video' AND NOT list_contains(s, 'video') THEN 'sin_video'
WHEN type IN ('video', 'audio') AND NOT list_contains(s, 'audio') THEN 'sin_audio' ELSE 'ok' END AS status FROM (SELECT id, type, {_STREAMS} AS s FROM {{media}})""")
def container(v):
    s = F.when(F.col("id") % 5 == 1, F.array().cast("array<string>")).when(F.col("id") % 5 == 2, F.array(F.lit("video"))).when(F.col("id") % 5 == 3, F.array(F.lit("audio"))).when(F.col("id") % 5 == 4, F.array(F.lit("video"), F.lit("audio")))
    return v.media.select("id", K.container_status(F.col("type"), s).alias("status"))


@query("F19_is_360", """SELECT media_id, bool_or((key IN ('Spherical', 'StereoMode') AND value IN ('TRUE', 'Si', '1')) OR (key = 'ProjectionType' AND value = 'Equirectangular')) AS is_360 FROM (
SELECT id AS media_id, ['Spherical', 'StereoMode', 'ProjectionType', 'Make'][id % 4 + 1] AS key, CASE id % 12 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Equirectangular' WHEN 3 THEN 'Si' WHEN 5 THEN 'no' ELSE 'x' END AS value FROM {media} WHERE type = 'video') GROUP BY media_id""")
def sphere(v):
    key = F.get(F.array(*map(F.lit, ("Spherical", "StereoMode", "ProjectionType", "Make"))), (F.col("id") % 4).cast("int"))
    n = F.col("id") % 12
    value = F.when(n == 0, "TRUE").when(n == 1, "1").when(n == 2, "Equirectangular").when(n == 3, "Si").when(n == 5, "no").otherwise("x")
    return K.is_360(v.media.where("type = 'video'").select(F.col("id").alias("media_id"), key.alias("key"), value.alias("value")))


@query("F20_infer_author", """
SELECT id, CASE WHEN id % 5 = 0 THEN 'artist_' || id % 3 WHEN carpeta IN ('folder_1', 'folder_10', 'folder_11', 'folder_12', 'folder_13', 'folder_14', 'folder_15', 'folder_16', 'folder_17', 'folder_18', 'folder_19') THEN 'ana'
 WHEN carpeta = 'folder_7' THEN 'bea' WHEN id % 2 = 0 THEN 'Sony X' ELSE carpeta END AS author,
 CASE WHEN id % 5 = 0 THEN 'metadata' WHEN starts_with(carpeta, 'folder_1') OR carpeta = 'folder_7' THEN 'carpeta_mapa' WHEN id % 2 = 0 THEN 'camara' ELSE 'carpeta' END AS author_source FROM {media}""")
def author(v):
    m = v.media
    rows = [m.where(c).select(F.col("id").alias("media_id"), F.lit(k).alias("key"), x.alias("value")) for c, k, x in (("id % 5 = 0", "artist", F.concat(F.lit("artist_"), (F.col("id") % 3).cast("string"))), ("id % 2 = 0", "make", F.lit("Sony")), ("id % 2 = 0", "model", F.lit("X")))]
    folders = v.spark.createDataFrame([("Folder_1", "ana"), ("folder_7", "bea")], "folder string, name string")
    return K.infer_author(m, rows[0].unionByName(rows[1]).unionByName(rows[2]), folders)


@query("F21_resolve_timestamp", """
SELECT id, strftime(CASE WHEN id % 4 = 0 THEN t WHEN id % 4 < 3 THEN t + INTERVAL 3 HOUR ELSE date_trunc('minute', t) + INTERVAL 3 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts,
 CASE WHEN t IS NULL THEN NULL WHEN id % 4 = 0 THEN 'metadata con zona' WHEN id % 4 < 3 THEN 'metadata local' ELSE 'nombre de archivo' END AS note FROM (SELECT id, date_trunc('second', timestamp_utc) AS t FROM {media})""")
def resolve_time(v):
    t = F.date_trunc("second", "timestamp_utc")
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("id") % 4 == 1, F.date_format(t, "yyyy:MM:dd HH:mm:ss")).when(F.col("id") % 4 == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("n/a"))
    name = F.when(F.col("id") % 4 == 3, F.concat(F.lit("IMG_"), F.date_format(t, "yyyyMMdd_HHmm"), F.lit(".jpg"))).otherwise(F.lit("x.jpg"))
    r = v.media.select("id", K.resolve_timestamp(raw, name).alias("r"))
    return r.select("id", F.date_format("r.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "r.note")


@query("F22_resolve_gps", "SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE round(CASE WHEN id % 3 = 0 THEN latitude ELSE -(floor(-latitude) + floor((-latitude - floor(-latitude)) * 60) / 60) END, 6) END AS latitude FROM {media}")
def resolve_gps(v):
    a = -F.col("latitude")
    dms = F.concat(F.floor(a).cast("string"), F.lit("° "), F.floor((a - F.floor(a)) * 60).cast("string"), F.lit("' 0\" S"))
    raw = F.when(F.col("id") % 3 == 0, F.col("latitude").cast("string")).when(F.col("id") % 3 == 1, dms).otherwise(F.lit("unknown"))
    return v.media.select("id", F.round(K.resolve_coordinate(raw, F.lit("")), 6).alias("latitude"))


@query("F23_end_time", "SELECT id, strftime(timestamp_utc + to_seconds(CAST(coalesce(duration_secs, 0) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS end_ts FROM {media}")
def ends(v):
    return v.media.select("id", F.date_format(K.end_time(F.col("timestamp_utc"), F.col("duration_secs")), "yyyy-MM-dd HH:mm:ss").alias("end_ts"))


@query("F24_weekday_local", f"SELECT id AS media_id, 'dia_semana' AS key, ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow({_LOCAL})] AS value FROM {{media}} WHERE timestamp_utc IS NOT NULL")
def weekday(v):
    return K.weekday_rows(v.media)
