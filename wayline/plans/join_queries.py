"""Queries that join in time, in space and by likeness (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sun import epoch_seconds
from ..operators import language as L, matching as M, published as P, spacetime as S
from .book import Book

book = Book()
query = book.query

_T = "epoch_us(timestamp_utc) / 1e6"
_HAV = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _hav(a, b, c, d):
    return _HAV.format(a=a, b=b, c=c, d=d)


@query("J1_infer_gps_by_time", f"""
WITH k AS (SELECT {_T} AS s, min_by((latitude, longitude), id) AS p FROM {{media}} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL GROUP BY 1),
m AS (SELECT id, {_T} AS s FROM {{media}} WHERE latitude IS NULL AND timestamp_utc IS NOT NULL),
a AS (SELECT m.id, m.s, k.s AS s1, k.p AS p1 FROM m ASOF LEFT JOIN k ON m.s >= k.s), b AS (SELECT a.*, k.s AS s2, k.p AS p2 FROM a ASOF LEFT JOIN k ON a.s <= k.s)
SELECT id, round(CASE WHEN s1 IS NULL THEN p2[1] WHEN s2 IS NULL OR s1 = s2 THEN p1[1] ELSE p1[1] + (p2[1] - p1[1]) * (s - s1) / (s2 - s1) END, 6) AS latitude,
 round(CASE WHEN s1 IS NULL THEN p2[2] WHEN s2 IS NULL OR s1 = s2 THEN p1[2] ELSE p1[2] + (p2[2] - p1[2]) * (s - s1) / (s2 - s1) END, 6) AS longitude FROM b""")
def gps(v):
    return S.infer_gps_by_time(v.media).select("id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("J2_nearest_altitude", f"""
WITH k AS (SELECT epoch_us(time) / 1e6 AS s, min_by(elevation, (track_id, elevation)) AS e FROM {{track_points}} WHERE elevation IS NOT NULL GROUP BY 1), m AS (SELECT id, {_T} AS s FROM {{media}} WHERE timestamp_utc IS NOT NULL),
a AS (SELECT m.id, m.s, k.s AS s1, k.e AS e1 FROM m ASOF LEFT JOIN k ON m.s >= k.s), b AS (SELECT a.*, k.s AS s2, k.e AS e2 FROM a ASOF LEFT JOIN k ON a.s < k.s)
SELECT id, CASE WHEN s1 IS NULL OR s2 - s <= s - s1 THEN e2 ELSE e1 END AS altitude, round(CASE WHEN s1 IS NULL OR s2 - s <= s - s1 THEN s2 - s ELSE s - s1 END, 3) AS gap_s FROM b""")
def altitude(v):
    return S.nearest_altitude(v.media, v.track_points).select("id", "altitude", F.round("gap_s", 3).alias("gap_s"))


_SEG = """p AS (SELECT track_id, epoch_us(time) / 1e6 AS s, min((latitude, longitude, elevation)) AS p FROM {track_points} GROUP BY 1, 2),
sg AS (SELECT track_id, s AS s1, lead(s) OVER w AS s2, p AS p1, lead(p) OVER w AS p2 FROM p WINDOW w AS (PARTITION BY track_id ORDER BY s))"""


@query("J3_interpolate_on_track", f"""
WITH {_SEG}
SELECT m.id, track_id, round(p1[1] + (p2[1] - p1[1]) * ({_T} - s1) / (s2 - s1), 6) AS lat, round(p1[2] + (p2[2] - p1[2]) * ({_T} - s1) / (s2 - s1), 6) AS lon, round(p1[3] + (p2[3] - p1[3]) * ({_T} - s1) / (s2 - s1), 4) AS ele
FROM {{media}} m JOIN sg ON {_T} > s1 AND {_T} <= s2""")
def on_track(v):
    asked = v.media.where("timestamp_utc IS NOT NULL").select("id", epoch_seconds(F.col("timestamp_utc")).alias("t_s"))
    out = S.interpolate_on_track(asked, v.track_points)
    return out.select("id", "track_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("ele", 4).alias("ele"))


@query("J3b_interpolate_untimed", """
WITH p AS (SELECT track_id, latitude, longitude, row_number() OVER (PARTITION BY track_id ORDER BY time, latitude) - 1 AS idx FROM {track_points}), n AS (SELECT track_id, max(idx) AS last FROM p GROUP BY track_id),
s AS (SELECT track_id, k, k / 100.0 AS f FROM n, (SELECT unnest(range(0, 101)) AS k)), x AS (SELECT s.*, f * last AS x, floor(f * last) AS i, least(floor(f * last) + 1, last) AS j FROM s JOIN n USING (track_id))
SELECT x.track_id, CAST(k AS INT) AS k, round(a.latitude + (b.latitude - a.latitude) * (x.x - i), 6) AS lat, round(a.longitude + (b.longitude - a.longitude) * (x.x - i), 6) AS lon FROM x JOIN p a ON a.track_id = x.track_id AND a.idx = i JOIN p b ON b.track_id = x.track_id AND b.idx = j""")
def untimed(v):
    from pyspark.sql import Window as W

    p = v.track_points.withColumn("idx", F.row_number().over(W.partitionBy("track_id").orderBy("time", "latitude")) - 1)
    k = v.spark.range(101).select(F.col("id").cast("int").alias("k"), (F.col("id") / 100).alias("f"))
    samples = p.select("track_id").distinct().crossJoin(F.broadcast(k))  # 101 rows
    return S.interpolate_untimed(samples, p).select("track_id", "k", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _spans(v):
    m = v.media.where("timestamp_utc IS NOT NULL").withColumn("start_s", epoch_seconds(F.col("timestamp_utc")))
    return m.select("id", "start_s", (F.col("start_s") + F.coalesce("duration_secs", F.lit(0.0))).alias("end_s"))


_CHOICE = f"""
WITH m AS (SELECT id, {_T} AS a, {_T} + coalesce(duration_secs, 0) AS b FROM {{media}} WHERE timestamp_utc IS NOT NULL), t AS (SELECT track_id, min(epoch_us(time)) / 1e6 AS c, max(epoch_us(time)) / 1e6 AS d FROM {{track_points}} GROUP BY 1),
r AS (SELECT id, track_id, CASE WHEN c <= a AND b <= d THEN 0 WHEN least(b, d) - greatest(a, c) > 0 THEN 1 ELSE 2 END AS k, CASE WHEN c <= a AND b <= d THEN d - c WHEN least(b, d) - greatest(a, c) > 0 THEN -(least(b, d) - greatest(a, c)) ELSE greatest(c - b, a - d, 0) END AS x FROM m, t),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, x, track_id) AS n FROM r)
SELECT id, track_id, ['contiene', 'solapa', 'cercano'][k + 1] AS mode, round(CASE WHEN k = 2 THEN x ELSE 0 END, 3) AS gap_s FROM o WHERE n = 1"""


@query("J4_choose_track", _CHOICE)
def choose(v):
    return S.choose_track(_spans(v), S.track_ranges(v.track_points)).select("id", "track_id", "mode", F.round("gap_s", 3).alias("gap_s"))


@query("J5_resolve_keypoint_position", f"""
WITH {_SEG}, k AS (SELECT k.id, k.media_id, {_T} + offset_secs AS t, m.latitude AS la, m.longitude AS lo FROM {{keypoints}} k LEFT JOIN {{media}} m ON m.id = k.media_id),
x AS (SELECT k.id, min_by((p1[1] + (p2[1] - p1[1]) * (t - s1) / (s2 - s1), p1[2] + (p2[2] - p1[2]) * (t - s1) / (s2 - s1)), track_id) AS p FROM k JOIN sg ON t > s1 AND t <= s2 WHERE la IS NULL GROUP BY k.id)
SELECT id, media_id, round(coalesce(la, p[1]), 6) AS lat, round(coalesce(lo, p[2]), 6) AS lon, CASE WHEN la IS NOT NULL THEN 'medio' WHEN p IS NOT NULL THEN 'track' END AS position_source FROM k LEFT JOIN x USING (id)""")
def keypoint_position(v):
    out = S.resolve_keypoint_position(v.keypoints, v.media, v.track_points)
    return out.select("id", "media_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "position_source")


@query("J6_track_discrepancies", f"""
WITH {_SEG}, x AS (SELECT m.id, track_id, latitude AS a, longitude AS b, p1[1] + (p2[1] - p1[1]) * ({_T} - s1) / (s2 - s1) AS c, p1[2] + (p2[2] - p1[2]) * ({_T} - s1) / (s2 - s1) AS d FROM {{media}} m JOIN sg ON {_T} > s1 AND {_T} <= s2 WHERE latitude IS NOT NULL AND geolocation_source = 'metadata')
SELECT id, track_id, round({_hav('a', 'b', 'c', 'd')}, 2) AS metres FROM x WHERE {_hav('a', 'b', 'c', 'd')} > 100""")
def discrepancies(v):
    return S.track_discrepancies(v.media, v.track_points, 100).select("id", "track_id", F.round("metres", 2).alias("metres"))


@query("J7_nearest_photos", f"""
WITH k AS (SELECT id AS kp_id, latitude AS a, longitude AS b FROM {{media}} WHERE latitude IS NOT NULL AND type = 'video'), f AS (SELECT id AS photo_id, latitude AS c, longitude AS d FROM {{media}} WHERE latitude IS NOT NULL AND type = 'image'),
x AS (SELECT kp_id, photo_id, {_hav('a', 'b', 'c', 'd')} AS m FROM k, f WHERE abs(a - c) < 1), r AS (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY m, photo_id) AS rank FROM x)
SELECT kp_id, photo_id, round(m, 2) AS metres, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def photos(v):
    m = v.media.where("latitude IS NOT NULL")
    at = [F.col("latitude").alias("lat"), F.col("longitude").alias("lon")]
    out = S.nearest_photos(m.where("type = 'video'").select(F.col("id").alias("kp_id"), *at), m.where("type = 'image'").select("id", *at), 3)
    return out.select("kp_id", "photo_id", F.round("metres", 2).alias("metres"), "rank")


@query("J7b_photos_by_time", f"""
WITH k AS (SELECT id AS kp_id, {_T} AS t FROM {{media}} WHERE latitude IS NULL AND timestamp_utc IS NOT NULL AND type = 'video'), f AS (SELECT id AS photo_id, {_T} AS s FROM {{media}} WHERE timestamp_utc IS NOT NULL AND type = 'image'),
r AS (SELECT kp_id, photo_id, abs(s - t) AS d, row_number() OVER (PARTITION BY kp_id ORDER BY abs(s - t), photo_id) AS r FROM k, f) SELECT kp_id, photo_id, round(d, 3) AS delta_s FROM r WHERE r <= 2""")
def by_time(v):
    m = v.media.where("timestamp_utc IS NOT NULL").withColumn("t_s", epoch_seconds(F.col("timestamp_utc")))
    none = v.spark.createDataFrame([], "kp_id long, photo_id long")
    asked = m.where("latitude IS NULL AND type = 'video'").select(F.col("id").alias("kp_id"), "t_s")
    return S.fill_by_time(asked, m.where("type = 'image'").select("id", "t_s"), none, 2).select("kp_id", "photo_id", F.round("delta_s", 3).alias("delta_s"))


@query("J8_infer_time_from_position", f"""
WITH p AS (SELECT track_id::BIGINT * 1000000000 + row_number() OVER (PARTITION BY track_id ORDER BY time, latitude) AS n, epoch_us(time) / 1e6 AS t, latitude AS c, longitude AS d FROM {{track_points}}), x AS (SELECT id, latitude AS a, longitude AS b FROM {{media}} WHERE type = 'text' AND latitude IS NOT NULL),
r AS (SELECT id, a, b, n, t, {_hav('a', 'b', 'c', 'd')} AS m, row_number() OVER (PARTITION BY id ORDER BY {_hav('a', 'b', 'c', 'd')}, n) AS k FROM x, p), g AS (SELECT u.id, u.a, u.b, u.n, u.t AS t1, u.m AS d1, w.t AS t2, w.m AS d2 FROM r u JOIN r w ON w.id = u.id AND u.k = 1 AND w.k = 2),
h AS (SELECT g.id, min(({_hav('g.a', 'g.b', 'c', 'd')}, p.n, p.t)) AS c FROM g JOIN p ON p.n IN (g.n - 1, g.n + 1) WHERE abs(t1 - t2) > 7200 GROUP BY g.id), z AS (SELECT g.id, t1, d1, CASE WHEN c IS NULL THEN t2 ELSE c[3] END AS t2, CASE WHEN c IS NULL THEN d2 ELSE c[1] END AS d2 FROM g LEFT JOIN h USING (id))
SELECT id, round(CASE WHEN d1 + d2 = 0 THEN t1 ELSE (t1 * d2 + t2 * d1) / (d1 + d2) END, 1) AS t_s FROM z""")
def time_from_place(v):
    from pyspark.sql import Window as W

    at = [F.col("latitude").alias("lat"), F.col("longitude").alias("lon")]
    number = F.row_number().over(W.partitionBy("track_id").orderBy("time", "latitude")).cast("long")
    route = v.track_points.select((F.col("track_id").cast("long") * 1_000_000_000 + number).alias("point_id"), epoch_seconds(F.col("time")).alias("t_s"), *at)
    texts = v.media.where("type = 'text' AND latitude IS NOT NULL").select("id", *at)
    return S.infer_time_from_position(texts, route).select("id", F.round("t_s", 1).alias("t_s"))


@query("J9_messages_for_places", """
WITH s AS (SELECT municipio, CAST(min(timestamp_utc) AS DATE) AS a, CAST(max(timestamp_utc) AS DATE) AS b FROM {media} WHERE municipio IN ('NATION_3', 'NATION_8') AND timestamp_utc IS NOT NULL GROUP BY municipio)
SELECT municipio, id AS message_id, from_name, text[:250] AS text, round(hour(t) + minute(t) / 60.0 + second(t) / 3600.0, 6) AS local_hour FROM (SELECT *, date_utc - INTERVAL 3 HOUR AS t FROM {messages} WHERE es_sistema = 0) m JOIN s ON CAST(date_utc AS DATE) BETWEEN a AND b""")
def messages(v):
    out = S.messages_for_places(v.media, v.messages, ["NATION_3", "NATION_8"])
    return out.withColumn("local_hour", F.round("local_hour", 6))


@query("J10_attach_weather", """
WITH m AS (SELECT id, CAST(timestamp_utc AS DATE) AS day, hour(timestamp_utc) AS h, CAST(floor(latitude * 10 + 0.5) AS INT) AS lat_bin, CAST(floor(longitude * 10 + 0.5) AS INT) AS lon_bin FROM {media} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL),
w AS (SELECT m.id, min_by((w.hour, temperature, code, wind_degrees), (abs(w.hour - h), w.hour)) AS x FROM m JOIN {hourly_weather} w USING (day, lat_bin, lon_bin) GROUP BY m.id)
SELECT id AS media_id, 'weather_temp_c' AS key, printf('%.3f', x[2]) AS value FROM w UNION ALL SELECT id, 'weather_code', CAST(x[3] AS VARCHAR) FROM w UNION ALL SELECT id, 'weather_label', ['despejado', 'mayormente despejado', 'parcialmente nublado', 'nublado'][x[3] + 1] FROM w
UNION ALL SELECT id, 'weather_hour_utc', CAST(x[1] AS VARCHAR) FROM w UNION ALL SELECT id, 'weather_wind_dir_text', ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO'][CAST(round_even(x[4] / 22.5, 0) AS INT) % 16 + 1] FROM w""")
def weather(v):
    return S.attach_weather(v.media, v.hourly_weather)


@query("J11_attach_places", "SELECT id, min((g.municipio, g.provincia))[1] AS municipio, min((g.municipio, g.provincia))[2] AS provincia FROM {media} m JOIN {gazetteer} g ON latitude >= lat_min AND latitude < lat_max AND longitude >= lon_min AND longitude < lon_max GROUP BY id")
def places(v):
    return S.attach_places(v.media, v.gazetteer)


@query("J12_pending", "SELECT id FROM {media} WHERE id NOT IN (SELECT media_id FROM {metadata} WHERE key IN ('weather_label', 'weather_error'))")
def pending(v):
    return M.pending(v.media, v.metadata, ["weather_label", "weather_error"]).select("id")


@query("J13_published_media", """
WITH s AS (SELECT media_id, string_agg(trim(texto), ' ' ORDER BY inicio) AS t FROM {segments} WHERE trim(texto) <> '' GROUP BY media_id),
w AS (SELECT media_id, key, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT media_id, key, CASE WHEN value LIKE '[%' THEN from_json(value, '["VARCHAR"]') ELSE string_split(value, ', ') END AS p FROM {metadata} WHERE key LIKE 'ia_keywords%')),
u AS (SELECT media_id, key, min_by(w, i) AS w, min(i) AS i FROM w WHERE w <> '' GROUP BY media_id, key, lower(w)), k AS (SELECT media_id, key, string_agg(w, ', ' ORDER BY i) AS k FROM u GROUP BY media_id, key),
m AS (SELECT *, timestamp_utc - INTERVAL 3 HOUR AS lt FROM {media})
SELECT m.id, type, strftime(lt, '%Y-%m-%d') AS date, strftime(lt, '%H:%M') AS time, CAST(month(lt) AS INT) AS month, CAST(year(lt) AS INT) AS year, md5(coalesce(x.value, '')) AS description_md5, coalesce(a.k, b.k, '') AS keywords, s.t[:600] AS transcript
FROM m LEFT JOIN s ON s.media_id = m.id LEFT JOIN (SELECT media_id, min(value) AS value FROM {metadata} WHERE key = 'texto_completo' GROUP BY media_id) x ON x.media_id = m.id AND type = 'text'
LEFT JOIN k a ON a.media_id = m.id AND a.key = 'ia_keywords' AND type IN ('image', 'video') LEFT JOIN k b ON b.media_id = m.id AND b.key = 'ia_keywords_sonido' AND type IN ('audio', 'video')""")
def published(v):
    out = P.published_media(v.media, v.metadata, v.segments)
    return out.select("id", "type", "date", "time", "month", "year", F.md5(F.coalesce("description", F.lit(""))).alias("description_md5"), "keywords", "transcript")


@query("J14_track_slice_per_place", """
WITH s AS (SELECT municipio, min(timestamp_utc) AS a, max(timestamp_utc) AS b FROM {media} WHERE municipio IS NOT NULL GROUP BY municipio)
SELECT municipio, track_id, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time FROM {track_points} JOIN s ON time BETWEEN a AND b""")
def slices(v):
    return S.track_slice_per_place(v.media, v.track_points).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_WINDOWS = "(SELECT e.event_id AS media_id, CAST(e.event_id % 6 AS INT) AS win, lower(p_type) AS label, value / 500 AS prob FROM {events} e JOIN {part} ON p_partkey = e.event_id % 200 WHERE event_type IN ('click', 'purchase'))"


def window_scores(v):
    e = v.events.where("event_type IN ('click', 'purchase')").join(v.part, F.col("p_partkey") == F.col("event_id") % 200)
    return e.select(F.col("event_id").alias("media_id"), (F.col("event_id") % 6).cast("int").alias("window"), F.lower("p_type").alias("label"), (F.col("value") / 500).alias("prob"))


@query("J15_audio_frame_crossref", f"SELECT media_id, win AS \"window\", label, unnest(range(CAST(ceil(win * 10 / 3.0) AS BIGINT), CAST(ceil((win + 1) * 10 / 3.0) AS BIGINT))) AS frame FROM {_WINDOWS} WHERE prob >= 0.15")
def frames(v):
    return S.audio_frame_crossref(window_scores(v), 3.0)


@query("J16_dialogue_at_photo", """
WITH p AS (SELECT id, timestamp_utc AS ts FROM {media} WHERE type = 'image' AND timestamp_utc IS NOT NULL), s0 AS (SELECT m.timestamp_utc + to_microseconds(CAST(inicio * 1000000 AS BIGINT)) AS ts, media_id, texto FROM {segments} JOIN {media} m ON m.id = media_id WHERE m.timestamp_utc IS NOT NULL),
s AS (SELECT ts, min_by(texto, (media_id, texto)) AS texto FROM s0 GROUP BY ts)
SELECT p.id, texto, round((epoch_us(p.ts) - epoch_us(s.ts)) / 1e6, 3) AS gap_s FROM p ASOF JOIN s ON p.ts >= s.ts""")
def dialogue(v):
    base = v.media.where("timestamp_utc IS NOT NULL")
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("inicio").cast("decimal(18,6)"))
    said = v.segments.join(base.select(F.col("id").alias("media_id"), "timestamp_utc"), "media_id").select("media_id", (F.col("timestamp_utc") + second).alias("ts"), "texto")
    out = S.dialogue_at_photo(base.where("type = 'image'").select("id", F.col("timestamp_utc").alias("ts")), said)
    return out.withColumn("gap_s", F.round("gap_s", 3))


@query("J17_glossary_votes", """
WITH w AS (SELECT media_id, lower(trim(trim(x, '"'))) AS w, i FROM (SELECT media_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT media_id, CASE WHEN value LIKE '[%' THEN from_json(value, '["VARCHAR"]') ELSE string_split(value, ', ') END AS p FROM {metadata} WHERE key = 'ia_keywords'))),
c AS (SELECT w AS word, w || '_' || (media_id % 3) AS translation, count(*) AS votes, min((media_id, i)) AS f FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY votes DESC, f) AS n FROM c) SELECT word, translation, votes FROM r WHERE n = 1""")
def votes(v):
    from ..functions.text import split_keywords

    words = v.metadata.where("key = 'ia_keywords'").select("media_id", split_keywords(F.col("value")).alias("source"))
    target = F.transform("source", lambda w: F.concat(w, F.lit("_"), (F.col("media_id") % 3).cast("string")))
    return L.glossary_votes(words.withColumn("target", target))


@query("J18_match_place_names", """
WITH o AS (SELECT n_name || ' del ' || r_name AS name, lower(n_name || ' del ' || r_name) AS f, r_name AS p FROM {nation} JOIN {region} ON r_regionkey = n_regionkey),
t AS (SELECT name AS tag, lower(name) AS f, p FROM o UNION ALL SELECT replace(name, 'NATION', 'NACION') , lower(replace(name, 'NATION', 'NACION')), p FROM o UNION ALL SELECT n_name, lower(n_name), r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey),
x AS (SELECT tag, name, 'A' AS category, 0 AS distance, 0 AS d FROM t JOIN o USING (f) UNION ALL SELECT tag, name, 'B', levenshtein(t.f, o.f), levenshtein(t.f, o.f) FROM t JOIN o ON t.f <> o.f AND t.p = o.p AND levenshtein(t.f, o.f) <= 2
 UNION ALL SELECT tag, name, 'C', len(string_split(o.f, ' ')), 0 FROM t JOIN o ON t.f <> o.f AND t.p = o.p AND list_has_all(string_split(o.f, ' '), string_split(t.f, ' ')))
SELECT tag, name AS official, category, CAST(distance AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY category, d, name) AS n FROM x) WHERE n = 1""")
def place_names(v):
    n = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.array("r_name").alias("provinces"), F.concat("n_name", F.lit(" del "), "r_name").alias("name"))
    tags = n.select(F.col("name").alias("tag"), "provinces").unionByName(n.select(F.regexp_replace("name", "NATION", "NACION").alias("tag"), "provinces")).unionByName(n.select(F.col("n_name").alias("tag"), "provinces"))
    return M.match_place_names(tags, n.select("name", "provinces"))


@query("J19_repeated_passages")
def passages(v):
    per = v.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("values"))
    return M.repeated_passages(per.select(F.col("user_id").alias("id"), "values"), least=0.3)


@query("J20_remove_linked", "SELECT 'media' AS what, count(*) AS n FROM {media} WHERE id NOT IN (SELECT chat_id FROM {messages} WHERE from_name = 'system') UNION ALL SELECT 'metadata', count(*) FROM {metadata} WHERE media_id NOT IN (SELECT chat_id FROM {messages} WHERE from_name = 'system')")
def removed(v):
    links = v.messages.where("from_name = 'system'").select(F.col("chat_id").alias("media_id"))
    out = M.remove_linked(v.media, {"metadata": v.metadata}, links)
    count = lambda n: out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    return count("media").unionByName(count("metadata"))


@query("J21_map_base_points", "WITH s AS (SELECT media_id, count(*) AS n, string_agg(texto, ' ' ORDER BY inicio, texto) AS t FROM {segments} GROUP BY media_id) SELECT id, type, latitude, longitude, coalesce(n, 0) AS n_segments, coalesce(t, '') AS text FROM {media} LEFT JOIN s ON media_id = id WHERE latitude IS NOT NULL")
def base_points(v):
    return S.map_base_points(v.media, v.segments)
