"""Queries along time (W)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.sun import epoch_seconds
from ..operators import sequences as Q, spacetime as S
from ..operators.route import route_gradients
from ..operators.similarity import greedy_similarity_groups
from .aggregate_queries import ROUTE
from .book import Book
from .function_queries import SUN_STEPS, TWILIGHT

book = Book()
query = book.query


@query("W1_route_gradients", f"""WITH {ROUTE} SELECT id, round(d, 2) AS distance_m, round(e, 2) AS gain_m, round(CASE WHEN d > 0 THEN 100 * e / d WHEN e IS NOT NULL AND d IS NOT NULL THEN 0 END, 4) AS gradient_pct,
round(sum(coalesce(d, 0)) OVER w, 2) AS cumul_m, round(sum(CASE WHEN e > 0 THEN e ELSE 0 END) OVER w, 2) AS cumul_gain_m FROM g WINDOW w AS (ORDER BY timestamp_utc, id ROWS UNBOUNDED PRECEDING)""")
def route(v):
    return route_gradients(v.media)


_T = "epoch_us(timestamp_utc) / 1e6"
_SAMPLES = f"""t AS (SELECT id AS media_id, k * 60 AS offset_s, {_T} + k * 60 AS t, latitude AS la, longitude AS lo, altitude AS al FROM {{media}}, (SELECT unnest(range(0, 20)) AS k) WHERE timestamp_utc IS NOT NULL AND type IN ('video', 'audio') AND k <= floor(greatest(coalesce(duration_secs, 0), 0) / 60)),
m AS (SELECT id, {_T} AS a, {_T} + coalesce(duration_secs, 0) AS b FROM {{media}} WHERE timestamp_utc IS NOT NULL AND type IN ('video', 'audio')), tr AS (SELECT track_id, min(epoch_us(time)) / 1e6 AS c, max(epoch_us(time)) / 1e6 AS d FROM {{track_points}} GROUP BY 1),
r AS (SELECT id, track_id, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN c <= a AND b <= d THEN 0 WHEN least(b, d) - greatest(a, c) > 0 THEN 1 ELSE 2 END, CASE WHEN c <= a AND b <= d THEN d - c WHEN least(b, d) - greatest(a, c) > 0 THEN -(least(b, d) - greatest(a, c)) ELSE greatest(c - b, a - d, 0) END, track_id) AS n FROM m, tr),
p AS (SELECT track_id, epoch_us(time) / 1e6 AS s, min((latitude, longitude, elevation)) AS p FROM {{track_points}} GROUP BY 1, 2), sg AS (SELECT track_id, s AS s1, lead(s) OVER w AS s2, p AS p1, lead(p) OVER w AS p2 FROM p WINDOW w AS (PARTITION BY track_id ORDER BY s)),
f AS (SELECT t.*, sg.s2 - sg.s1 AS seg_s, sg.s1 IS NOT NULL AS ok, p1[1] + (p2[1] - p1[1]) * (t - s1) / (s2 - s1) AS a, p1[2] + (p2[2] - p1[2]) * (t - s1) / (s2 - s1) AS b, p1[3] + (p2[3] - p1[3]) * (t - s1) / (s2 - s1) AS c FROM t JOIN r ON r.id = media_id AND n = 1 LEFT JOIN sg ON sg.track_id = r.track_id AND t > s1 AND t <= s2),
samples AS (SELECT media_id, offset_s, t AS t_s, CASE WHEN ok THEN a ELSE la END AS lat, CASE WHEN ok THEN b ELSE lo END AS lon, CASE WHEN ok THEN c ELSE al END AS ele, CASE WHEN ok THEN 'track_interpolado' WHEN la IS NOT NULL THEN 'gps_propio' END AS source FROM f)"""


def samples(v):
    return Q.sample_media(v.media.where("type IN ('video', 'audio')"), v.track_points, S.track_ranges(v.track_points), 60)


@query("W2_sample_media", f"WITH {_SAMPLES} SELECT media_id, CAST(offset_s AS INT) AS offset_s, round(lat, 6) AS lat, round(lon, 6) AS lon, round(ele, 4) AS ele, source FROM samples")
def sample(v):
    return samples(v).select("media_id", "offset_s", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("ele", 4).alias("ele"), "source")


@query("W3_elevation_transitions", f"WITH {_SAMPLES}, d AS (SELECT *, ele - lag(ele) OVER (PARTITION BY media_id ORDER BY offset_s) AS d FROM samples) SELECT media_id, CAST(offset_s AS INT) AS offset_s, CASE WHEN d > 0 THEN 'subida' ELSE 'bajada' END AS direction FROM d WHERE abs(d) >= 2")
def elevation(v):
    return Q.elevation_transitions(samples(v), 2).select("media_id", "offset_s", F.split("value", " ")[0].alias("direction"))


@query("W4_daylight_transitions", f"""WITH {_SAMPLES}, z AS (WITH a AS (SELECT media_id, offset_s, lat, lon, t_s AS s FROM samples), {SUN_STEPS} SELECT media_id, offset_s, {TWILIGHT} AS value FROM k),
x AS (SELECT *, lag(value) OVER (PARTITION BY media_id ORDER BY offset_s) AS q FROM z) SELECT media_id, CAST(offset_s AS INT) AS offset_s, value FROM x WHERE value IS NOT NULL AND value IS DISTINCT FROM q""")
def daylight(v):
    return Q.daylight_transitions(samples(v))


_HAV = "CASE WHEN la IS NOT NULL AND lat IS NOT NULL THEN 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) END"


@query("W5_motion_transitions", f"""WITH {_SAMPLES}, d AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(offset_s) OVER w AS p FROM samples WINDOW w AS (PARTITION BY media_id ORDER BY offset_s)),
s AS (SELECT media_id, offset_s, CASE WHEN {_HAV} / 60 * 3.6 >= 0.0437 THEN 'en movimiento' WHEN {_HAV} IS NOT NULL THEN 'detenido' END AS value FROM d WHERE p IS NOT NULL), x AS (SELECT *, lag(value) OVER (PARTITION BY media_id ORDER BY offset_s) AS q FROM s)
SELECT media_id, CAST(offset_s AS INT) AS offset_s, value FROM x WHERE value IS NOT NULL AND value IS DISTINCT FROM q""")
def motion(v):
    return Q.motion_transitions(samples(v), 0.0437)


@query("W6_coarse_samples", f"""WITH {_SAMPLES}, l AS (SELECT media_id, max(offset_s) AS last FROM samples GROUP BY 1), w AS (SELECT media_id, k * 150 AS spot FROM l, (SELECT unnest(range(0, 20)) AS k) WHERE k * 150 <= last)
SELECT DISTINCT media_id, CAST(o AS INT) AS offset_s FROM (SELECT w.media_id, spot, min_by(offset_s, (abs(offset_s - spot), offset_s)) AS o FROM w JOIN samples USING (media_id) GROUP BY 1, 2)""")
def coarse(v):
    return Q.coarse_samples(samples(v), 150).select("media_id", "offset_s")


@query("W7_place_transitions", f"""WITH {_SAMPLES}, g AS (SELECT media_id, offset_s, min((g.municipio, g.provincia)) AS p FROM samples JOIN {{gazetteer}} g ON lat >= lat_min AND lat < lat_max AND lon >= lon_min AND lon < lon_max GROUP BY 1, 2),
d AS (SELECT s.media_id, s.offset_s, 'municipio: ' || p[1] || ' (' || p[2] || ')' AS value FROM samples s LEFT JOIN g USING (media_id, offset_s)), x AS (SELECT *, lag(value) OVER (PARTITION BY media_id ORDER BY offset_s) AS q FROM d)
SELECT media_id, CAST(offset_s AS INT) AS offset_s, value FROM x WHERE value IS NOT NULL AND value IS DISTINCT FROM q""")
def place_changes(v):
    return Q.place_transitions(S.with_places(samples(v), v.gazetteer, "lat", "lon"))


@query("W7b_weather_transitions", f"""WITH {_SAMPLES}, w AS (SELECT media_id, offset_s, CASE WHEN (media_id + offset_s // 60) % 5 = 4 THEN NULL ELSE (media_id + offset_s // 180) % 3 END AS code, CAST((media_id * 7 + offset_s // 60 * 4) % 30 AS DOUBLE) AS temp FROM samples),
runs AS (SELECT *, sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY offset_s) AS run FROM w), d AS (SELECT *, lag(code) OVER x AS pc, lag(temp) OVER x AS pt FROM runs WHERE code IS NOT NULL WINDOW x AS (PARTITION BY media_id, run ORDER BY offset_s))
SELECT media_id, CAST(offset_s AS INT) AS offset_s, 'clima: ' || ['despejado', 'mayormente despejado', 'parcialmente nublado'][code + 1] || printf(', %.1f°C', temp) AS value FROM d WHERE code IS DISTINCT FROM pc OR abs(temp - pt) >= 5""")
def weather_changes(v):
    s = samples(v)
    k = F.floor(F.col("offset_s") / 60)
    w = s.select("media_id", "offset_s", F.when((F.col("media_id") + k) % 5 != 4, (F.col("media_id") + F.floor(F.col("offset_s") / 180)) % 3).alias("code"), ((F.col("media_id") * 7 + k * 4) % 30).cast("double").alias("temperature"))
    return Q.weather_transitions(s, w)


def video_samples(v):
    """Samples every 30 s of all videos, and one more at their ends, on their best tracks."""
    s = Q.track_samples(v.media.where("type = 'video'"), v.track_points, S.track_ranges(v.track_points), 30, ends=True)
    return s.select("media_id", "offset_s", "t_s", "p.lat", "p.lon", "seg_s", "is_end")


@query("W8_video_positions")
def positions(v):
    return Q.video_positions(video_samples(v), 40_000, 5, 0.05)


_RANKED = f"""
WITH r AS (SELECT id, carpeta, {_T} AS s, row_number() OVER (PARTITION BY carpeta ORDER BY <order>) AS n FROM {{media}}), a AS (SELECT *, CASE WHEN s IS NOT NULL THEN (n, s) END AS x FROM r),
b AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY carpeta ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(x IGNORE NULLS) OVER (PARTITION BY carpeta ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM a)
SELECT id, round(p[2] + (q[2] - p[2]) * (n - p[1]) / (q[1] - p[1]), 2) AS t_s FROM b WHERE s IS NULL AND p IS NOT NULL AND q IS NOT NULL"""


@query("W9_infer_timestamps_by_rank", _RANKED.replace("<order>", "id"))
def by_rank(v):
    return Q.infer_timestamps_by_rank(v.media).select("id", F.round("t_s", 2).alias("t_s"))


@query("W9b_infer_timestamps_by_path", _RANKED.replace("<order>", "carpeta || '/' || substr(file_hash, 1, 3) || '.jpg', id"))
def by_path(v):
    """Paths are not unique here: hashes cut to three digits."""
    media = v.media.withColumn("path", F.concat("carpeta", F.lit("/"), F.substring("file_hash", 1, 3), F.lit(".jpg")))
    return Q.infer_timestamps_by_rank(media, "path").select("id", F.round("t_s", 2).alias("t_s"))


_LOCAL = "(timestamp_utc - INTERVAL 3 HOUR)"


def hourly_media(v):
    from ..functions.weather import local_hour

    return v.media.where("timestamp_utc IS NOT NULL").withColumn("hour", local_hour(F.col("timestamp_utc")))


@query("W11_place_entry_exit", f"""
WITH m AS (SELECT id, {_T} AS o, hour({_LOCAL}) AS h, provincia, municipio FROM {{media}} WHERE timestamp_utc IS NOT NULL),
l AS (SELECT *, last_value(provincia IGNORE NULLS) OVER w AS pp, last_value(municipio IGNORE NULLS) OVER w AS pm FROM m WINDOW w AS (ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT id, o, h, 'Entramos a ' || provincia AS text, 'provincia_entra' AS kind, 1 AS k FROM l WHERE provincia IS NOT NULL AND provincia IS DISTINCT FROM pp UNION ALL SELECT id, o, h, 'Salimos de ' || pp, 'provincia_sale', 0 FROM l WHERE provincia IS NOT NULL AND pp IS NOT NULL AND provincia <> pp
 UNION ALL SELECT id, o, h, 'Entramos a ' || municipio, 'municipio_entra', 3 FROM l WHERE municipio IS NOT NULL AND municipio IS DISTINCT FROM pm UNION ALL SELECT id, o, h, 'Salimos de ' || pm, 'municipio_sale', 2 FROM l WHERE municipio IS NOT NULL AND pm IS NOT NULL AND municipio <> pm)
SELECT min_by(id, (o, id, k)) AS id, min_by(kind, (o, id, k)) AS kind, text, CAST(h AS INT) AS hour FROM e GROUP BY text, h""")
def entries(v):
    return Q.place_entry_exit(hourly_media(v)).select("id", "kind", "text", F.floor("hour").cast("int").alias("hour"))


_IMG = f"(SELECT id, {_T} AS s FROM {{media}} WHERE type = 'image' AND timestamp_utc IS NOT NULL)"


def images(v):
    return v.media.where("type = 'image' AND timestamp_utc IS NOT NULL").select("id", F.col("timestamp_utc").alias("ts"))


@query("W12_anchored_time_groups", f"""
WITH RECURSIVE i AS (SELECT id, s, row_number() OVER (ORDER BY s, id) AS n FROM {_IMG}),
g AS (SELECT n, id, s, id AS lead, s AS first FROM i WHERE n = 1 UNION ALL SELECT i.n, i.id, i.s, CASE WHEN i.s - g.first <= 7200 THEN g.lead ELSE i.id END, CASE WHEN i.s - g.first <= 7200 THEN g.first ELSE i.s END FROM g JOIN i ON i.n = g.n + 1)
SELECT id, lead AS "group" FROM g""")
def anchored(v):
    return Q.anchored_time_groups(images(v), 120).select("id", "group")


@query("W13_gap_sessions", f"""
WITH i AS (SELECT id, s, lag(s) OVER (ORDER BY s, id) AS p FROM {_IMG}), b AS (SELECT *, CASE WHEN p IS NULL OR s - p > 1800 THEN id END AS x FROM i)
SELECT id, last_value(x IGNORE NULLS) OVER (ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM b""")
def sessions(v):
    return Q.gap_sessions(images(v), 1800).select("id", "session")


def _hash(c: str) -> str:
    """60 bits of a text's MD5, in SQL."""
    return f"('0x' || substr(md5({c}), 1, 15))::BIGINT"


def _bursts(v):
    hashed = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    texts = v.documents.groupBy(F.col("doc_id").alias("k")).agg(F.min(hashed).alias("hash"))
    n = F.broadcast(v.documents.agg(F.greatest(F.max("doc_id") + 1, F.lit(1)).alias("n")))  # one row
    return images(v).crossJoin(n).withColumn("k", F.col("id") % F.col("n")).join(texts, "k", "left").select("id", "ts", "hash", (F.col("id") * 37 % 101).cast("double").alias("score"))


def _led(items: str, near: str) -> str:
    """Leads of rows (g, n, id, item; n from 1 in each group) by going through each group in order, with the leaders so far as the state."""
    return f"""i AS ({items}),
r AS (SELECT g, n, id, item, id AS lead, [{{'k': id, 'x': item}}] AS heads FROM i WHERE n = 1
 UNION ALL SELECT g, n, id, item, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(heads, {{'k': id, 'x': item}}) ELSE heads END
 FROM (SELECT i.g, i.n, i.id, i.item, r.heads, list_filter(r.heads, lambda h: coalesce({near}, false))[1].k AS hit FROM r JOIN i ON i.g = r.g AND i.n = r.n + 1))"""


_BURSTS = _led(
    f"""SELECT a.lead AS g, a.id, b.h AS item, row_number() OVER (PARTITION BY a.lead ORDER BY a.s, a.id) AS n
 FROM g a LEFT JOIN (SELECT doc_id, min({_hash('text')}) AS h FROM {{documents}} GROUP BY doc_id) b ON b.doc_id = a.id % (SELECT greatest(max(doc_id) + 1, 1) FROM {{documents}})""",
    "bit_count(xor(h.x, i.item)) <= 24",
)


def _anchored_sql(minutes: int) -> str:
    return f"""WITH RECURSIVE q AS (SELECT id, s, row_number() OVER (ORDER BY s, id) AS n FROM {_IMG}),
g AS (SELECT n, id, s, id AS lead, s AS first FROM q WHERE n = 1 UNION ALL SELECT q.n, q.id, q.s, CASE WHEN q.s - g.first <= {minutes * 60} THEN g.lead ELSE q.id END, CASE WHEN q.s - g.first <= {minutes * 60} THEN g.first ELSE q.s END FROM g JOIN q ON q.n = g.n + 1)"""


@query("W14_greedy_similarity_groups", f"{_anchored_sql(240)},\n{_BURSTS}\nSELECT id, lead FROM r")
def similar(v):
    grouped = Q.anchored_time_groups(_bursts(v), 240)
    return greedy_similarity_groups(grouped.select("group", F.col("ts").alias("ord"), "id", F.col("hash").alias("item")), "hamming", 24)


_TAGGED = _led(
    "SELECT user_id AS g, event_id AS id, list_sort(list_distinct(string_split(p_name, ' '))) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events} JOIN {part} ON p_partkey = event_id % 200 WHERE event_type = 'view'",
    "len(list_intersect(h.x, i.item)) >= 2",
)


@query("W14b_groups_by_tags", f"WITH RECURSIVE {_TAGGED}\nSELECT id, lead FROM r")
def similar_tags(v):
    """Pictures of each user that share two keywords or more."""
    tagged = v.events.where("event_type = 'view'").join(v.part, F.col("event_id") % 200 == F.col("p_partkey"))
    rows = tagged.select(F.col("user_id").alias("group"), F.col("ts").alias("ord"), F.col("event_id").alias("id"), F.split("p_name", " ").alias("item"))
    return greedy_similarity_groups(rows, "tags", 2)


_VECTORS = _led("SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM {embeddings}", "list_cosine_similarity(h.x, i.item) >= 0.8")


@query("W14c_groups_by_cosine", f"WITH RECURSIVE {_VECTORS}\nSELECT id, lead FROM r")
def similar_vectors(v):
    """Vectors of each label with a cosine of 0.8 or more."""
    rows = v.embeddings.select(F.col("label").alias("group"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.col("embedding").alias("item"))
    return greedy_similarity_groups(rows, "cosine", 0.8)


@query("W15_best_of_group", "WITH r AS (SELECT id, carpeta, row_number() OVER (PARTITION BY carpeta ORDER BY altitude DESC NULLS LAST, id) AS n FROM {media}) SELECT id, carpeta FROM r WHERE n <= 3")
def best(v):
    return Q.best_of_group(v.media, "carpeta", "altitude", 3).select("id", "carpeta")


@query("W16_clean_bursts", f"""{_anchored_sql(240)},
{_BURSTS},
s AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY (id * 37 % 101) DESC, id) = 1 AS kept, count(*) OVER (PARTITION BY lead) AS c FROM r)
SELECT id, g AS "group", lead, kept, CASE WHEN c = 1 THEN 'unica' WHEN kept THEN 'mejor de su tanda' ELSE 'similar a otra mejor' END AS reason FROM s""")
def bursts(v):
    return Q.clean_bursts(_bursts(v), 240, 24)


@query("W17_scenes", """
WITH c AS (SELECT id AS media_id, duration_secs AS d, unnest([0.0, (id * 7) % duration_secs, (id * 13) % duration_secs, duration_secs]) AS a FROM {media} WHERE type = 'video' AND duration_secs > 0), b AS (SELECT DISTINCT media_id, a FROM c),
s AS (SELECT media_id, a, lead(a) OVER (PARTITION BY media_id ORDER BY a) AS b FROM b), p AS (SELECT media_id, a, b, CAST(ceil((b - a) / 200.0) AS INT) AS n FROM s WHERE b - a >= 0.05),
q AS (SELECT media_id, a + k * ((b - a) / n) AS x, a + (k + 1) * ((b - a) / n) AS y FROM p, (SELECT unnest(range(0, 60)) AS k) WHERE k < n), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY x) AS scene FROM q)
SELECT media_id, CAST(scene AS INT) AS scene, round(x, 4) AS start_s, round(y, 4) AS end_s, CAST(k AS INT) AS sample, round(x + (y - x) * (k + 0.5) / 2, 4) AS t_s FROM r, (SELECT unnest([0, 1]) AS k)""")
def scene_list(v):
    m = v.media.where("type = 'video' AND duration_secs > 0").select(F.col("id").alias("media_id"), F.col("duration_secs").alias("duration_s"), F.explode(F.array(F.lit(7), F.lit(13))).alias("k"))
    cuts = m.select("media_id", "duration_s", ((F.col("media_id") * F.col("k")).cast("double") % F.col("duration_s")).alias("cut_s"))
    r = lambda c: F.round(c, 4).alias(c)
    return Q.scenes(cuts, 200, 2).select("media_id", "scene", r("start_s"), r("end_s"), "sample", r("t_s"))


@query("W18_transcript_keypoints", f"SELECT media_id, inicio AS offset_secs, round({_T} + inicio, 3) AS t_s, 'transcription' AS key, trim(texto) AS value FROM {{segments}} JOIN {{media}} m ON m.id = media_id WHERE timestamp_utc IS NOT NULL AND trim(texto) <> ''")
def spoken(v):
    listed = v.segments.groupBy("media_id").agg(F.to_json(F.collect_list(F.struct("inicio", "fin", "texto"))).alias("segments"))
    return Q.transcript_keypoints(v.media, listed).withColumn("t_s", F.round("t_s", 3))


_SCENES = "(SELECT media_id, inicio, CASE WHEN inicio % 2 = 0 THEN string_split(texto, ' ')[1:3] ELSE [] END AS w, CASE WHEN inicio % 3 = 0 THEN '  ' ELSE texto END AS d FROM {segments})"


@query("W18b_scene_keypoints", f"""
WITH s AS (SELECT media_id, inicio, list_filter(list_transform(w, lambda x: trim(x)), lambda x: x <> '') AS w, trim(d) AS d FROM {_SCENES}), k AS (SELECT media_id, inicio, 'escena' AS key, array_to_string(w, ', ') AS value FROM s WHERE len(w) > 0
 UNION ALL SELECT media_id, inicio, 'keyword', unnest(w) FROM s UNION ALL SELECT media_id, inicio, 'descripcion_escena', d FROM s WHERE d <> '')
SELECT media_id, inicio AS offset_secs, round({_T} + inicio, 3) AS t_s, key, value FROM k JOIN {{media}} m ON m.id = media_id WHERE timestamp_utc IS NOT NULL""")
def seen(v):
    words = F.when(F.col("inicio") % 2 == 0, F.slice(F.split("texto", " "), 1, 3)).otherwise(F.array().cast("array<string>"))
    scene = F.struct("inicio", words.alias("keywords"), F.when(F.col("inicio") % 3 == 0, "  ").otherwise(F.col("texto")).alias("descripcion"))
    listed = v.segments.groupBy("media_id").agg(F.to_json(F.struct(F.collect_list(scene).alias("escenas"))).alias("analysis"))
    return Q.scene_keypoints(v.media, listed).withColumn("t_s", F.round("t_s", 3))
