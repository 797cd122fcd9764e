"""Queries over the scalar functions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, geo, sun, text, weather
from ..functions.palette import palette_rows
from ..functions.sql import register
from ..operators.language import glossary_translation, merge_glossary, translate_labels
from ..operators.published import embedding_text
from .book import Book

book = Book()
query = book.query


@query("H1_haversine", """
SELECT id, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(latitude + 34.6) / 2), 2) + cos(radians(-34.6)) * cos(radians(latitude)) * pow(sin(radians(longitude + 58.4) / 2), 2)))), 3) AS metres
FROM {media} WHERE latitude IS NOT NULL""")
def haversine(v):
    m = v.media.where("latitude IS NOT NULL")
    return m.select("id", F.round(geo.haversine_m(F.lit(-34.6), F.lit(-58.4), F.col("latitude"), F.col("longitude")), 3).alias("metres"))


#: Steps from rows ``a`` (lat, lon, s) to ``k``, which adds elevation, azimuth and distance.
SUN_STEPS = """
b AS (SELECT *, s / 86400.0 + 2440587.5 AS jd FROM a), c AS (SELECT *, (jd - 2451545.0) / 36525.0 AS t FROM b),
d AS (SELECT *, (280.46646 + t * (36000.76983 + 0.0003032 * t)) AS l0, (357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m FROM c),
e AS (SELECT * EXCLUDE (l0, m), l0 - 360 * floor(l0 / 360) AS l0, m - 360 * floor(m / 360) AS m FROM d),
f AS (SELECT *, (1.914602 - 0.004817 * t - 0.000014 * t * t) * sin(radians(m)) + (0.019993 - 0.000101 * t) * sin(radians(2 * m)) + 0.000289 * sin(radians(3 * m)) AS c, 23.439291 - 0.0130042 * t AS tilt FROM e),
g AS (SELECT *, l0 + c AS sl, m + c AS an FROM f),
h AS (SELECT *, degrees(atan2(cos(radians(tilt)) * sin(radians(sl)), cos(radians(sl)))) AS ra, asin(sin(radians(tilt)) * sin(radians(sl))) AS dec,
             280.46061837 + 360.98564736629 * (jd - 2451545.0) AS st, 1 / (1.000001018 * (1 - 0.016708634 * cos(radians(an)))) AS au FROM g),
i AS (SELECT *, (st - 360 * floor(st / 360)) + lon - ra AS x FROM h), j AS (SELECT *, radians(x - 360 * floor(x / 360)) AS ha FROM i),
k AS (SELECT *, degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha))) AS el,
             degrees(atan2(-cos(dec) * sin(ha), sin(dec) * cos(radians(lat)) - cos(dec) * sin(radians(lat)) * cos(ha))) + 360 AS az FROM j)
"""
_SUN = """
WITH a AS (SELECT id, latitude AS lat, longitude AS lon, epoch_us(timestamp_utc) / 1e6 AS s FROM {media} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL),
""" + SUN_STEPS
TWILIGHT = """CASE WHEN el >= 12 THEN 'dia' WHEN el >= 6 THEN 'golden_hour' WHEN el >= 0 THEN 'blue_hour' WHEN el >= -6 THEN 'crepuculo_civil'
WHEN el >= -12 THEN 'crepuculo_nautico' WHEN el >= -18 THEN 'crepuculo_astronomico' WHEN el IS NOT NULL THEN 'noche' END"""


def _located(v):
    m = v.media.where("latitude IS NOT NULL AND timestamp_utc IS NOT NULL")
    return m.withColumn("s", sun.epoch_seconds(F.col("timestamp_utc")))


@query("H2_sun_position", _SUN + "SELECT id, round(el, 4) AS elevation, round(az - 360 * floor(az / 360), 3) AS azimuth, round(au, 6) AS distance_au FROM k")
def sun_position(v):
    p = _located(v).select("id", sun.sun_position(F.col("latitude"), F.col("longitude"), F.col("s")).alias("p"))
    return p.select("id", F.round("p.elevation", 4).alias("elevation"), F.round("p.azimuth", 3).alias("azimuth"), F.round("p.distance_au", 6).alias("distance_au"))


@query("H3_twilight_class", _SUN + f"SELECT id, {TWILIGHT} AS period FROM k")
def twilight(v):
    return _located(v).select("id", sun.twilight_class(sun.sun_position(F.col("latitude"), F.col("longitude"), F.col("s"))["elevation"]).alias("period"))


_EVENTS = """
WITH a AS (SELECT id, latitude AS lat, longitude AS lon, epoch_us(timestamp_utc) / 1e6 AS s, floor(epoch_us(timestamp_utc) / 86400e6) * 86400 AS day FROM {media} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL),
b AS (SELECT *, day / 86400.0 + 2440587.5 AS jd FROM a),
b2 AS (SELECT *, 280.46061837 + 360.98564736629 * (jd - 2451545.0) AS st0, (jd - 2451545.0) / 36525.0 AS t FROM b),
c AS (SELECT *, st0 - 360 * floor(st0 / 360) AS st, radians(280.46646 + t * (36000.76983 + 0.0003032 * t)) AS l0, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, radians(23.439291 - 0.0130042 * t) AS tilt FROM b2),
d AS (SELECT *, l0 + radians((1.914602 - 0.004817 * t - 0.000014 * t * t) * sin(m) + (0.019993 - 0.000101 * t) * sin(2 * m) + 0.000289 * sin(3 * m)) AS sl FROM c),
e AS (SELECT *, degrees(atan2(cos(tilt) * sin(sl), cos(sl))) AS ra, asin(sin(tilt) * sin(sl)) AS dec FROM d),
f AS (SELECT *, (ra - lon - st) / 15.041068639 AS r0 FROM e), g AS (SELECT *, r0 - 24 * floor(r0 / 24) AS rough FROM f),
h AS (SELECT *, (jd + floor(rough * 60) / 60 / 24 - 2451545.0) / 36525.0 AS t2 FROM g),
i AS (SELECT *, radians(280.46646 + t2 * (36000.76983 + 0.0003032 * t2)) AS l2, radians(357.52911 + t2 * (35999.05029 - 0.0001537 * t2)) AS m2, radians(23.439291 - 0.0130042 * t2) AS tilt2 FROM h),
j AS (SELECT *, l2 + radians((1.914602 - 0.004817 * t2 - 0.000014 * t2 * t2) * sin(m2) + (0.019993 - 0.000101 * t2) * sin(2 * m2) + 0.000289 * sin(3 * m2)) AS sl2 FROM i),
k AS (SELECT *, (degrees(atan2(cos(tilt2) * sin(sl2), cos(sl2))) - lon - st) / 15.041068639 AS n0, (sin(radians(-0.833)) - sin(radians(lat)) * sin(dec)) / (cos(radians(lat)) * cos(dec)) AS ch FROM j),
l AS (SELECT *, n0 - 24 * floor(n0 / 24) AS noon, CASE WHEN ch BETWEEN -1 AND 1 THEN degrees(acos(ch)) / 15 END AS half FROM k),
z AS (SELECT id, s, day, ch, noon, noon - half AS up, noon + half AS down FROM l),
ev AS (SELECT id, s, ch, day + floor(noon * 3600) AS noon, day + floor((up - 24 * floor(up / 24)) * 3600) AS sunrise, day + floor((down - 24 * floor(down / 24)) * 3600) AS sunset FROM z)
"""


def _events(v):
    return _located(v).withColumn("e", sun.solar_events(F.col("latitude"), F.col("longitude"), F.col("s")))


@query("H4_solar_events", _EVENTS + """SELECT id, CAST(round(noon / 60) AS BIGINT) AS noon_minute, CAST(round(sunrise / 60) AS BIGINT) AS sunrise_minute, CAST(round(sunset / 60) AS BIGINT) AS sunset_minute,
ch > 1 AS polar_night, ch < -1 AS polar_day FROM ev""")
def solar_events(v):
    minute = lambda c: F.round(F.col(c) / 60).cast("long")
    return _events(v).select("id", minute("e.noon").alias("noon_minute"), minute("e.sunrise").alias("sunrise_minute"), minute("e.sunset").alias("sunset_minute"), "e.polar_night", "e.polar_day")


@query("H5_solar_text", _EVENTS + """, p AS (SELECT id, floor(s) - sunrise AS u, sunset - floor(s) AS f FROM ev),
q AS (SELECT id, u, f, CASE WHEN abs(u) >= 3600 THEN CAST(floor(abs(u) / 3600) AS INT) || 'h ' || CAST(floor(abs(u) % 3600 / 60) AS INT) || 'm' WHEN abs(u) >= 60 THEN CAST(floor(abs(u) / 60) AS INT) || 'm' ELSE CAST(abs(u) AS INT) || 's' END AS ut,
 CASE WHEN abs(f) >= 3600 THEN CAST(floor(abs(f) / 3600) AS INT) || 'h ' || CAST(floor(abs(f) % 3600 / 60) AS INT) || 'm' WHEN abs(f) >= 60 THEN CAST(floor(abs(f) / 60) AS INT) || 'm' ELSE CAST(abs(f) AS INT) || 's' END AS ft FROM p)
SELECT id, coalesce(nullif(concat_ws(' | ', CASE WHEN u > 0 THEN 'sol salió hace ' || ut WHEN u < 0 THEN 'sol sale en ' || ut WHEN u = 0 THEN 'sol saliendo ahora' END,
 CASE WHEN f > 300 THEN 'se pone en ' || ft WHEN f > 0 THEN 'atardeciendo ahora' WHEN f > -300 THEN 'atardecer recién' WHEN f IS NOT NULL THEN 'se puso hace ' || ft END), ''), 'sin datos solares') AS text FROM q""")
def solar_text(v):
    return _events(v).select("id", sun.solar_text(F.floor("s"), F.col("e.sunrise"), F.col("e.sunset")).alias("text"))


_RGB = "SELECT id, CAST('0x' || substr({0}, 2, 2) AS INT) AS r, CAST('0x' || substr({0}, 4, 2) AS INT) AS g, CAST('0x' || substr({0}, 6, 2) AS INT) AS b FROM media WHERE {0} IS NOT NULL"


@query("H6_colour_distance", f"""
WITH x AS ({_RGB.format('color_1_hex')}), y AS ({_RGB.format('color_2_hex')}), z AS (SELECT x.id, x.r, x.g, x.b, y.r AS r2, y.g AS g2, y.b AS b2, (x.r + y.r) / 2.0 AS m FROM x JOIN y USING (id))
SELECT id, round(sqrt((2 + m / 256) * (r - r2) * (r - r2) + 4 * (g - g2) * (g - g2) + (2 + (255 - m) / 256) * (b - b2) * (b - b2)), 6) AS redmean,
 round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END, 6) AS saturation, printf('#%02x%02x%02x', r, g, b) AS hex FROM z""".replace("FROM media", "FROM {media}"))
def colour_distance(v):
    m = v.media.where("color_1_hex IS NOT NULL")
    a, b = ([colour.channel(F.col(c), k) for k in range(3)] for c in ("color_1_hex", "color_2_hex"))
    return m.select("id", F.round(colour.redmean(*a, *b), 6).alias("redmean"), F.round(colour.hsv_saturation(*a), 6).alias("saturation"), colour.to_hex(*a).alias("hex"))


PALETTE = palette_rows()
_PALETTE_SQL = "(VALUES " + ", ".join(f"('{c}', '{b}', CAST('0x{h[1:3]}' AS INT), CAST('0x{h[3:5]}' AS INT), CAST('0x{h[5:7]}' AS INT))" for c, b, h in PALETTE) + ") p(css, basic, pr, pg, pb)"
_NAMES_SQL = f"""
WITH x AS ({_RGB.format('color_1_hex')}), d AS (SELECT id, r, g, b, css, basic, sqrt((2 + (r + pr) / 2.0 / 256) * (r - pr) * (r - pr) + 4 * (g - pg) * (g - pg) + (2 + (255 - (r + pr) / 2.0) / 256) * (b - pb) * (b - pb)) AS d FROM x, {_PALETTE_SQL}),
n AS (SELECT id, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, min((d, css, basic)) AS a, min((d, css, basic)) FILTER (WHERE basic = 'gris') AS gr,
 min((d, css, basic)) FILTER (WHERE basic NOT IN ('gris', 'negro', 'blanco')) AS re FROM d GROUP BY id),
s AS (SELECT *, (CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END) < 0.15 AS ne FROM n)
SELECT id, CASE WHEN ne AND greatest(r, g, b) < 45 THEN 'negro' WHEN ne AND least(r, g, b) > 200 THEN 'blanco' WHEN ne THEN gr[2] WHEN a[3] IN ('gris', 'negro', 'blanco') AND re[1] < a[1] * 1.5 THEN re[2] ELSE a[2] END AS css,
 CASE WHEN ne AND greatest(r, g, b) < 45 THEN 'negro' WHEN ne AND least(r, g, b) > 200 THEN 'blanco' WHEN ne THEN 'gris' WHEN a[3] IN ('gris', 'negro', 'blanco') AND re[1] < a[1] * 1.5 THEN re[3] ELSE a[3] END AS basic FROM s""".replace("FROM media", "FROM {media}")


@query("H7_colour_names", _NAMES_SQL)
def names(v):
    palette = v.spark.createDataFrame(PALETTE, "css string, basic string, hex string")
    return colour.colour_names(v.media.where("color_1_hex IS NOT NULL").select("id", F.col("color_1_hex").alias("hex")), palette).select("id", "css", "basic")


@query("H8_gradient_class", """
SELECT id, CASE WHEN g IS NULL THEN NULL WHEN g < -3 THEN 'steep_fall' WHEN g < -1 THEN 'gentle_fall' WHEN g < 1 THEN 'level' WHEN g < 3 THEN 'gentle_climb' ELSE 'steep_climb' END AS class
FROM (SELECT id, altitude / 50 - 5 AS g FROM {media})""")
def gradient(v):
    return v.media.select("id", geo.gradient_class(F.col("altitude") / 50 - 5).alias("class"))


@query("H9_weather_names", "SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, hour, lat_bin, lon_bin, CASE code WHEN 0 THEN 'despejado' WHEN 1 THEN 'mayormente despejado' WHEN 2 THEN 'parcialmente nublado' WHEN 3 THEN 'nublado' END AS label, "
       "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO'][CAST(round_even(wind_degrees / 22.5, 0) AS INT) % 16 + 1] AS wind FROM {hourly_weather}")
def weather_names(v):
    w = v.hourly_weather
    return w.select(F.col("day").cast("string").alias("day"), "hour", "lat_bin", "lon_bin", weather.wmo_label(F.col("code")).alias("label"), weather.wind_compass(F.col("wind_degrees")).alias("wind"))


@query("H10_local_hour", "SELECT id, round(hour(t) + minute(t) / 60.0 + second(t) / 3600.0, 6) AS local_hour FROM (SELECT id, timestamp_utc - INTERVAL 3 HOUR AS t FROM {media})")
def local_hour(v):
    return v.media.select("id", F.round(weather.local_hour(F.col("timestamp_utc")), 6).alias("local_hour"))


_PARTS = "CASE WHEN value LIKE '[%' THEN from_json(value, '[\"VARCHAR\"]') ELSE list_filter(list_transform(string_split(value, ','), lambda x: trim(x)), lambda x: x <> '') END"


@query("H11_split_keywords", f"SELECT media_id, key, CAST(len(p) AS INT) AS n, array_to_string(list_transform(p, lambda x: trim(trim(x), '''\"')), '|') AS parts FROM (SELECT media_id, key, {_PARTS} AS p FROM {{metadata}} WHERE key LIKE 'ia_keywords%')")
def split_keywords(v):
    m = v.metadata.where(F.col("key").startswith("ia_keywords"))
    parts = text.split_keywords(F.col("value"))
    return m.select("media_id", "key", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))


_SYNONYMS = {"brushed": "metal", "steel": "metal", "gold": "oro", "red": "rojo"}


@query("H12_refine_keywords", f"""
WITH w AS (SELECT media_id, unnest({_PARTS}) AS word, generate_subscripts({_PARTS}, 1) AS i FROM {{metadata}} WHERE key = 'ia_keywords'),
c AS (SELECT media_id, i, lower(trim(trim(word), '''".,;:!?()[]')) AS w FROM w),
g AS (SELECT media_id, i, CASE WHEN length(w) >= 4 AND regexp_matches(w, '[aiou]s$') THEN w[:-2] ELSE w END AS w FROM c WHERE length(w) >= 3 AND w NOT IN ('the', 'of') AND NOT regexp_matches(w, '^\\d+x\\d+$')),
s AS (SELECT media_id, i, CASE w WHEN 'brushed' THEN 'metal' WHEN 'steel' THEN 'metal' WHEN 'gold' THEN 'oro' WHEN 'red' THEN 'rojo' ELSE w END AS w FROM g),
f AS (SELECT media_id, w, min(i) AS i FROM s WHERE length(w) >= 3 AND w NOT IN ('the', 'of') GROUP BY media_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY i) AS n FROM f),
k AS (SELECT media_id, string_agg(w, '|' ORDER BY i) AS keywords FROM r WHERE n <= 7 GROUP BY media_id)
SELECT DISTINCT m.media_id, coalesce(keywords, '') AS keywords FROM {{metadata}} m LEFT JOIN k USING (media_id) WHERE key = 'ia_keywords'""")
def refine(v):
    synonyms = F.create_map(*[F.lit(x) for kv in _SYNONYMS.items() for x in kv])
    words = text.refine_keywords(text.split_keywords(F.col("value")), synonyms, ["the", "of"], r"^\d+x\d+$")
    return v.metadata.where("key = 'ia_keywords'").select("media_id", F.array_join(words, "|").alias("keywords"))


@query("H13_parse_model_keywords", """
SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS keywords FROM (
 SELECT p_partkey, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i) WHERE length(w) >= 2 GROUP BY w ORDER BY i LIMIT 5)) AS list_distinct_ordered
 FROM {part})""")
def model_keywords(v):
    """Model answers in four shapes, made from part names, all give the same keywords."""
    words = F.split("p_name", " ")
    listed = F.concat(F.lit('["'), F.array_join(words, '", "'), F.lit('"]'))
    answer = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Aquí están:\n```json\n"), listed, F.lit("\n```")))
        .when(F.col("p_partkey") % 4 == 1, F.regexp_replace(listed, r"\]$", ","))
        .when(F.col("p_partkey") % 4 == 2, F.array_join(words, ", "))
        .otherwise(F.array_join(F.transform(words, lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), "\n"))
    )
    return v.part.select("p_partkey", F.array_join(text.parse_model_keywords(answer), "|").alias("keywords"))


_INTROS = ["descripción:", "para describir la imagen,", "observamos"]


@query("H14_strip_meta_intro", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR length(body) < 15 OR body = '' THEN opened ELSE body END AS text FROM (
 SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Descripción: ' || b WHEN 1 THEN 'Para describir la imagen, observamos: ' || b ELSE b END AS opened, b AS body
 FROM (SELECT doc_id, 'x' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || 'x' AS b FROM {documents}))""")
def strip_intro(v):
    body = F.concat(F.lit("x"), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit("x"))
    opened = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Descripción: "), body)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Para describir la imagen, observamos: "), body)).otherwise(body)
    return v.documents.select("doc_id", text.strip_meta_intro(opened, _INTROS).alias("text"))


@query("H15_cut_at_word", """
SELECT doc_id, CASE WHEN length(t) <= 60 THEN trim(t) WHEN strpos(reverse(t[:60]), ' ') > 0 AND 60 - strpos(reverse(t[:60]), ' ') >= 30 THEN rtrim(t[:60 - strpos(reverse(t[:60]), ' ')]) ELSE rtrim(t[:60]) END AS text
FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM {documents})""")
def cut(v):
    return v.documents.select("doc_id", text.cut_at_word(F.regexp_replace("text", r"\s+", " "), 60).alias("text"))


def _json():
    return F.to_json(F.collect_list(F.struct("inicio", "fin", "texto")))


@query("H16_segments_to_text", "SELECT media_id, string_agg(trim(texto), ' ' ORDER BY inicio) AS text FROM {segments} WHERE trim(texto) <> '' GROUP BY media_id")
def segment_text(v):
    return v.segments.groupBy("media_id").agg(_json().alias("j")).select("media_id", text.segments_to_text(F.col("j")).alias("text")).where("text <> ''")


@query("H17_embedding_text", """
WITH s AS (SELECT media_id, string_agg(trim(texto), ' ' ORDER BY inicio) AS t FROM {segments} GROUP BY media_id),
k AS (SELECT media_id, key, (SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT trim(trim(x), '''"') AS w, i FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS i)) WHERE w <> '' GROUP BY w)) AS t
 FROM (SELECT media_id, key, CASE WHEN value LIKE '[%' THEN from_json(value, '["VARCHAR"]') ELSE string_split(value, ',') END AS p FROM {metadata} WHERE key LIKE 'ia_keywords%')),
a AS (SELECT id AS media_id, concat_ws(' ', s.t, k1.t, k2.t) AS t FROM {media} LEFT JOIN s ON s.media_id = id LEFT JOIN k k1 ON k1.media_id = id AND k1.key = 'ia_keywords' LEFT JOIN k k2 ON k2.media_id = id AND k2.key = 'ia_keywords_sonido')
SELECT media_id, md5(CASE WHEN length(t) <= 6000 THEN trim(t) WHEN strpos(reverse(t[:6000]), ' ') > 0 AND 6000 - strpos(reverse(t[:6000]), ' ') >= 3000 THEN rtrim(t[:6000 - strpos(reverse(t[:6000]), ' ')]) ELSE rtrim(t[:6000]) END) AS text_md5 FROM a WHERE t <> ''""")
def embedded(v):
    return embedding_text(v.media, v.metadata, v.segments).select("media_id", F.md5("text").alias("text_md5"))


@query("H18_reliable_segments", "SELECT media_id, CAST(count(*) FILTER (WHERE trim(texto) <> '' AND fin - inicio >= 1.5) AS INT) AS n FROM {segments} GROUP BY media_id")
def reliable(v):
    listed = v.segments.groupBy("media_id").agg(_json().alias("j"))
    return listed.select("media_id", F.size(text.reliable_segments(F.from_json("j", text.SEGMENTS))).alias("n"))


_GLOSSARY = "(SELECT DISTINCT w AS word, 'es_' || w AS translation FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM {part}) WHERE length(w) % 2 = 0)"


def _glossary(v):
    words = v.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().where("length(word) % 2 = 0")
    return words.withColumn("translation", F.concat(F.lit("es_"), "word"))


@query("H19_translate_keywords", f"""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM {{part}}), g AS {_GLOSSARY}
SELECT p_partkey, string_agg(coalesce(translation, w), '|' ORDER BY i) AS translated, coalesce(string_agg(CASE WHEN translation IS NULL THEN w END, '|' ORDER BY i), '') AS unknown FROM w LEFT JOIN g ON word = w GROUP BY p_partkey""")
def translate(v):
    lists = v.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    out = glossary_translation(lists, _glossary(v))
    return out.select(F.col("id").alias("p_partkey"), F.array_join("translated", "|").alias("translated"), F.array_join("unknown", "|").alias("unknown"))


@query("H20_merge_glossary", f"""
WITH g AS {_GLOSSARY}, x AS (SELECT word, translation, CASE length(word) % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'db_seed' ELSE 'auto' END AS origin FROM g),
n AS (SELECT word, 'new_' || word AS translation, 'db_seed' AS origin FROM g WHERE length(word) > 4)
SELECT word, CASE WHEN n.word IS NOT NULL AND coalesce(x.origin, '') <> 'manual' THEN n.translation ELSE x.translation END AS translation, CASE WHEN n.word IS NOT NULL AND coalesce(x.origin, '') <> 'manual' THEN n.origin ELSE x.origin END AS origin FROM x FULL JOIN n USING (word)""")
def merged(v):
    g = _glossary(v)
    n = F.length("word")
    old = g.withColumn("origin", F.when(n % 3 == 0, "manual").when(n % 3 == 1, "db_seed").otherwise("auto"))
    new = g.where(n > 4).select("word", F.concat(F.lit("new_"), "word").alias("translation"), F.lit("db_seed").alias("origin"))
    return merge_glossary(old, new)


@query("H21_translate_sound_label", f"""
WITH l AS (SELECT DISTINCT p_type AS label FROM {{part}}), t AS (SELECT label, lower(label) AS low FROM l), w AS (SELECT label, unnest(string_split(low, ' ')) AS w, generate_subscripts(string_split(low, ' '), 1) AS i FROM t), g AS {_GLOSSARY}
SELECT label, string_agg(coalesce(translation, w), ' ' ORDER BY i) AS translated FROM w LEFT JOIN g ON word = w GROUP BY label""")
def sound_label(v):
    return translate_labels(v.part.select(F.col("p_type").alias("label")).distinct(), _glossary(v)).select("label", "translated")


@query("H22_fold_and_slug", "SELECT DISTINCT n_name, lower(trim(n_name)) AS folded, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM {nation}")
def folded(v):
    return v.nation.select("n_name", text.fold(F.col("n_name")).alias("folded"), text.slug(F.col("n_name")).alias("slug")).distinct()


_WORDS = f"[A-Za-z{text.ACCENTED}]+"


@query("H22b_natural_order", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS word FROM {{documents}}) SELECT word, CAST(rank() OVER (PARTITION BY lower(strip_accents(word))[1] ORDER BY lower(strip_accents(word))) AS INT) AS place FROM w""")
def dictionary(v):
    """All words of all texts, ranked under their first letter; words that differ in case and accents share a rank."""
    from pyspark.sql import Window as W

    words = v.documents.select(F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("word")).distinct()
    first = F.substring(text.fold(F.col("word")), 1, 1)
    return words.withColumn("place", F.rank().over(W.partitionBy(first).orderBy(text.natural_order(F.col("word")))))


@query("H0_functions_in_sql", """
SELECT id, CASE WHEN latitude IS NOT NULL THEN round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(-34.6 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(-34.6)) * pow(sin(radians(-58.4 - longitude) / 2), 2)))), 3) END AS metres, CASE WHEN starts_with(color_1_hex, '#') THEN ('0x' || substr(color_1_hex, 2, 2))::INT END AS red,
 hour(timestamp_utc - INTERVAL 3 HOUR) + minute(timestamp_utc) / 60 + floor(second(timestamp_utc)) / 3600 AS hour, ['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo'][isodow(timestamp_utc - INTERVAL 3 HOUR)] AS day, trim(regexp_replace(lower(municipio), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(bit_count(xor(id, 12345)) AS INT) AS bits FROM {media}""")
def in_sql(v):
    """The functions that ``register`` enters, called in SQL."""
    register(v.spark, "wayline_")
    return v.spark.sql(
        """SELECT id, round(wayline_haversine_m(latitude, longitude, -34.6D, -58.4D), 3) AS metres, wayline_colour_red(color_1_hex) AS red, wayline_local_hour(timestamp_utc) AS hour,
 wayline_weekday_local(timestamp_utc) AS day, wayline_slug(municipio) AS slug, wayline_hamming_bits(id, 12345L) AS bits FROM {media}""",
        media=v.media,
    )


@query("H23_vector_similarity", """
WITH f AS (SELECT label, min(vec_id) AS lead FROM {embeddings} GROUP BY label)
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], l.embedding::DOUBLE[]), 6) AS cosine, CAST(bit_count(xor(e.vec_id, l.vec_id)) AS INT) AS hamming FROM {embeddings} e JOIN f ON f.label = e.label JOIN {embeddings} l ON l.vec_id = f.lead""")
def similarity(v):
    e = v.embeddings
    lead = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"), F.min("vec_id").alias("lead"))
    return e.join(lead, "label").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"), text.hamming(F.col("vec_id"), F.col("lead")).cast("int").alias("hamming"))


@query("H24_descriptions", """
SELECT id, CASE WHEN altitude * 10 + 0.0013 >= 1000 THEN printf('%.2f km', (altitude * 10 + 0.0013) / 1000) WHEN altitude IS NULL THEN '—' ELSE printf('%.0f m', altitude * 10 + 0.0013) END AS distance,
 CASE WHEN altitude IS NULL THEN '—' WHEN abs(altitude / 50 - 5.0001) < 0.01 THEN '0 %' ELSE printf('%+.2f %%', altitude / 50 - 5.0001) END AS slope,
 CASE WHEN municipio IS NOT NULL THEN 'municipio: ' || municipio || ' (' || provincia || ')' END AS place FROM {media}""")
def descriptions(v):
    a = F.col("altitude")
    return v.media.select("id", geo.format_distance(a * 10 + 0.0013).alias("distance"), geo.format_slope(a / 50 - 5.0001).alias("slope"), geo.describe_place(F.col("municipio"), F.col("provincia")).alias("place"))
