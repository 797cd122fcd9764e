"""Queries that count (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as A
from ..operators.route import route_summary
from .book import Book
from .join_queries import _WINDOWS, window_scores

book = Book()
query = book.query

_W = "round(freq / CAST(max(freq) OVER () AS DOUBLE), {}) AS weight"


@query("A1_facet_hours", f"SELECT value, freq, {_W.format(3)} FROM (SELECT printf('%02d:00', h) AS value, count(id) AS freq FROM (SELECT unnest(range(24)) AS h) LEFT JOIN {{media}} ON hour(timestamp_utc) = h GROUP BY h)")
def hours(v):
    return A.facet_counts(v.media, v.metadata, "hours")


@query("A1_facet_municipalities", f"SELECT value, freq, {_W.format(3)} FROM (SELECT municipio AS value, count(*) AS freq FROM {{media}} WHERE municipio IS NOT NULL GROUP BY municipio)")
def municipalities(v):
    return A.facet_counts(v.media, v.metadata, "municipalities")


@query("A1_facet_weather", f"SELECT value, freq, {_W.format(3)} FROM (SELECT value, count(*) AS freq FROM {{metadata}} WHERE key = 'weather_label' GROUP BY value)")
def weather(v):
    return A.facet_counts(v.media, v.metadata, "weather")


@query("A1_facet_weekdays", f"SELECT value, freq, {_W.format(3)} FROM (SELECT ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow(timestamp_utc - INTERVAL 3 HOUR)] AS value, count(*) AS freq FROM {{media}} WHERE timestamp_utc IS NOT NULL GROUP BY 1)")
def weekdays(v):
    from ..operators.cleaning import weekday_rows

    return A.facet_counts(v.media, weekday_rows(v.media), "weekdays")


_TAGS = "(SELECT lower(trim(trim(x), '\"''')) AS value FROM (SELECT unnest(CASE WHEN value LIKE '[%' THEN from_json(value, '[\"VARCHAR\"]') ELSE string_split(value, ',') END) AS x FROM {metadata} WHERE key LIKE 'ia_keywords%'))"


@query("A2_tag_facet", f"""WITH c AS (SELECT value, count(*) AS freq FROM {_TAGS} WHERE length(value) > 2 AND NOT contains(value, 'gea') AND value <> 'hot' GROUP BY value),
s AS (SELECT *, row_number() OVER (ORDER BY freq DESC, value) AS r, count(*) OVER () AS n FROM c), t AS (SELECT value, freq FROM s WHERE r <= greatest(1, (n + 3) // 4)) SELECT value, freq, {_W.format(3)} FROM t""")
def tags(v):
    return A.tag_facet(v.metadata, ignore=["gea"], sensitive=["hot"])


@query("A3_tag_cloud", f"""WITH k AS (SELECT trim(regexp_replace(lower(trim(unnest(string_split(p_name || ',' || p_type || ',' || p_brand, ',')))), '[^a-záéíóúüñ\\s-]', '', 'g')) AS value FROM {{part}}),
c AS (SELECT value, count(*) AS freq FROM k WHERE strlen(value) >= 3 AND value NOT IN ('small') GROUP BY value HAVING count(*) > 1 OR NOT contains(value, ' ') ORDER BY freq DESC, value LIMIT 20) SELECT value, freq, {_W.format(2)} FROM c""")
def cloud(v):
    return A.tag_cloud(v.part.select(F.concat_ws(",", "p_name", "p_type", "p_brand").alias("keywords")), 20, ["small"])


@query("A4_colour_slot_counts", "SELECT c AS colour, count(*) AS total, '#607d8b' AS hex FROM (SELECT color_1_hex AS c FROM {media} UNION ALL SELECT color_2_hex FROM {media} UNION ALL SELECT color_3_hex FROM {media}) WHERE c IS NOT NULL GROUP BY c")
def slots(v):
    return A.colour_slot_counts(v.media)


@query("A5_catalog_totals", "SELECT 'media' AS what, count(*) AS n FROM {media} UNION ALL SELECT 'metadata', count(*) FROM {metadata} UNION ALL SELECT 'type:' || type, count(*) FROM {media} GROUP BY type")
def totals(v):
    return A.catalog_totals({"media": v.media, "metadata": v.metadata})


@query("A6_batches", "SELECT ingest_batch_id, strftime(min(timestamp_utc), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM {media} WHERE ingest_batch_id IS NOT NULL GROUP BY 1")
def batch_list(v):
    return A.batches(v.media).withColumn("first", F.date_format("first", "yyyy-MM-dd HH:mm:ss"))


@query("A7_daily_distribution", "SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, count(*) AS n FROM {media} GROUP BY 1")
def daily(v):
    return A.daily_distribution(v.media).withColumn("day", F.col("day").cast("string"))


_HAV = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(latitude - la) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * pow(sin(radians(longitude - lo) / 2), 2))))"
ROUTE = f"""r AS (SELECT id, timestamp_utc, latitude, longitude, altitude, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo, lag(altitude) OVER w AS al, lag(id) OVER w AS pid FROM {{media}} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL WINDOW w AS (ORDER BY timestamp_utc, id)),
g AS (SELECT *, CASE WHEN pid IS NOT NULL THEN {_HAV} END AS d, altitude - al AS e FROM r)"""


@query("A8_route_summary", f"WITH {ROUTE} SELECT count(*) AS points, count(pid) AS pairs, round(sum(d), 0) AS distance_m, round(sum(CASE WHEN e > 0 THEN e ELSE 0 END), 1) AS gain_m, round(sum(CASE WHEN e < 0 THEN e ELSE 0 END), 1) AS loss_m, round(sum(e), 1) AS net_m, count(pid) FILTER (WHERE e IS NULL) AS pairs_without_altitude, count(*) FILTER (WHERE d = 0) AS coincident FROM g")
def summary(v):
    return route_summary(v.media)


@query("A9_sound_tags", f"""WITH n AS (SELECT media_id, count(DISTINCT win) AS n FROM {_WINDOWS} GROUP BY 1), s AS (SELECT media_id, label, sum(prob) / any_value(n) AS p FROM {_WINDOWS} JOIN n USING (media_id) WHERE label <> 'economy' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY p DESC, label) AS rank FROM s WHERE p >= 0.15) SELECT media_id, label, round(p, 6) AS probability, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def sounds(v):
    return A.sound_tags(window_scores(v), excluded=["economy"]).withColumn("probability", F.round("probability", 6))


_CELLS = "(SELECT id AS media_id, CAST(c AS INT) AS cell, '#' || substr(md5(CAST(id * 16 + c // 2 AS VARCHAR)), 1, 1) || '0' || substr(md5(CAST(id * 16 + c // 2 AS VARCHAR)), 2, 1) || '0' || substr(md5(CAST(id * 16 + c // 2 AS VARCHAR)), 3, 1) || '0' AS hex, CAST((id * 7 + c * 13) % 50 + 1 AS DOUBLE) AS freq FROM {media}, (SELECT unnest(range(16)) AS c) WHERE type = 'image')"


@query("A10_dominant_colours", f"""
WITH x AS (SELECT media_id, hex, cell, freq, ((cell % 4) - 1.5) / 1.5 AS dx, ((cell // 4) - 1.5) / 1.5 AS dy FROM {_CELLS}), a AS (SELECT media_id, hex, sum(freq * greatest(0.3, 1 - sqrt(dx * dx + dy * dy) * 0.7)) AS f, count(DISTINCT cell) AS c FROM x GROUP BY 1, 2),
b AS (SELECT *, CAST('0x' || substr(hex, 2, 2) AS INT) AS r, CAST('0x' || substr(hex, 4, 2) AS INT) AS g, CAST('0x' || substr(hex, 6, 2) AS INT) AS bl FROM a), s AS (SELECT *, CASE WHEN greatest(r, g, bl) = 0 THEN 0 ELSE (greatest(r, g, bl) - least(r, g, bl)) / CAST(greatest(r, g, bl) AS DOUBLE) END AS s FROM b),
y AS (SELECT *, greatest(r, g, bl) < 30 OR s < 0.08 AS grey, f * pow(16.0 / c, 2) * (0.05 + 0.95 * s / greatest(max(s) OVER (PARTITION BY media_id), 0.1)) AS score FROM s),
z AS (SELECT *, grey AND coalesce(max(CASE WHEN grey THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY score DESC, hex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM y), q AS (SELECT media_id, hex, row_number() OVER (PARTITION BY media_id ORDER BY late, score DESC, hex) AS rank FROM z)
SELECT m.media_id, CAST(k AS INT) AS rank, coalesce(hex, '#808080') AS hex FROM (SELECT DISTINCT media_id, unnest([1, 2, 3]) AS k FROM x) m LEFT JOIN q ON q.media_id = m.media_id AND q.rank = k""")
def dominant(v):
    c = v.spark.range(16).withColumnRenamed("id", "c")
    h = F.md5((F.col("id") * 16 + F.floor(F.col("c") / 2)).cast("string"))
    hex_ = F.concat(F.lit("#"), F.substring(h, 1, 1), F.lit("0"), F.substring(h, 2, 1), F.lit("0"), F.substring(h, 3, 1), F.lit("0"))
    cells = v.media.where("type = 'image'").crossJoin(F.broadcast(c)).select(F.col("id").alias("media_id"), F.col("c").cast("int").alias("cell"), hex_.alias("hex"), ((F.col("id") * 7 + F.col("c") * 13) % 50 + 1).cast("double").alias("freq"))
    return A.dominant_colours(cells)


@query("A11_description_audit", """
WITH d AS (SELECT doc_id AS media_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS key, CASE WHEN doc_id % 3 = 0 THEN 'The ' || text ELSE text END AS value FROM {documents} UNION ALL SELECT doc_id, 'es', 'En la imagen the' FROM {documents} WHERE doc_id % 2 = 0 AND lang = 'en'),
u AS (SELECT min(key) AS key, count(*) AS unpaired FROM (SELECT media_id, min(key) AS key FROM d GROUP BY media_id HAVING count(DISTINCT key) = 1) GROUP BY key)
SELECT key, count(*) AS n, count(*) FILTER (WHERE starts_with(lower(trim(value)), 'the ')) AS with_prefix, count(*) FILTER (WHERE contains(lower(trim(value)), 'the ') AND NOT starts_with(lower(trim(value)), 'the ')) AS residue,
 count(*) FILTER (WHERE starts_with(lower(trim(value)), 'en la imagen')) AS openers, coalesce(any_value(unpaired), 0) AS unpaired FROM d LEFT JOIN u USING (key) GROUP BY key""")
def audit(v):
    d = v.documents
    key = F.when(F.col("lang") == "en", "en").otherwise("es").alias("key")
    first = d.select(F.col("doc_id").alias("media_id"), key, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("The "), "text")).otherwise(F.col("text")).alias("value"))
    second = d.where("doc_id % 2 = 0 AND lang = 'en'").select(F.col("doc_id").alias("media_id"), F.lit("es").alias("key"), F.lit("En la imagen the").alias("value"))
    return A.description_audit(first.unionByName(second), ["the "], ["en la imagen"])


@query("A12_transcript_states", "SELECT media_id, CASE WHEN bool_or(trim(texto) <> '' AND fin - inicio >= 3) THEN 'ok' ELSE 'sin_voz' END AS state FROM (SELECT media_id, texto, inicio, fin - 1.5 AS fin0, fin FROM {segments}) GROUP BY media_id")
def states(v):
    listed = v.segments.groupBy("media_id").agg(F.to_json(F.collect_list(F.struct("inicio", (F.col("fin") - 1.5).alias("fin"), "texto"))).alias("segments"))
    return A.transcript_states(listed)


@query("A13_snapshot_summary", """
SELECT 'type' AS what, type AS name, CAST(count(*) AS VARCHAR) AS value FROM {media} GROUP BY type UNION ALL SELECT 'keypoints', key, CAST(count(*) AS VARCHAR) FROM {keypoints} GROUP BY key UNION ALL SELECT 'days', 'first', strftime(min(timestamp_utc), '%Y-%m-%d') FROM {media}
UNION ALL SELECT 'days', 'last', strftime(max(timestamp_utc), '%Y-%m-%d') FROM {media} UNION ALL SELECT 'coverage', 'located', CAST(count(latitude) AS VARCHAR) FROM {media} UNION ALL SELECT 'coverage', 'timed', CAST(count(timestamp_utc) AS VARCHAR) FROM {media}
UNION ALL SELECT 'province', provincia, string_agg(DISTINCT municipio, ', ' ORDER BY municipio) FROM {media} WHERE provincia IS NOT NULL GROUP BY provincia""")
def snapshot(v):
    return A.snapshot_summary(v.media, v.keypoints)


@query("A14_max_gap", "SELECT user_id, max(event_id % 97) / 2.0 AS gap_s FROM {events} GROUP BY user_id")
def gaps(v):
    gap = (F.col("event_id") % 97) / 2
    listed = v.events.groupBy("user_id").agg(F.when(F.col("user_id") % 2 == 0, F.to_json(F.collect_list(gap))).otherwise(F.to_json(F.collect_list(F.struct(gap.alias("gap_s"))))).alias("gaps"))
    return listed.select("user_id", A.max_gap(F.col("gaps")).alias("gap_s"))
