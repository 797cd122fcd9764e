"""Queries that compose a loop (T, and the ambient events W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import loop as L
from ..operators.sequences import place_entry_exit
from .book import Book
from .sequence_queries import hourly_media

book = Book()
query = book.query

_EPOCH = "epoch_us(timestamp_utc) / 1e6"
_LOCAL = "(timestamp_utc - INTERVAL 3 HOUR)"
_HOUR = f"(hour({_LOCAL}) + minute({_LOCAL}) / 60.0 + second({_LOCAL}) / 3600.0)"


@query("T1_affinity_score", """
WITH k AS (SELECT media_id, min(value) AS v FROM {metadata} WHERE key = 'ia_keywords' GROUP BY media_id)
SELECT id, CAST(CASE WHEN type = 'image' THEN CAST(color_1_hex < '#4' AS INT) * 0 + CAST(color_1_hex IN ('#000000', '#ffffff') AS INT) + CAST(color_2_hex IN ('#000000', '#ffffff') AS INT) + CAST(color_3_hex IN ('#000000', '#ffffff') AS INT) ELSE 0 END
 + coalesce(CAST(contains(lower(v), 'red') AS INT), 0) + coalesce(CAST(contains(lower(v), 'gear') AS INT), 0) AS INT) AS score FROM {media} LEFT JOIN k ON media_id = id""")
def score(v):
    k = v.metadata.where("key = 'ia_keywords'").groupBy(F.col("media_id").alias("id")).agg(F.min("value").alias("value"))
    return L.affinity_score(v.media, k, ["#FFFFFF", "#000000"], ["Red", "gear"]).select("id", F.col("score").cast("int").alias("score"))


_SELECTED = f"""c AS (SELECT *, coalesce({_HOUR}, CASE WHEN type = 'text' THEN 12.0 END) AS hour FROM {{media}}),
k AS (SELECT media_id, min(value) AS v FROM {{metadata}} WHERE key = 'ia_keywords' GROUP BY media_id),
sel AS (SELECT c.*, coalesce(CAST(contains(lower(v), 'red') AS INT), 0) AS score FROM c LEFT JOIN k ON media_id = id WHERE hour BETWEEN 7 AND 18 AND id IN (SELECT media_id FROM {{metadata}} WHERE key LIKE 'ia_keywords%' AND contains(lower(value), 'red')))"""


@query("T2_select_for_loop", f"WITH {_SELECTED} SELECT id, round(hour, 6) AS hour, CAST(score AS INT) AS score FROM sel")
def selected(v):
    out = L.select_for_loop(v.media, v.metadata, [7, 16, 13, 18], tags=["red"])
    return out.select("id", F.round("hour", 6).alias("hour"), F.col("score").cast("int").alias("score"))


_ARCS = "(VALUES (0, 7.0, 9.0, 0.0, 100.0), (1, 16.0, 21.0, 100.0, 100.0), (2, 13.0, 5.0, 200.0, 100.0)) a(i, f, arc, st, len)"
_PLACE = "CASE WHEN hour < f AND f + arc >= 24 THEN hour + 24 ELSE hour END - f"


@query("T4_position_in_loop", f"""
WITH m AS (SELECT id, {_HOUR} AS hour FROM {{media}} WHERE timestamp_utc IS NOT NULL), p AS (SELECT id, i, st + greatest(0, least(1, ({_PLACE}) / arc)) * len AS t FROM m, {_ARCS} WHERE ({_PLACE}) / arc BETWEEN -1e-6 AND 1 + 1e-6)
SELECT id, CAST(min(i) AS INT) AS seg_i, round(min_by(t, i), 4) AS t_loop FROM p GROUP BY id""")
def placed(v):
    return L.position_in_loop(hourly_media(v).select("id", "hour"), [7, 16, 13, 18], 300).select("id", "seg_i", F.round("t_loop", 4).alias("t_loop"))


#: Every medium's place in the loop, with its kind.
LOOP_PLACES = f"""
WITH m AS (SELECT id, type, subtype, {_HOUR} AS hour FROM {{media}} WHERE timestamp_utc IS NOT NULL), p AS (SELECT id, type, subtype, i, st + greatest(0, least(1, ({_PLACE}) / arc)) * len AS t FROM m, {_ARCS} WHERE ({_PLACE}) / arc BETWEEN -1e-6 AND 1 + 1e-6)
SELECT CASE WHEN any_value(type) = 'video' AND any_value(subtype) = '360' THEN 'video360' ELSE any_value(type) END AS kind, id, CAST(min(i) AS INT) AS seg_i, round(min_by(t, i), 4) AS t_loop FROM p GROUP BY id"""


@query("T5_loop_spec", f"""
WITH {_SELECTED}, p AS (SELECT id, type, subtype, i, st + greatest(0, least(1, ({_PLACE}) / arc)) * len AS t FROM sel, {_ARCS} WHERE ({_PLACE}) / arc BETWEEN -1e-6 AND 1 + 1e-6)
SELECT CASE WHEN any_value(type) = 'video' AND any_value(subtype) = '360' THEN 'video360' ELSE any_value(type) END AS kind, id, CAST(min(i) AS INT) AS seg_i, round(min_by(t, i), 4) AS t_loop FROM p GROUP BY id""")
def spec(v):
    media = L.select_for_loop(v.media, v.metadata, [7, 16, 13, 18], tags=["red"])
    events = media.limit(0).withColumn("text", F.lit(""))
    return L.loop_spec(media, events, [7, 16, 13, 18], 300).select("kind", "id", "seg_i", F.round("t_loop", 4).alias("t_loop"))


@query("T6_timeline", "SELECT id, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS ts, type FROM {media}")
def line(v):
    return L.timeline(v.media).select("id", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("ts"), "type")


def _felt(v):
    i = F.col("id")
    return hourly_media(v).select(
        "id", "hour", (i % 91 - 10).cast("double").alias("sun_elevation"), ((i * 37) % 20000 - 10000).cast("double").alias("secs_since_noon"), F.when(i % 91 - 10 < -6, "noche").otherwise("dia").alias("twilight_period"),
        ((i * 7) % 45 - 5).cast("double").alias("temp_c"), ((i * 11) % 60).cast("double").alias("wind_kmh"), ((i * 3) % 4).cast("double").alias("precip_mm"), ((i * 13) % 100).cast("double").alias("cloud_pct"), (i % 4).cast("int").alias("code"),
    )


_CONDITIONS = [
    ("alba", "el BETWEEN 0 AND 3"), ("mediodia", "abs(ssn) <= 900"), ("calor", "te > 30"), ("frio", "te < 10"), ("viento", "wi > 40"), ("lluvia", "pr > 1"), ("nublado", "cl >= 70 OR (cl > 20 AND co = 3)"),
    ("despejado", "cl <= 20 OR (cl < 70 AND co IN (0, 1))"), ("sol", "(cl <= 20 OR (cl < 70 AND co IN (0, 1))) AND te > 28 AND el > 20"), ("noche", "el < -6"),
]
_FAMILIES = " UNION ALL ".join(f"SELECT id, hour, '{f}' AS family, ({c}) AND {'lag(' + c + ', 1, false) OVER (ORDER BY hour, id)' if f in L.SUSTAINED else 'true'} AS felt FROM m" for f, c in _CONDITIONS)


_FELT_SQL = f"SELECT id, {_HOUR} AS hour, id % 91 - 10 AS el, (id * 37) % 20000 - 10000 AS ssn, (id * 7) % 45 - 5 AS te, (id * 11) % 60 AS wi, (id * 3) % 4 AS pr, (id * 13) % 100 AS cl, id % 4 AS co FROM {{media}} WHERE timestamp_utc IS NOT NULL"


@query("W10_ambient_events", f"""
WITH m AS ({_FELT_SQL}), e AS ({_FAMILIES})
SELECT family, min_by(id, (hour, id)) AS id, CAST(floor(hour) AS INT) AS hour FROM e WHERE felt GROUP BY family, floor(hour)""")
def felt(v):
    return L.ambient_events(_felt(v)).select("family", "id", F.floor("hour").cast("int").alias("hour"))


_TEXTS = [
    ("alba", "Salió el sol"), ("mediodia", "Es el mediodía"), ("calor", "Hace calor"), ("frio", "Hace frío"), ("viento", "Hay mucho viento"), ("lluvia", "Está lloviendo"), ("nublado", "Está nublado"),
    ("despejado", "Cielo despejado"), ("sol", "Pega el sol"), ("noche", "Es la noche"),
]
_LEVELS = " UNION ALL ".join(
    f"SELECT id, o, hour, 'Entramos a ' || now AS text, {2 * k + 1} AS k FROM ({w}) WHERE now IS DISTINCT FROM was UNION ALL SELECT id, o, hour, 'Salimos de ' || was, {2 * k} FROM ({w}) WHERE was <> now"
    for k, w in ((k, f"SELECT id, o, hour, {c} AS now, lag({c}) OVER (ORDER BY o, id) AS was FROM (SELECT *, coalesce({_EPOCH}, id) AS o FROM sel) WHERE {c} IS NOT NULL") for k, c in enumerate(("provincia", "municipio")))
)


@query("T5b_loop_programme", f"""
WITH {_SELECTED.split('sel AS')[0]} sel AS (SELECT * FROM c WHERE hour BETWEEN 7 AND 18), g AS ({_LEVELS}), places AS (SELECT min_by(id, (o, id, k)) AS id, min_by(hour, (o, id, k)) AS hour, text FROM g GROUP BY text, floor(hour)),
m AS ({_FELT_SQL}), e AS ({_FAMILIES}), felt AS (SELECT min_by(id, (hour, id)) AS id, min(hour) AS hour, CASE family {' '.join(f"WHEN '{f}' THEN '{t}'" for f, t in _TEXTS)} END AS text FROM e WHERE felt GROUP BY family, floor(hour)),
every AS (SELECT CASE WHEN type = 'video' AND subtype = '360' THEN 'video360' ELSE type END AS kind, id, hour, '' AS text FROM sel UNION ALL SELECT 'event', id, hour, text FROM places UNION ALL SELECT 'event', id, hour, text FROM felt),
p AS (SELECT kind, id, text, i, st + greatest(0, least(1, ({_PLACE}) / arc)) * len AS t FROM every, {_ARCS} WHERE ({_PLACE}) / arc BETWEEN -1e-6 AND 1 + 1e-6)
SELECT kind, id, CAST(min(i) AS INT) AS seg_i, round(min_by(t, i), 4) AS t_loop, text FROM p GROUP BY kind, id, text""")
def programme(v):
    """The whole programme: media, places entered and left, and ambient events."""
    media = L.select_for_loop(v.media, v.metadata, [7, 16, 13, 18])
    places = place_entry_exit(media).select("id", "hour", "text")
    felt = L.ambient_events(_felt(v)).select("id", "hour", "text")
    return L.loop_spec(media, places.unionByName(felt), [7, 16, 13, 18], 300).withColumn("t_loop", F.round("t_loop", 4))
