"""Views with the catalogue's schemas over the given tables, in SQL that several engines read alike.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "media": """
SELECT event_id AS id,
  CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'audio' WHEN 'signup' THEN 'text' ELSE 'other' END AS type,
  CASE WHEN event_type = 'click' AND user_id % 4 = 0 THEN '360' END AS subtype,
  'folder_' || CAST(user_id % 20 AS STRING) AS carpeta,
  CASE WHEN k = 13 THEN NULL ELSE ts END AS timestamp_utc,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(k * 10 AS DOUBLE) END AS duration_secs,
  CASE WHEN k % 3 = 0 THEN NULL ELSE -346e-1 + CAST(event_id % 10000 AS DOUBLE) * 8e-4 END AS latitude,
  CASE WHEN k % 3 = 0 THEN NULL ELSE -584e-1 - CAST(event_id % 10000 AS DOUBLE) * 7e-4 END AS longitude,
  CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN NULL ELSE value END AS altitude,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'metadata' ELSE 'inferido_tiempo' END AS geolocation_source,
  CASE WHEN k % 3 = 0 THEN NULL ELSE n_name END AS municipio,
  CASE WHEN k % 3 = 0 THEN NULL ELSE r_name END AS provincia,
  'author_' || CAST(user_id % 8 AS STRING) AS author,
  CASE WHEN event_type = 'view' THEN '#' || substr(md5(CAST(event_id AS STRING)), 1, 6) END AS color_1_hex,
  CASE WHEN event_type = 'view' THEN '#' || substr(md5(CAST(event_id AS STRING)), 7, 6) END AS color_2_hex,
  CASE WHEN event_type = 'view' THEN '#' || substr(md5(CAST(event_id AS STRING)), 13, 6) END AS color_3_hex,
  md5(CAST(event_id % 9000 AS STRING)) AS content_hash,
  md5(CAST(event_id AS STRING)) AS file_hash,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 6 END AS ingest_batch_id
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM {events}) e
JOIN {nation} ON n_nationkey = e.user_id % 25 JOIN {region} ON r_regionkey = n_regionkey""",
    "track_points": """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 1 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 2 ELSE 3 END AS track_id,
  ts AS time, -346e-1 + CAST(event_id % 10000 AS DOUBLE) * 8e-4 + 1e-3 AS latitude,
  -584e-1 - CAST(event_id % 10000 AS DOUBLE) * 7e-4 AS longitude,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS elevation FROM {events} WHERE event_id % 7 = 0
UNION ALL SELECT 4, ts, -346e-1 + CAST(event_id % 10000 AS DOUBLE) * 8e-4, -584e-1 - CAST(event_id % 10000 AS DOUBLE) * 7e-4, value FROM {events} WHERE event_id % 11 = 0""",
    "metadata": """
SELECT e.event_id AS media_id, 'ia_keywords' AS key,
  CASE WHEN e.event_id % 5 = 0 THEN '["' || replace(p_name, ' ', '", "') || '"]' ELSE replace(p_name, ' ', ', ') END AS value
FROM {events} e JOIN {part} ON p_partkey = e.event_id % 200 WHERE e.event_type = 'view'
UNION ALL SELECT e.event_id, 'ia_keywords_sonido', replace(p_name, ' ', ', ') || ', ' || lower(p_type) FROM {events} e JOIN {part} ON p_partkey = e.event_id % 200 WHERE e.event_type IN ('click', 'purchase') AND e.event_id % 2 = 0
UNION ALL SELECT e.event_id, 'weather_label', CASE e.user_id % 4 WHEN 0 THEN 'despejado' WHEN 1 THEN 'nublado' WHEN 2 THEN 'lluvia ligera' ELSE 'niebla' END FROM {events} e WHERE e.event_id % 3 <> 0
UNION ALL SELECT e.event_id, 'texto_completo', d.text FROM {events} e JOIN {documents} d ON d.doc_id = e.event_id % 200 WHERE e.event_type = 'signup'""",
    "segments": """
SELECT e.event_id AS media_id, CAST(c.turn * 7 AS DOUBLE) AS inicio, CAST(c.turn * 7 + 1 + c.conv_id % 6 AS DOUBLE) AS fin, c.text AS texto
FROM {conversations} c JOIN (SELECT event_id FROM {events} WHERE event_type IN ('click', 'purchase')) e ON e.event_id = c.conv_id""",
    "messages": """
SELECT conv_id * 100 + turn AS id, conv_id AS chat_id, turn AS message_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS es_sistema,
  role AS from_name, text, TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 400 + turn AS INT) * INTERVAL '1' MINUTE AS date_utc FROM {conversations}""",
    "gazetteer": """
SELECT n_name AS municipio, r_name AS provincia, -346e-1 + CAST(n_nationkey AS DOUBLE) * 32e-2 AS lat_min, -346e-1 + CAST(n_nationkey + 1 AS DOUBLE) * 32e-2 AS lat_max,
  -66e0 AS lon_min, -58e0 AS lon_max FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""",
    "keypoints": """
SELECT media_id * 1000 + CAST(inicio AS INT) AS id, media_id, inicio AS offset_secs,
  CASE CAST(inicio AS INT) % 3 WHEN 0 THEN 'transcription' WHEN 1 THEN 'contexto_clima' ELSE 'contexto_ubicacion' END AS key, texto AS value FROM {segments}""",
    "hourly_weather": """
SELECT CAST(timestamp_utc AS DATE) AS day, hour(timestamp_utc) AS hour, CAST(floor(latitude * 10 + 5e-1) AS INT) AS lat_bin, CAST(floor(longitude * 10 + 5e-1) AS INT) AS lon_bin,
  floor((avg(CAST(id % 400 AS DOUBLE)) / 10 - 5) * 1000 + 5e-1) / 1e3 AS temperature, hour(timestamp_utc) % 4 AS code, CAST(max(id) % 360 AS INT) AS wind_degrees
FROM {media} WHERE latitude IS NOT NULL AND timestamp_utc IS NOT NULL AND hour(timestamp_utc) % 5 <> 0
GROUP BY CAST(timestamp_utc AS DATE), hour(timestamp_utc), CAST(floor(latitude * 10 + 5e-1) AS INT), CAST(floor(longitude * 10 + 5e-1) AS INT)""",
}


def needed(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The given tables and these views, by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                made = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needed(VIEWS[name])})
            else:
                raise AttributeError(name)
            self._made[name] = made
        return self._made[name]


def with_views(body: str) -> str:
    """``body`` in plain SQL, with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in needed(VIEWS[name]):
                visit(n)
            order.append(name)

    for name in needed(body):
        visit(name)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(body).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
