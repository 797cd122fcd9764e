"""Queries that read, merge and write (S), and the streaming jobs (R) over replayed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.loop import loop_spec, nested_spec
from ..sources import readers as R, tables as T, writers as S
from ..streaming.bursts import BURST, HOURS, selection_stream
from ..streaming.jobs import incremental_ingest, selection_bursts
from .book import Book
from .loop_queries import LOOP_PLACES
from .sequence_queries import hourly_media

book = Book()
query = book.query


def _folder(v, name: str) -> str:
    from .stored import folder

    return folder(v.spark, name)


@query("S1_load_catalog", "SELECT 'media' AS what, count(*) AS n FROM {events} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'part', count(*) FROM {part}")
def catalog(v):
    tables = R.load_catalog(v.spark, v.sf_dir, ["events", "orders", "part"])
    rows = [df.agg(F.count("*").alias("n")).select(F.lit({"events": "media"}.get(n, n)).alias("what"), "n") for n, df in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("S2_file_inventory", "SELECT CAST(page_id % 10 AS INT) AS folder, 'text' AS type, CAST(strlen(coalesce(html, '')) + 1 AS BIGINT) AS length, sha256(coalesce(html, '') || chr(10)) AS fingerprint FROM {pages}")
def inventory(v):
    """A text file for each page, in ten folders, listed again: types, lengths and hashes of contents. Tests list other types and sidecars."""
    out = _folder(v, "files")
    pages = v.pages.select((F.col("page_id") % 10).alias("folder"), F.coalesce("html", F.lit("")).alias("value"))
    # tasks move their files into place themselves; else the driver would move all of them, one by one
    moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "maxRecordsPerFile": 1}
    pages.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions"))).write.partitionBy("folder").options(**moved).text(out)
    found = R.file_inventory(v.spark, out, full_hash=True)
    return found.select(F.regexp_extract("path", r"folder=(\d+)", 1).cast("int").alias("folder"), "type", "length", "fingerprint")


@query("S2b_page_fingerprints", "SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length, sha256(coalesce(html, '')) AS fingerprint FROM {pages}")
def page_fingerprints(v):
    return R.fingerprints(v.pages, "page_id", "html")


@query("S3_read_gpx", "SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, latitude, longitude, elevation FROM {track_points}")
def gpx(v):
    """All track points written as GPX, a file for each day of a track (86,400 points where one is taken each second), and read again."""
    point = F.concat(F.lit('<trkpt lat="'), F.col("latitude").cast("string"), F.lit('" lon="'), F.col("longitude").cast("string"), F.lit('">'), F.coalesce(F.concat(F.lit("<ele>"), F.col("elevation").cast("string"), F.lit("</ele>")), F.lit("")), F.lit("<time>"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</time></trkpt>"))
    days = v.track_points.groupBy("track_id", F.to_date("time").alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", point.alias("p")))).alias("s"))
    out = _folder(v, "gpx")
    days.select(F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join("s.p", ""), F.lit("</trkseg></trk></gpx>"))).write.option("maxRecordsPerFile", 1).text(out)
    points, _, _ = R.read_gpx(v.spark, out)
    return points.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "latitude", "longitude", "elevation")


@query("S4_read_chat_export", "SELECT chat_id, message_id, from_name = 'system' AS is_system, from_name, text FROM {messages}")
def chat(v):
    m = v.messages
    entity = F.array(F.struct(F.lit("plain").alias("type"), F.col("text").alias("text")))
    row = F.struct(F.col("message_id").alias("id"), F.when(F.col("from_name") == "system", "service").otherwise("message").alias("type"), F.date_format("date_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("from_name").alias("from"), entity.alias("text_entities"))
    out = _folder(v, "chat")
    m.groupBy(F.col("chat_id").alias("id")).agg(F.collect_list(row).alias("messages")).write.json(out)
    # Spark's writer puts one chat on a line
    messages, _ = R.read_chat_export(v.spark, out, multi_line=False)
    return messages.select("chat_id", "message_id", "is_system", "from_name", "text")


@query("S5_read_text_collections", """SELECT 'T' || doc_id AS title, lang AS place, trim(replace(replace(text, '#', ''), chr(10), ' ')) AS body FROM {documents}""")
def texts(v):
    body = F.trim(F.replace(F.replace("text", F.lit("#"), F.lit("")), F.lit("\n"), F.lit(" ")))
    section = F.concat(F.lit("## T"), F.col("doc_id").cast("string"), F.lit("\nlugar: "), F.col("lang"), F.lit("\ntags: a, b\n\n"), body, F.lit("\n"))
    out = _folder(v, "texts")
    v.documents.select(section).write.text(out)
    return R.read_text_collections(v.spark, out).select("title", "place", "body")


@query("S6_export_csv", """SELECT 'media' AS "table", count(*) AS n FROM {media} UNION ALL SELECT 'metadata', count(*) FROM {metadata} WHERE key <> 'ia_keywords_sonido' AND length(coalesce(value, '')) <= 2000""")
def exported(v):
    """Both tables written as CSV; how many rows stand in the files."""
    return S.export_csv({"media": v.media, "metadata": v.metadata}, _folder(v, "csv"), ["ia_keywords_sonido"], 2000)


@query("S7_write_snapshot", "SELECT id, type FROM {media}")
def snapshot(v):
    out = _folder(v, "snapshot")
    S.write_snapshot(v.media, out)
    return v.spark.read.parquet(out).select("id", "type")


@query("S8_write_loop_spec", LOOP_PLACES)
def spec(v):
    """All media placed in a loop, written as nested JSON and read again, item by item."""
    out = _folder(v, "spec")
    media = hourly_media(v).select("id", "type", "subtype", "hour")
    S.write_loop_spec(nested_spec(loop_spec(media, media.limit(0).withColumn("text", F.lit("")), [7, 16, 13, 18], 300)), out)
    items = v.spark.read.json(out).select("kind", F.explode("items").alias("x"))
    return items.select("kind", "x.id", F.col("x.seg_i").cast("int").alias("seg_i"), F.round("x.t_loop", 4).alias("t_loop"))


_NEW = "(SELECT id * 2 AS id, 'new' AS v FROM {media} WHERE id % 5 = 0)"


@query("S9_merge_by_mode", f"""
WITH t AS (SELECT id, type AS v FROM {{media}}), n AS {_NEW} SELECT 'skip' AS mode, v, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM t)) GROUP BY v
UNION ALL SELECT 'update', v, count(*) FROM (SELECT * FROM t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) GROUP BY v UNION ALL SELECT 'replace', v, count(*) FROM (SELECT * FROM t WHERE v <> 'image' AND id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) GROUP BY v""")
def merged(v):
    t, n = v.media.select("id", F.col("type").alias("v")), v.media.where("id % 5 = 0").select((F.col("id") * 2).alias("id"), F.lit("new").alias("v"))  # of these ids half or so are known
    count = lambda mode: S.merge_by_mode(t, n, ["id"], mode, F.col("v") == "image").groupBy("v").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "v", "n")
    return count("skip").unionByName(count("update")).unionByName(count("replace"))


@query("S9b_merge_stored", book.bodies["S9_merge_by_mode"])
def merged_stored(v):
    """The same on tables stored by partitions, read again after each merge."""
    t, n = v.media.select("id", F.col("type").alias("v")), v.media.where("id % 5 = 0").select((F.col("id") * 2).alias("id"), F.lit("new").alias("v"))
    out = None
    for mode in ("skip", "update", "replace"):
        path = _folder(v, f"merge-{mode}")
        T.write_table(t, path, "v")
        T.merge_table(v.spark, path, n, ["id"], mode, "v", F.col("v") == "image")
        rows = v.spark.read.parquet(path).groupBy("v").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "v", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("S10_dedup_ingest", "SELECT min(id) AS id, content_hash AS file_hash FROM {media} WHERE content_hash NOT IN (SELECT content_hash FROM {media} WHERE type = 'image') GROUP BY content_hash")
def fresh(v):
    m = v.media.select("id", F.col("content_hash").alias("file_hash"))
    return S.dedup_ingest(m, v.media.where("type = 'image'").select("id", F.col("content_hash").alias("file_hash")))


_GONE = "(SELECT id FROM {media} WHERE ingest_batch_id = 3)"
_LINKS = "(SELECT id AS message, CASE WHEN message_id % 2 = 0 THEN chat_id END AS media_id FROM {messages})"


@query("S11_undo_batch", f"""SELECT 'media' AS what, count(*) AS n FROM {{media}} WHERE ingest_batch_id = 3 UNION ALL SELECT 'metadata', count(*) FROM {{metadata}} WHERE media_id IN {_GONE} UNION ALL SELECT 'keypoints', count(*) FROM {{keypoints}} WHERE media_id IN {_GONE}
UNION ALL SELECT 'attachments', count(*) FROM {_LINKS} WHERE media_id IN {_GONE} UNION ALL SELECT 'media left', count(*) FROM {{media}} WHERE ingest_batch_id IS DISTINCT FROM 3 UNION ALL SELECT 'metadata left', count(*) FROM {{metadata}} WHERE media_id NOT IN {_GONE}
UNION ALL SELECT 'keypoints left', count(*) FROM {{keypoints}} WHERE media_id NOT IN {_GONE} UNION ALL SELECT 'attachments left', count(*) FROM {_LINKS} UNION ALL SELECT 'attachments linked', count(media_id) FROM {_LINKS} WHERE media_id NOT IN {_GONE}""")
def undone(v):
    links = v.messages.select(F.col("id").alias("message"), F.when(F.col("message_id") % 2 == 0, F.col("chat_id")).alias("media_id"))
    preview, left = S.undo_batch(v.media, {"metadata": v.metadata, "keypoints": v.keypoints}, 3, {"attachments": links})
    for name, df in left.items():
        preview = preview.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(f"{name} left").alias("what"), "n"))
    return preview.unionByName(left["attachments"].agg(F.count("media_id").alias("n")).select(F.lit("attachments linked").alias("what"), "n"))


# media whose positions came from a track, here by their ids
_SOURCE = "CASE WHEN latitude IS NOT NULL THEN CASE id % 4 WHEN 0 THEN 'track_gps' WHEN 1 THEN 'track_interpolado' ELSE geolocation_source END END"
_TRACK = "(SELECT min(time) AS a, max(time) AS b FROM {track_points} WHERE track_id = 2)"
_IN_TRACK = f"(SELECT id FROM {{media}}, {_TRACK} WHERE timestamp_utc BETWEEN a AND b)"
_KEYPOINTS = "(SELECT media_id, CASE WHEN id % 5 = 0 THEN 'ubicacion_video' ELSE key END AS key, CASE WHEN id % 2 = 0 THEN 'track_interpolado' ELSE 'gps_propio' END AS source FROM {keypoints})"
_METADATA = "(SELECT media_id, CASE WHEN key = 'weather_label' AND media_id % 2 = 0 THEN 'ubicacion_video_gaps' ELSE key END AS key FROM {metadata})"


def _track_tables(v):
    read = lambda sql, **kw: v.spark.sql(sql, **kw)
    return {
        "media": v.media.withColumn("geolocation_source", F.expr(_SOURCE)), "keypoints": read(f"SELECT * FROM {_KEYPOINTS}", keypoints=v.keypoints), "metadata": read(f"SELECT * FROM {_METADATA}", metadata=v.metadata),
        "tracks": v.track_points.groupBy("track_id").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time")), "waypoints": v.track_points.where("elevation > 900").select("track_id", "latitude"),
    }


@query("S11b_undo_track", f"""
WITH m AS (SELECT *, {_SOURCE} AS src FROM {{media}}), x AS (SELECT m.*, coalesce(timestamp_utc BETWEEN a AND b, false) AS ins FROM m, {_TRACK}) SELECT id, CASE WHEN ins AND src = 'track_interpolado' THEN NULL ELSE latitude END AS latitude,
 CASE WHEN ins AND src = 'track_interpolado' THEN NULL ELSE longitude END AS longitude, CASE WHEN ins AND src IN ('track_interpolado', 'track_gps') THEN NULL ELSE altitude END AS altitude, CASE WHEN ins AND src IN ('track_interpolado', 'track_gps') THEN NULL ELSE src END AS geolocation_source FROM x""")
def track_undone(v):
    return S.undo_track(_track_tables(v), 2)[1]["media"].select("id", "latitude", "longitude", "altitude", "geolocation_source")


@query("S11c_undo_track_counts", f"""
WITH m AS (SELECT id, timestamp_utc, {_SOURCE} AS src FROM {{media}}) SELECT 'waypoints' AS what, count(*) AS n FROM {{track_points}} WHERE track_id = 2 AND elevation > 900 UNION ALL SELECT src, count(*) FROM m WHERE id IN {_IN_TRACK} AND src IN ('track_gps', 'track_interpolado') GROUP BY src
UNION ALL SELECT 'ubicacion_video', count(*) FROM {_KEYPOINTS} WHERE key = 'ubicacion_video' UNION ALL SELECT 'media left', count(*) FROM {{media}} UNION ALL SELECT 'keypoints left', count(*) FROM {_KEYPOINTS} WHERE NOT (media_id IN {_IN_TRACK} AND (key = 'ubicacion_video' OR starts_with(key, 'contexto_') AND source = 'track_interpolado'))
UNION ALL SELECT 'metadata left', count(*) FROM {_METADATA} WHERE NOT (media_id IN {_IN_TRACK} AND key IN ('ubicacion_video_estado', 'ubicacion_video_gaps')) UNION ALL SELECT 'tracks left', count(DISTINCT track_id) FROM {{track_points}} WHERE track_id <> 2 UNION ALL SELECT 'waypoints left', count(*) FROM {{track_points}} WHERE track_id <> 2 AND elevation > 900""")
def track_undone_counts(v):
    """The preview, and the rows that each table has left."""
    preview, left = S.undo_track(_track_tables(v), 2)
    for name, df in left.items():
        preview = preview.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(f"{name} left").alias("what"), "n"))
    return preview


@query("S11d_undo_stored_batch", f"SELECT 'media' AS what, type AS part, count(*) AS n FROM {{media}} WHERE ingest_batch_id IS DISTINCT FROM 3 GROUP BY type UNION ALL SELECT 'metadata', key, count(*) FROM {{metadata}} WHERE media_id NOT IN {_GONE} GROUP BY key")
def stored_undone(v):
    """Both tables stored by partitions, the batch removed from them, read again."""
    at = {"media": (_folder(v, "media"), "type"), "metadata": (_folder(v, "metadata"), "key")}
    for name, (path, by) in at.items():
        T.write_table(getattr(v, name).select("id", "type", "ingest_batch_id") if name == "media" else v.metadata.select("media_id", "key"), path, by)
    T.undo_stored_batch(v.spark, at, 3)
    count = lambda name: v.spark.read.parquet(at[name][0]).groupBy(F.col(at[name][1]).alias("part")).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "part", "n")
    return count("media").unionByName(count("metadata"))


@query("S12b_group_by_root", "SELECT carpeta || '/' || (id % 100) AS root, count(*) AS n FROM {media} WHERE carpeta IS NOT NULL GROUP BY 1")
def roots(v):
    return S.group_by_root(v.media.where("carpeta IS NOT NULL").select(F.concat("carpeta", F.lit("/"), (F.col("id") % 100).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path")))


@query("S12_reroot_paths", "SELECT id, CASE WHEN starts_with(carpeta || '/' || id, 'folder_1/') THEN '/mnt/new/' || id ELSE carpeta || '/' || id END AS path FROM {media}")
def rerooted(v):
    path = F.concat("carpeta", F.lit("/"), F.col("id").cast("string"))
    return v.media.select("id", S.reroot_paths(path, "folder_1", "/mnt/new/").alias("path"))


@query("R1_selection_bursts", """
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS v FROM {events} WHERE ts IS NOT NULL), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b), f AS (SELECT user_id, k, v, min((ts, v)) AS o FROM s WHERE v IS NOT NULL GROUP BY user_id, k, v),
l AS (SELECT user_id, k, string_agg(v, ',' ORDER BY o) AS "values" FROM f GROUP BY user_id, k), g AS (SELECT user_id, k, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k)
SELECT g.user_id, start, n, coalesce("values", '') AS "values" FROM g LEFT JOIN l ON l.user_id IS NOT DISTINCT FROM g.user_id AND l.k = g.k""")
def bursts(v):
    """The streaming query's batch form over the whole table; tests hold the streaming run against it."""
    e = v.events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("value"))
    return selection_bursts(e, "2 hours").select("user_id", "start", "n", F.array_join("values", ",").alias("values"))


@query("R2_incremental_ingest", "SELECT min(id) AS id, content_hash AS file_hash FROM {media} GROUP BY content_hash")
def ingested(v):
    """Two deliveries of which the second repeats hashes of the first."""
    m = v.media.select("id", F.col("content_hash").alias("file_hash"))
    half = F.broadcast(v.media.agg((F.max("id") / 2).alias("half")))  # one row
    m = m.crossJoin(half)
    first = S.dedup_ingest(m.where("id < half").drop("half"), m.limit(0).drop("half"))
    return first.unionByName(S.dedup_ingest(m.where("id >= half").drop("half"), first))


def _messages(v):
    """Choices as messages: hours (some of them none) and kinds."""
    hour = (F.hour("ts") + F.col("event_id") % 5).cast("string")
    is_hour = F.col("event_id") % 3 == 0
    return v.events.where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(is_hour, HOURS).otherwise("tags").alias("grp"), F.when(is_hour, hour).otherwise(F.col("event_type")).alias("value"))


@query("R1b_selection_stream", """
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id % 3 = 0 AS h, CASE WHEN event_id % 3 = 0 THEN CAST(hour(ts) + event_id % 5 AS VARCHAR) ELSE event_type END AS v FROM {events} WHERE ts IS NOT NULL), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b), t AS (SELECT user_id, k, v, min(ts) AS o FROM s WHERE NOT h GROUP BY user_id, k, v), l AS (SELECT user_id, k, string_agg(v, ',' ORDER BY o, v) AS tags FROM t GROUP BY user_id, k),
h AS (SELECT user_id, k, string_agg(v, ',' ORDER BY v::INT) AS hours FROM (SELECT DISTINCT user_id, k, v FROM s WHERE h AND v::INT < 24) GROUP BY user_id, k), g AS (SELECT user_id, k, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k)
SELECT g.user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, coalesce(hours, '') AS hours, coalesce(tags, '') AS tags FROM g LEFT JOIN l ON l.user_id = g.user_id AND l.k = g.k LEFT JOIN h ON h.user_id = g.user_id AND h.k = g.k""")
def burst_stream(v):
    """All messages delivered as files in three parts, in the order of time; the stream picks each up where it has left off. A last message, a month on, ends all bursts."""
    at, messages = _folder(v, "bursts"), _messages(v)
    low, high = messages.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor(3 * (F.unix_micros("ts") - F.unix_micros(F.lit(low))) / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
    end = messages.limit(1).select((F.lit(high) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast(messages.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("grp"), F.lit(None).cast("string").alias("value"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(4):
            (messages.where(part == k) if k < 3 else end).write.mode("append").parquet(f"{at}/in")
            stream = v.spark.readStream.schema(messages.schema).parquet(f"{at}/in")
            run = selection_stream(stream, 7_200_000, "1 minute").writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
            run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        v.spark.conf.set(key, before)
    out = v.spark.read.schema(BURST).parquet(f"{at}/out").where("user_id >= 0")
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", text(F.col("hours").cast("array<string>")).alias("hours"), text(F.col("chosen")["tags"]).alias("tags"))


@query("R2b_ingest_stream", "SELECT min(id) AS id, content_hash AS file_hash FROM {media} GROUP BY content_hash")
def ingest_stream(v):
    """All media delivered as files in two parts, of which the second repeats hashes of the first."""
    at = _folder(v, "ingest")
    rows = v.media.select(F.coalesce(F.col("timestamp_utc").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), "id", F.col("content_hash").alias("file_hash"))
    half = rows.agg(F.max("id")).first()[0] or 0
    for part in (F.col("id") < half / 2, F.col("id") >= half / 2):
        # of equal hashes in a delivery that with the least id comes
        least = rows.where(part).groupBy("file_hash").agg(F.min(F.struct("id", "ts")).alias("r"))
        least.select("r.ts", "r.id", "file_hash").write.mode("append").parquet(f"{at}/in")
        stream = v.spark.readStream.schema("ts timestamp, id long, file_hash string").parquet(f"{at}/in")
        incremental_ingest(stream, f"{at}/out", f"{at}/state", "400 days").awaitTermination()
    return v.spark.read.parquet(f"{at}/out").select("id", "file_hash")
