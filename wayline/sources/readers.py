"""Readers of files, tracks, chats and texts into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip

MEDIA_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("id", T.LongType()), ("type", T.StringType()), ("subtype", T.StringType()), ("carpeta", T.StringType()), ("timestamp_utc", T.TimestampNTZType()), ("duration_secs", T.DoubleType()),
        ("latitude", T.DoubleType()), ("longitude", T.DoubleType()), ("altitude", T.DoubleType()), ("geolocation_source", T.StringType()), ("municipio", T.StringType()), ("provincia", T.StringType()),
        ("author", T.StringType()), ("color_1_hex", T.StringType()), ("color_2_hex", T.StringType()), ("color_3_hex", T.StringType()), ("content_hash", T.StringType()), ("file_hash", T.StringType()), ("ingest_batch_id", T.LongType()),
    ]]
)
EXTENSIONS = {"jpg": "image", "jpeg": "image", "png": "image", "mp4": "video", "mov": "video", "mp3": "audio", "wav": "audio", "m4a": "audio", "md": "text", "txt": "text", "parquet": "table"}


def load_catalog(spark: SparkSession, folder: str, names: list[str], schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """Tables of a catalogue kept as Parquet, each with its fixed schema where one is given."""
    read = lambda n: spark.read.schema(schemas[n]) if schemas and n in schemas else spark.read
    return {n: read(n).parquet(f"{folder}/{n}.parquet") for n in names}


def file_inventory(spark: SparkSession, root: str, full_hash: bool = False, extensions: dict[str, str] = EXTENSIONS) -> DataFrame:
    """path, type, length, fingerprint of all files under ``root`` with a known extension, no sidecars: size and time, or, in full, the hash of the content (else contents aren't read). Spark's reader
    leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kinds = F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    quick = F.concat_ws("-", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string"))
    rows = files.where(~F.col("path").rlike(r"/\._|\.(xmp|aae|thm)$"))
    return rows.select("path", F.try_element_at(kinds, ext).alias("type"), "length", (F.sha2("content", 256) if full_hash else quick).alias("fingerprint")).where("type IS NOT NULL")


def fingerprints(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, length, fingerprint of files whose content is a column: its bytes and their SHA-256, as ``file_inventory`` has them in full. Null content is empty."""
    raw = F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    return files.select(key, F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("fingerprint"))


def read_gpx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Track points (file, time, latitude, longitude, elevation), waypoints (name added) and a header per file (first and last time, number of points)."""
    point = "_lat double, _lon double, ele double, time string, name string"
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(point).load(path).withColumn("file", F.input_file_name())
    time = F.try_to_timestamp(F.regexp_replace("time", r"(\.\d+)?(Z|\+00:00)$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    columns = ["file", time.alias("time"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("ele").alias("elevation")]
    points = read("trkpt").select(*columns)
    header = points.groupBy("file").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n_points"))
    return points, read("wpt").select(*columns, F.col("name")), header


_ENTITY = "array<struct<type:string,text:string>>"
CHAT_SCHEMA = f"id long, name string, messages array<struct<id:long,type:string,date:string,`from`:string,text_entities:{_ENTITY},photo:string,file:string,mime_type:string,location_information:struct<latitude:double,longitude:double>,action:string>>"


def read_chat_export(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Messages (chat_id, message_id, is_system, date_utc, from_name, text, hashtags, kind) and attachments (chat_id, message_id, n, kind, path or place) of chat exports in JSON."""
    rows = spark.read.schema(CHAT_SCHEMA).option("multiLine", multi_line).json(path).select(F.col("id").alias("chat_id"), F.explode("messages").alias("m"))
    entities = F.coalesce("m.text_entities", F.array().cast(_ENTITY))
    tags = F.array_sort(F.array_distinct(F.transform(F.filter(entities, lambda e: e["type"] == "hashtag"), lambda e: F.lower(e["text"]))))
    kind = F.when(F.col("m.photo").isNotNull(), "photo").when(F.col("m.location_information").isNotNull(), "location").when(F.col("m.file").isNotNull(), "file").otherwise("text")
    messages = rows.select(
        "chat_id", F.col("m.id").alias("message_id"), F.coalesce(F.col("m.type") == "service", F.lit(False)).alias("is_system"), F.try_to_timestamp("m.date", F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("date_utc"),
        F.col("m.from").alias("from_name"), F.array_join(F.transform(entities, lambda e: e["text"]), "").alias("text"), tags.alias("hashtags"), kind.alias("kind"),
    )
    place = F.concat_ws(", ", F.col("m.location_information.latitude").cast("string"), F.col("m.location_information.longitude").cast("string"))
    found = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), x.alias("value"))) for k, c, x in (("photo", F.col("m.photo"), F.col("m.photo")), ("file", F.col("m.file"), F.col("m.file")), ("location", F.col("m.location_information"), place))]), lambda a: a.isNotNull())
    attachments = rows.select("chat_id", F.col("m.id").alias("message_id"), F.posexplode(found).alias("n", "a")).select("chat_id", "message_id", "n", "a.kind", "a.value")
    return messages, attachments


def _field(head: Column, name: str) -> Column:
    return F.nullif(strip(F.regexp_extract(head, rf"(?im)^{name}\s*:\s*(.+)$", 1)), F.lit(""))


def read_text_collections(spark: SparkSession, path: str) -> DataFrame:
    """file, section, title, date, author, place, latitude, longitude, tags, body: one row per '## ' section of Markdown files.

    Up to four 'key: value' lines open a section (fecha, autor, lugar, tags); tags of the front matter and of the section are united. A place
    of two numbers is a coordinate.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    parts = F.split(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", ""), r"(?m)^## ")
    rows = files.select("file", front.alias("front"), F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("section", "raw"))
    lines = F.split("raw", "\n")
    known = r"(?i)^(fecha|autor|lugar|tags)\s*:"
    heads = F.aggregate(F.slice(lines, 2, 4), F.lit(0), lambda n, x: F.when((n >= 0) & x.rlike(known), n + 1).otherwise(F.when(n >= 0, -n - 1).otherwise(n)), lambda n: F.when(n >= 0, n).otherwise(-n - 1))
    rows = rows.withColumns({"title": F.trim(lines[0]), "_n": heads}).withColumns({"_head": F.array_join(F.slice(lines, 2, F.col("_n")), "\n"), "body": strip(F.array_join(F.slice(lines, F.col("_n") + 2, F.greatest(F.size(lines), F.lit(1))), "\n"))})
    tags = lambda c: F.filter(F.transform(F.split(F.coalesce(_field(c, "tags"), F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    place = _field(F.col("_head"), "lugar")
    number = lambda k: F.nullif(F.regexp_extract(place, r"^(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)$", k), F.lit("")).try_cast("double")
    return rows.select(
        "file", "section", "title", _field(F.col("_head"), "fecha").alias("date"), F.coalesce(_field(F.col("_head"), "autor"), _field(F.col("front"), "autor")).alias("author"), place.alias("place"),
        number(1).alias("latitude"), number(2).alias("longitude"), F.array_union(tags(F.col("front")), tags(F.col("_head"))).alias("tags"), "body",
    )
