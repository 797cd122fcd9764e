"""WARC archives of pages: records in segments with chunked bodies, and their reassembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import new_path, released_shuffles, table

CRLF = "\r\n"
#: Characters in a transfer chunk and in a record's segment.
CHUNK_CHARS, SEGMENT_CHARS = 8192, 65536
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"


def page_records(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to, repeated, refers_repeated: each page and what it repeats.

    Of pages with equal payloads of ``min_bytes`` or more, that with the smallest id is the response the others refer to. Digests are
    counted before they are joined, and joined by id, so a payload that many pages share goes to no single task. repeated and refers_repeated:
    whether rows with the same id and payload as this one, or as the response, occur more than once.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    keyed = base.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.encode("html", "UTF-8"), 256).alias("payload_digest"))
    counts = keyed.where("page_id IS NOT NULL").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("bytes"), (F.count("*") > 1).alias("repeated"))
    large = counts.where(F.col("bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(F.struct("page_id", "repeated")).alias("to"), F.max("page_id").alias("last"))
    found = counts.join(large.where("last > to.page_id").select("payload_digest", "to"), "payload_digest", "left").withColumn("to", F.when(F.col("page_id") > F.col("to.page_id"), F.col("to")))
    notes = found.where("repeated OR to IS NOT NULL").select("page_id", "payload_digest", "repeated", F.col("to.page_id").alias("refers_to"), F.col("to.repeated").alias("refers_repeated"))
    return keyed.join(notes, ["page_id", "payload_digest"], "left")


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where ``value`` is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def warc_records(records: DataFrame, chunk_chars: int = CHUNK_CHARS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``value``: the text of each WARC record, without the two line ends that close it.

    A payload is framed in transfer chunks; a block over ``segment_chars`` characters is cut into a first record and continuation
    records with the origin's identifier and their numbers, the last with the total length. Cuts fall between characters.
    """

    def cut(text: Column, size: int) -> Column:
        n = F.ceil(F.length(text) / F.lit(size)).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
        return F.when(n <= 1, F.array(text)).otherwise(parts)

    framed = F.transform(F.filter(cut(F.col("html"), chunk_chars), lambda c: c != ""), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF)))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}{CRLF}")).otherwise(F.concat(F.lit(_HTTP), F.array_join(framed, ""), F.lit(f"0{CRLF}{CRLF}")))
    blocks = records.withColumn("_total", F.octet_length(block))
    # rows with the same id and payload, or without an id, are told apart by number
    alone = F.col("page_id").isNotNull() & ~F.coalesce("repeated", F.lit(False))
    blocks = blocks.withColumn("_row", F.monotonically_increasing_id()).withColumn("_id", _uuid("page", F.col("page_id"), F.col("payload_digest"), F.when(~alone, F.col("_row"))))
    parts = blocks.select("*", F.posexplode(cut(block, segment_chars)).alias("_k", "_part"), F.ceil(F.length(block) / F.lit(segment_chars)).cast("int").alias("_n"))
    several, first = F.col("_n") > 1, F.col("_k") == 0
    rest = lambda x: F.when(several & ~first, x)
    value = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.when(first, F.col("_id")).otherwise(_uuid("part", F.col("_id"), F.col("_k")))),
        _header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        _header("WARC-Segment-Number", F.when(several, F.col("_k") + 1)),
        _header("WARC-Segment-Origin-ID", rest(F.col("_id"))),
        _header("WARC-Segment-Total-Length", rest(F.when(F.col("_k") + 1 == F.col("_n"), F.col("_total")))),
        _header("X-Page-ID", F.when(first, F.col("page_id"))),
        _header("X-Payload-Length", F.when(first, F.col("payload_bytes"))),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        _header("WARC-Refers-To", F.when(first & revisit & ~F.coalesce("refers_repeated", F.lit(False)), _uuid("page", F.col("refers_to"), F.col("payload_digest"), F.lit(None)))),
        _header("X-Refers-To-Page-ID", F.when(first, F.col("refers_to"))),
        _header("WARC-Profile", F.when(first & revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length("_part")),
        F.lit(CRLF),
        F.col("_part"),
    )
    return parts.select(value.alias("value"))


def write_warc(pages: DataFrame, path: str, file_bytes: int = 16 << 20, min_bytes: int = 100, **columns: str) -> None:
    """Write a record for each page to gzipped WARC files of about ``file_bytes`` under ``path``.

    Null html counts as empty; null ids are written without that header and revisit nothing; repeated rows are written
    each, under record ids of their own (a revisit of such a response names its page but not its record); an empty table writes no record. Other columns are not read.
    """
    n, n_bytes = pages.agg(F.count("*"), F.sum(F.octet_length(columns.get("html_col", "html")))).first()
    most = max(1, n * file_bytes // max(1, n_bytes or 0))
    records = warc_records(page_records(pages, min_bytes, **columns))
    with released_shuffles(pages.sparkSession):
        records.write.option("maxRecordsPerFile", most).option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


_RECORD = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("block", pa.binary())])
_RECORD_SQL = "record_id string, kind string, origin string, number int, total long, page_id long, payload_bytes long, digest string, refers_to long, url string, block binary"


def parsed_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, each found by the length that the one before it states."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split(CRLF)
        if lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"no record at byte {at}")
        named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(named["content-length"])
        whole = lambda k: int(named[k]) if k in named else None  # noqa: E731, B023
        yield {
            "record_id": named["warc-record-id"],
            "kind": named["warc-type"],
            "origin": named.get("warc-segment-origin-id", named["warc-record-id"]),
            "number": whole("warc-segment-number"),
            "total": whole("warc-segment-total-length"),
            "page_id": whole("x-page-id"),
            "payload_bytes": whole("x-payload-length"),
            "digest": named.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "refers_to": whole("x-refers-to-page-id"),
            "url": named.get("warc-target-uri"),
            "block": data[head + 4 : head + 4 + size],
        }
        at = head + 4 + size + 4


def dechunked(block: bytes) -> bytes:
    """The payload of an HTTP response block, out of its chunked framing if it has one."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:\s*chunked", head):
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        if len(parts[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``, reassembled: record_id, kind, page_id, payload_bytes, digest, refers_to, url, payload, verified.

    Continuation records are grouped by their origin's identifier and joined in order of their numbers; the numbers must be
    gapless and the bytes must add up to the stated total. verified says whether that holds and, for responses,
    whether the decoded payload has the stated digest. Only segmented records are shuffled. The files are read as bytes, one a row.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, held, size = content.as_py(), [], 0
                for record in parsed_records(gzip.decompress(data) if name.endswith(".gz") else data):
                    held.append(record)
                    size += len(record["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD)

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload = dechunked(r.pop("block")) if r["kind"] == "response" else None
                good = r.pop("whole") and (payload is None or hashlib.sha256(payload).hexdigest() == r["digest"])
                rows.append(r | {"payload": payload, "verified": good})
            yield pa.RecordBatch.from_pylist(rows, _PAYLOAD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    found = files.mapInArrow(records, _RECORD_SQL)
    whole = found.where("number IS NULL").select(*_PLAIN, "block", F.lit(True).alias("whole"))
    groups = found.where("number IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block", *_PLAIN, "total"))).alias("s"))
    first, last = F.col("s")[0], F.element_at("s", -1)
    joined = F.aggregate("s", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["block"]))
    rejoined = groups.select(*[first[c].alias(c) for c in _PLAIN], joined.alias("block"), (F.coalesce(last["total"] == F.octet_length(joined), F.lit(False)) & (last["number"] == F.size("s")) & (first["number"] == 1)).alias("whole"))
    return whole.unionByName(rejoined).mapInArrow(payloads, "record_id string, kind string, page_id long, payload_bytes long, digest string, refers_to long, url string, payload binary, verified boolean")


_PLAIN = ["record_id", "kind", "page_id", "payload_bytes", "digest", "refers_to", "url"]
_PAYLOAD = pa.schema([(f.name, f.type) for f in _RECORD if f.name in _PLAIN] + [("payload", pa.binary()), ("verified", pa.bool_())])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    # what a response holds is measured on its decoded payload; a revisit names both in its headers
    n = F.when(F.col("kind") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(F.col("kind") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    sound = F.when(F.col("verified"), n).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("long"))
    return read.select("page_id", sound.alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
