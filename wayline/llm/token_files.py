"""Token ids in files that give any single token without decoding a block.

A segment holds the ids of consecutive documents as directly addressable codes. An id is cut into chunks of ``BITS`` bits, the
lowest first. Level 0 has the first chunk of every id, level 1 the second chunk of those ids that have one, and so on. Each
level but the last has a bitmap that says which of its ids go on, and a directory with the number of set bits before each
run of 512. The place of an id's next chunk is the rank of its bit, so token t costs one step a level.

Layout, all little-endian: magic ``DAC1``, u32 levels, u64 ids, u64 documents; u64 starts[documents + 1]; then for each level
u64 length, the chunks (u8 each), the bitmap (a byte for 8 ids, lowest bit first), the directory (u32 for 512 ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import arrow_stage, new_path, released_shuffles, scaled_partitions, table
from .tokens import crc32_of, encoded

MAGIC, BITS, RUN = b"DAC1", 8, 512
SEGMENT_IDS = 1 << 20
#: Segments' places are broadcast to their readers up to so many segments, after they have been counted; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_SCHEMA = "first_id long, last_id long, part int, place long, n_ids long, doc_ids array<bigint>, segment binary"


def pack_segment(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The segment of documents with ``ids`` and ``starts`` (one more start than documents)."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        chunk, rest = (rest & ((1 << BITS) - 1)).astype(np.uint8), rest >> BITS
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on.astype(np.uint32), np.arange(0, len(on), RUN)) if len(on) else np.empty(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)])[: len(counts)].astype("<u4")
        levels.append(np.uint64(len(chunk)).tobytes() + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        if not on.any():
            break
        rest = rest[on]
    head = MAGIC + np.uint32(len(levels)).tobytes() + np.uint64(len(ids)).tobytes() + np.uint64(len(starts) - 1).tobytes()
    return head + np.asarray(starts, "<u8").tobytes() + b"".join(levels)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.n_ids, self.n_docs = (int(x) for x in np.frombuffer(data, "<u8", 2, 8))
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 24)
        self.levels, at = [], 24 + 8 * (self.n_docs + 1)
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            bits, runs = -(-n // 8), -(-n // RUN)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            self.levels.append((chunks, np.frombuffer(data, np.uint8, bits, at + 8 + n), np.frombuffer(data, "<u4", runs, at + 8 + n + bits)))
            at += 8 + n + bits + 4 * runs

    def token(self, t: int) -> int:
        """Token t: one chunk, one bit and one rank a level."""
        if not 0 <= t < self.n_ids:
            raise IndexError(t)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[t]) << (BITS * level)
            if not bits[t >> 3] >> (t & 7) & 1:
                break
            run = t // RUN
            inside = np.unpackbits(bits[run * RUN // 8 : (t >> 3) + 1], bitorder="little")[: t - run * RUN]
            t = int(ranks[run]) + int(inside.sum())
        return value

    def all_ids(self) -> np.ndarray:
        """Every id, level by level from the highest."""
        upper = np.empty(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here[on] |= upper << BITS
            upper = here
        return upper

    def document(self, d: int) -> np.ndarray:
        return np.array([self.token(t) for t in range(int(self.starts[d]), int(self.starts[d + 1]))], np.uint32)


def segments(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, partitions: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of ``segment_ids`` ids or more, each of whole documents in ascending id order within its partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            nonlocal place, held
            doc_ids = [x for ids, _, _ in held for x in ids]
            tokens = np.concatenate([t for _, t, _ in held])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, _, s in held]))])
            out = pa.RecordBatch.from_pylist(
                [{"first_id": doc_ids[0], "last_id": doc_ids[-1], "part": part, "place": place, "n_ids": len(tokens), "doc_ids": doc_ids, "segment": pack_segment(tokens, starts)}],
                schema=pa.schema([("first_id", pa.int64()), ("last_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())]),
            )
            place, held = place + 1, []
            return out

        for ids, tokens, starts in encoded(batches, tokenizer, "doc_id", "text"):
            ended = np.insert(tokens, starts[1:], end_id)
            held.append((ids.to_pylist(), ended, starts + np.arange(len(starts))))
            if sum(len(t) for _, t, _ in held) >= segment_ids:
                yield row()
        if held:
            yield row()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = base.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return arrow_stage(ranged, pack, _SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 32 << 20) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, to ``path``, in ascending id order.

    Texts are range-partitioned by id and encoded in that order. Segments are stored as binary cells of Parquet files: Spark's
    writers commit them whole, and reach any store that the executors share. Null texts count as empty; null ids come
    first; repeated rows are written each; an empty table writes no segment. Other columns are not read.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    rows = segments(docs, tokenizer, end_id, id_col, text_col, scaled_partitions(n_bytes, partition_bytes, least))
    with released_shuffles(docs.sparkSession):
        rows.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids of all segments before them: doc_ids, segment, base."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    sizes = rows.select("part", "place", "n_ids")  # a row for a million ids
    base = F.coalesce(F.sum("n_ids").over(W.orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", "place", base.alias("base"))
    few = F.broadcast(bases) if sizes.count() <= BROADCAST_ROWS else bases
    return rows.join(few, ["part", "place"]).select("doc_ids", "segment", "base")


def token_at(spark: SparkSession, path: str, doc_id: int, position: int) -> int:
    """Token ``position`` of the first document with ``doc_id``: Parquet's statistics choose the segment, and no other id in it is decoded."""
    rows = spark.read.schema(_SCHEMA).parquet(path).where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", doc_id))
    found = rows.orderBy("part", "place").select("segment", (F.array_position("doc_ids", doc_id) - 1).alias("d")).first()
    if found is None:
        raise KeyError(doc_id)
    segment = Segment(bytes(found["segment"]))
    start, end = (int(segment.starts[found["d"] + k]) for k in (0, 1))
    if not 0 <= position < end - start:
        raise IndexError(position)
    return segment.token(start + position)


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files in ``path``: doc_id, start (ids before it), n_tokens, ids."""
    return _documents(spark, path, lambda ids: ids.tolist(), "ids array<int>", pa.list_(pa.int32()))


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files in ``path``: doc_id, start, n_tokens, ids_crc32."""
    return _documents(spark, path, crc32_of, "ids_crc32 long", pa.int64())


def _documents(spark: SparkSession, path: str, shown, column: str, kind: pa.DataType) -> DataFrame:
    name = column.split()[0]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column("segment")[k].as_py())
                ids, starts, base = segment.all_ids(), segment.starts.astype(np.int64), batch.column("base")[k].as_py()
                values = pa.array([shown(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), values], names=["doc_id", "start", "n_tokens", name])

    return read_token_files(spark, path).mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {column}")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_checksums(spark, path)
