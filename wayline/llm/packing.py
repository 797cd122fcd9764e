"""Packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import arrow_stage, stored, table
from .tokens import crc32_of, encoded


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each whole text's ids and ``end_id``, cut at ``capacity``."""
    kind = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, tokens, starts in encoded(batches, tokenizer, "doc_id", "text"):
            rows: list[tuple] = []
            for d, lo, hi in zip(doc_ids.to_pylist(), starts[:-1], starts[1:], strict=True):
                ids = np.append(tokens[lo:hi].astype("<u4"), np.uint32(end_id))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((d, piece, at, len(part), crc32_of(part), *[part.tolist()] * with_ids))
            columns = list(zip(*rows, strict=True)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kind, strict=True)], schema=pa.schema(kind))

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_stage(base, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass
class _Bins:
    """So many sequences, all filled alike: the lengths in them, each with the rank of the first piece it takes."""

    count: int
    gap: int
    fill: list[tuple[int, int, int]] = field(default_factory=list)  # length, first rank, offset

    def split(self, n: int) -> _Bins:
        """Take ``n`` sequences away from the front; the pieces of the others rank after theirs."""
        front = _Bins(n, self.gap, list(self.fill))
        self.count, self.fill = self.count - n, [(s, r + n, o) for s, r, o in self.fill]
        return front


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, first sequence, offset).

    The plan depends on the number of pieces of each length only, so it is as large for any corpus: sequences that are filled
    alike stay one entry. Pieces over half the capacity open a sequence each, the longest first. Pieces over a third,
    again from the longest, are matched with the tightest open sequence that takes them, and open one for two of
    their kind where none does. Shorter pieces, from the longest, go to the tightest gap.
    """
    gaps: list[int] = []  # gaps that occur, ascending
    by_gap: dict[int, list[_Bins]] = {}

    def put(bins: _Bins) -> None:
        if bins.gap not in by_gap:
            bisect.insort(gaps, bins.gap)
            by_gap[bins.gap] = []
        by_gap[bins.gap].append(bins)

    def take(gap: int) -> _Bins:
        bins = by_gap[gap].pop()
        if not by_gap[gap]:
            del by_gap[gap]
            gaps.remove(gap)
        return bins

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        large = 3 * length > capacity
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                bins = take(gaps[k])
            else:
                per = 1 if 2 * length > capacity else 2 if large else max(1, capacity // length)
                bins = _Bins(-(-left // min(per, left)), capacity)
            each = 1 if large and bins.gap < capacity else max(1, min(bins.gap // length, left // bins.count))
            if large:
                each = min(each, 2)
            if bins.count * each > left:
                part = bins.split(left // each)
                put(bins)
                bins = part
            for _ in range(each):
                bins.fill.append((length, rank, capacity - bins.gap))
                bins.gap -= length
                rank += bins.count
            left -= bins.count * each
            put(bins)
    plan, sequence = [], 0
    for gap in gaps:
        for bins in by_gap[gap]:
            plan += [(s, r, bins.count, sequence, o) for s, r, o in bins.fill]
            sequence += bins.count
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece (a row with ``length`` from 1 to ``capacity``) its sequence_id and offset; other columns stay.

    Only the number of pieces of each length, ``capacity`` numbers, comes to the driver, where ``packing_plan`` decides. Pieces of one
    length are then numbered in parallel (within salted parts, whose sizes add up), and find their entry of the
    plan by length and rank. An empty table gives an empty result; repeated rows are packed each.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(packing_plan(histogram, capacity), "length long, rank0 long, n long, sequence0 long, offset long")
    parts = max(1, sum(histogram.values()) // 50_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    ranked = salted.withColumn("_r", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).select("length", "_salt", before.alias("_before"))
    placed = ranked.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1).drop("_salt", "_r", "_before")
    # the plan is bounded by the capacity, not by the data
    entry = plan.withColumnRenamed("length", "_length")
    fits = (placed["length"] == entry["_length"]) & (placed["_rank"] >= entry["rank0"]) & (placed["_rank"] < entry["rank0"] + entry["n"])
    found = placed.join(F.broadcast(entry), fits)
    return found.withColumn("sequence_id", F.col("sequence0") + F.col("_rank") - F.col("rank0")).drop("_length", "_rank", "rank0", "n", "sequence0")


def packed_sequences(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id and ids, the pieces in order of their offsets; at most ``capacity`` ids each."""
    pieces = stored(token_pieces(docs, capacity, tokenizer, end_id, True, id_col, text_col), "packing-ids")
    rows = pack(pieces, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every document's pieces stand: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and have the end id alone; null ids are kept; repeated rows are packed each; an empty table
    gives an empty result. Other columns are not read.
    """
    pieces = stored(token_pieces(docs, capacity, tokenizer, end_id, False, id_col, text_col), "packing-pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
