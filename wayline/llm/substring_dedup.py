"""Removal of long strings that stand more than once, by hashes of text at sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import arrow_stage, discard, stored, table
from .spans import powers, prefix_hashes, range_hashes, text_bytes
from .tokens import text_slices

#: Bytes that each sampled suffix shares with every window it stands for.
GRAM = 32
#: Extents at which windows are compared: all of a suffix's, then so many together, then each.
STEPS = (16, 1)
_SLICE = 2 << 20
_ROW = pa.schema([("digest", pa.binary()), ("place", pa.int64()), ("core", pa.int64()), ("whole", pa.int64())])
_SQL = "digest binary, place long, core long, whole long"


def sampled_suffixes(raw: np.ndarray, starts: np.ndarray, prefix: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (byte places) such that each ``length``-byte window begins at most ``length - gram`` before one, and the
    windows, first and last, that each stands for.

    A window's suffix is where the least hash (30 bits) of ``gram`` bytes in it stands, the leftmost of equals: the window's content alone
    decides, in texts of any length.
    """
    span = length - gram + 1
    n = len(raw) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    at = np.arange(len(raw) - gram + 1)
    inverse = powers(len(raw), inverse=True)
    h = (prefix[gram:] - prefix[: len(at)]) * inverse[: len(at)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    places = np.uint64((1 << 34) - 1)
    least = (h & ~places) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[span - reach : span - reach + n])
    place = (least & places).astype(np.int64)
    window = np.arange(n)
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    inside = window + length <= ends
    place, window = place[inside], window[inside]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    return place[first], window[first], window[last]


def _rows(digests: pa.Array, owner: np.ndarray, starts: np.ndarray, prefix, second, length: int, suffix, lo, hi, core_from, core_to, block=0) -> pa.RecordBatch:
    """Rows of the windows that begin ``lo`` to ``hi`` bytes before a suffix.

    core: hash of what all windows of the step have in common. whole: hash, by other symbols, of all bytes of these windows. If both are
    equal, so are all windows, though neither hash alone is trusted to say so. place: the suffix's byte, lo and hi in one number.
    """
    where = ((hi << 8) + lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    core = range_hashes(prefix, core_from, core_to).view(np.int64) ^ (np.asarray(block, np.int64) * 0x5851F42D4C957F2D)
    whole = range_hashes(second, suffix - hi, suffix - lo + length) ^ where
    place = ((suffix - starts[owner]) << 16) + (hi << 8) + lo
    return pa.RecordBatch.from_arrays([digests.take(pa.array(owner)), pa.array(place), pa.array(core), pa.array(whole.view(np.int64))], schema=_ROW)


def _first_step(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column("text"), _SLICE):
                raw, starts = text_bytes(batch.column("text").slice(lo, hi - lo))
                prefix, second = prefix_hashes(raw), prefix_hashes(raw, 1)
                a, p1, p2 = sampled_suffixes(raw, starts, prefix, length)
                owner = np.searchsorted(starts, p1, "right") - 1
                yield _rows(batch.column("digest").slice(lo, hi - lo), owner, starts, prefix, second, length, a, a - p2, a - p1, a, a + GRAM)

    return arrow_stage(docs.select("digest", "text"), run, _SQL)


def _next_step(texts: DataFrame, length: int, step: int) -> DataFrame:
    """``texts`` has, with each text, the places to look at more closely. Rows as of the first step, each for at most ``step`` offsets,
    aligned to multiples of ``step``, so that equal windows always fall into like rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in text_slices(batch.column("text"), _SLICE):
                part = batch.slice(x, y - x)
                raw, starts = text_bytes(part.column("text"))
                prefix, second = prefix_hashes(raw), prefix_hashes(raw, 1)
                spots = part.column("spots")
                owner = np.repeat(np.arange(y - x), np.diff(np.asarray(spots.offsets)))
                place = spots.flatten().to_numpy(zero_copy_only=False)
                a, lo, hi = place >> 16, place & 255, (place >> 8) & 255
                first = lo // step
                count = hi // step - first + 1
                block = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                owner, a, lo, hi = (np.repeat(v, count) for v in (owner, a, lo, hi))
                lo, hi = np.maximum(lo, block * step), np.minimum(hi, block * step + step - 1)
                suffix = a + starts[owner]
                core = suffix - block * step
                for k in range(0, len(owner), 500_000):
                    s = slice(k, k + 500_000)
                    yield _rows(part.column("digest"), owner[s], starts, prefix, second, length, suffix[s], lo[s], hi[s], core[s], core[s] - step + 1 + length, block[s])

    return arrow_stage(texts.select("digest", "text", "spots"), run, _SQL)


def repeated_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """digest, places: runs of windows whose ``length`` bytes stand elsewhere too, in the same text or another.

    ``docs`` has text (not null) and digest, its hash of 128 bits. A row stands for the windows of one suffix. Rows with equal hashes are copies: all their
    windows repeat. Rows with the same core but other bytes may share some windows: one row for each of such contents goes on to the
    next, finer step; the last compares single windows. Rows are only ever counted by hash, with partial sums on each task, so
    a passage in any number of documents loads no task. What a step has written goes as soon as the next has been written.
    """
    found, rows = [], stored(_first_step(docs, length), "substring-rows")
    copy = docs.groupBy("digest").agg(F.min("doc_id").alias("one_id"))  # of equal texts one is looked at more closely
    for step in (*STEPS, 0):
        kinds = stored(rows.groupBy("core", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("digest", "place")).alias("one")), "substring-kinds")
        repeated = kinds.where("copies > 1").select("core", "whole")
        found.append(stored(rows.join(repeated, ["core", "whole"], "left_semi").select("digest", "place").distinct(), "substring-found"))
        discard(rows)
        if not step:
            discard(kinds)
            break
        unlike = kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        spots = kinds.select("core", "one").join(unlike, "core", "left_semi").groupBy("one.digest").agg(F.collect_list("one.place").alias("spots"))
        spots = stored(spots.join(copy, "digest").withColumnRenamed("digest", "one_digest"), "substring-spots")
        discard(kinds)
        rows = stored(_next_step(docs.join(spots, (F.col("digest") == F.col("one_digest")) & F.col("doc_id").eqNullSafe(F.col("one_id"))), length, step), "substring-rows")
        discard(spots)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged_runs(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that windows ``first`` to ``last`` cover, merged where they overlap or touch."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate(last[order] + length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1] if len(lo) else hi


def substring_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also begins anywhere else, the same text included.

    Strings are judged on the texts as given, so every copy goes, the first too. Returns per input row doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, and kept, the other bytes, if asked for. Null texts count as empty; rows repeated in full
    are copies of one another; null ids are kept; extra columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    runs = repeated_windows(base, length).groupBy("digest").agg(F.collect_list("place").alias("runs"))
    kind = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (doc_id, runs_of) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("runs"), strict=True)):
                text = batch.column("text")[k].as_buffer().to_pybytes()
                if runs_of.is_valid:
                    place = runs_of.values.to_numpy(zero_copy_only=False)
                    lo, hi = merged_runs((place >> 16) - ((place >> 8) & 255), (place >> 16) - (place & 255), length)
                    kept = b"".join(text[x:y] for x, y in zip([0, *hi], [*lo, len(text)], strict=True))
                    row = (doc_id, len(text), len(text) - len(kept), len(lo))
                else:
                    kept, row = text, (doc_id, len(text), 0, 0)
                out.append((*row, hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
            columns = list(zip(*out, strict=True)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kind, strict=True)], schema=pa.schema(kind))

    return arrow_stage(base.join(runs, "digest", "left").select("doc_id", "text", "runs"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_kept=False)
