"""A quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import arrow_stage, stored, table
from .spans import lower_ascii, text_bytes, word_hashes
from .tokens import text_slices

#: Labelled texts that a model is fitted on at most, and lines that these have together at most; a text takes part with all its lines or not at all.
SAMPLE, SAMPLE_LINES = 6000, 400_000
_LOCAL = 10
#: Bytes of text whose features are computed at a time.
_SLICE = 1 << 20


def line_features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text (a text without lines has one that is empty), bytes of each line, first line of each text.

    A line's own features: symbols, capitals, bars, exclamation marks, digits (each a share of its bytes), words equal to
    the word before, words seen in the line already, words, bytes a word, emptiness; then the first seven of the line before and of the line after.
    """
    n_texts = len(starts) - 1
    breaks = np.flatnonzero(raw == 10)
    first = np.arange(n_texts) + np.searchsorted(breaks, starts[:-1], "left")
    n_lines = n_texts + len(breaks)
    owner = np.repeat(np.arange(n_texts), np.diff(np.append(first, n_lines)))
    begins = np.empty(n_lines, np.int64)
    begins[first] = starts[:-1]
    others = np.ones(n_lines, bool)
    others[first] = False
    begins[others] = breaks + 1
    ends = np.append(begins[1:], len(raw))
    ends = np.where(np.append(owner[1:] == owner[:-1], False), ends - 1, starts[owner + 1])

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[ends] - total[begins]).astype(np.float64)

    kinds = np.zeros(256, np.uint8)
    kinds[list(b"#*$%&<>~^_=")] = 1
    kinds[65:91] = 2
    kinds[list(b"|")] = 3
    kinds[list(b"!")] = 4
    kinds[48:58] = 5
    kind = kinds[raw]
    size = (ends - begins).astype(np.float64)
    share = np.maximum(size, 1)
    low = lower_ascii(raw)
    hashes, lo, _, _ = word_hashes(low, starts)
    line = np.searchsorted(begins, lo, "right") - 1
    words = np.bincount(line, minlength=n_lines).astype(np.float64)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    each = np.maximum(words, 1)
    own = np.stack(
        [counted(kind == k) / share for k in range(1, 6)]
        + [np.bincount(line[twin], minlength=n_lines) / each, np.bincount(line[again], minlength=n_lines) / each, np.log1p(words) / 6, size / each / 20, (words == 0).astype(float)],
        axis=1,
    )
    own[:, :5] = np.minimum(own[:, :5] * 4, 2)
    same = owner[1:] == owner[:-1]
    before, after = np.zeros((n_lines, 7)), np.zeros((n_lines, 7))
    before[1:][same] = own[:-1, :7][same]
    after[:-1][same] = own[1:, :7][same]
    return np.concatenate([own, before, after, np.ones((n_lines, 1))], axis=1), size, first


@dataclass
class LineModel:
    """weights: of the features, for a good line against a bad one; moves[a, b]: from state a to b (0 bad, 1 good); document: of the text's calibration."""

    weights: np.ndarray
    moves: np.ndarray
    document: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line by forward and backward messages, and P(line and the next are a, b), summed over pairs."""
        n = np.diff(np.append(first, len(x)))
        order = np.argsort(-n, kind="stable")
        n_sorted, at = n[order], first[order]
        good = np.exp(np.clip(x @ self.weights, -30, 30))
        t = np.exp(self.moves)
        ahead, behind = np.empty(len(x)), np.empty(len(x))
        live = np.searchsorted(-n_sorted, -np.arange(int(n.max(initial=0))), "left")  # texts with more than k lines
        a = np.empty(0)
        for k, m in enumerate(live):
            i = at[:m] + k
            if k == 0:
                one, zero = good[i], np.ones(m)
            else:
                a = a[:m]
                one, zero = (a * t[1, 1] + (1 - a) * t[0, 1]) * good[i], a * t[1, 0] + (1 - a) * t[0, 0]
            a = ahead[i] = one / (one + zero)
        b = np.empty(0)
        for k in range(len(live) - 1, -1, -1):
            m = live[k]
            i = at[:m] + k
            r = np.full(m, 0.5)
            if len(b):
                j = i[: len(b)] + 1
                g = good[j]
                one, zero = t[1, 1] * g * b + t[1, 0] * (1 - b), t[0, 1] * g * b + t[0, 0] * (1 - b)
                r[: len(b)] = one / (one + zero)
            b = behind[i] = r
        one, zero = ahead * behind, (1 - ahead) * (1 - behind)
        p = one / (one + zero)
        inner = np.ones(len(x), bool)
        inner[np.append(first[1:], len(x)) - 1] = False
        i = np.flatnonzero(inner)
        left, right = np.stack([1 - ahead[i], ahead[i]], 1), np.stack([1 - behind[i + 1], behind[i + 1] * good[i + 1]], 1)
        pair = left[:, :, None] * t[None] * right[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        return p, pair.sum(0)

    def inputs(self, p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the calibration of a text sees: the length-weighted mean of its lines' marginals, and its log-odds."""
        weight = size + 1
        total = np.add.reduceat(weight, first)
        mean = np.add.reduceat(p * weight, first) / total
        odds = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        return np.stack([np.ones(len(mean)), mean, odds / 4, np.log1p(total) / 10], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """P(label 1) of each text."""
        if not len(texts):
            return np.empty(0)
        x, size, first = line_features(*text_bytes(texts))
        p, _ = self.marginals(x, first)
        return 1 / (1 + np.exp(-np.clip(self.inputs(p, size, first) @ self.document, -30, 30)))


def _ascend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam, from ``start``."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def fit_lines(x: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 120, rounds: int = 2, decay: float = 1e-3) -> LineModel:
    """Fit a model to texts' labels. At first every line has its text's label; then, of bad texts, the lines that look good are freed
    (a bad text may have good lines, not the reverse) and the model is fitted again."""
    model = LineModel(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(4))
    n = np.diff(np.append(first, len(x)))
    owner = np.repeat(np.arange(len(first)), n)
    y = labels[owner].astype(float)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    d = x.shape[1]
    flat = np.zeros(d + 4)
    for r in range(rounds):
        if r:
            p, _ = model.marginals(x, first)
            worst = np.minimum.reduceat(p, first)[owner]
            y = np.where((labels[owner] == 0) & (p > 0.5) & (p > worst), 1.0, labels[owner].astype(float))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)

        def gradient(w: np.ndarray, y=y, seen=seen) -> np.ndarray:
            now = LineModel(w[:d], w[d:].reshape(2, 2), model.document)
            p, pairs = now.marginals(x, first)
            return np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(x) - decay * w

        flat = _ascend(gradient, flat, steps, 0.1)
        model = LineModel(flat[:d], flat[d:].reshape(2, 2), model.document)
    p, _ = model.marginals(x, first)
    z = model.inputs(p, size, first)
    model.document = _ascend(lambda w: z.T @ (labels - 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))) / len(z) - 1e-4 * w, np.array([0.0, 1.0, 1.0, 0.0]), 400, 0.1)
    return model


def held_out(doc_id) -> F.Column:
    """Rows that no model sees labels of: the checksum of the id as text is divisible by 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineModel:
    """A model of the labels of rows that aren't held out, fitted on ``sample`` of them, or all if there are fewer, with ``sample_lines`` lines at most.

    The sample is drawn by a hash of the id; its texts' line features are computed by tasks. Whole texts, the shortest first, are taken until
    they would have more than ``sample_lines`` lines; these texts' features alone come to the driver. Ids
    with contradicting labels take the smaller; null ids and labels are left out. Without labels the model says 0.5 or so of everything.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_slices(pc.fill_null(texts, ""), _SLICE):
                part = texts.slice(lo, hi - lo)
                x, size, first = line_features(*text_bytes(part))
                spans = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(lo, hi - lo), pa.array([r.stop - r.start for r in spans], pa.int64()), pa.array([x[r].astype("<f4").tobytes() for r in spans], pa.binary()), pa.array([size[r].astype("<f4").tobytes() for r in spans], pa.binary())],
                    names=["label", "lines", "x", "size"],
                )

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # ``sample`` rows of an id and a label: a proven bound
    found = stored(arrow_stage(base.join(F.broadcast(drawn), "doc_id").select("label", "text"), features, "label int, lines long, x binary, size binary"), "quality-features")
    upto, longest = 0, -1
    for r in found.groupBy("lines").count().orderBy("lines").toLocalIterator():  # lengths that occur
        upto += r["lines"] * r["count"]
        if upto > sample_lines:
            break
        longest = r["lines"]
    rows = found.where(F.col("lines") <= longest).select("label", "x", "size").collect()
    if not rows:
        return LineModel(np.zeros(_LOCAL + 15), np.zeros((2, 2)), np.zeros(4))
    rows.sort(key=lambda r: (r["x"], r["label"]))  # the order in which tasks end must not matter
    sizes = [np.frombuffer(r["size"], "<f4") for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], "<f4") for r in rows]).reshape(-1, _LOCAL + 15).astype(float)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])[:-1]])
    return fit_lines(x, np.concatenate(sizes).astype(float), first, np.array([r["label"] for r in rows], float))


def score_quality(docs: DataFrame, model: LineModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and score (0 to 1, the higher the better) and predicted (1 if it reaches ``threshold``).

    A score comes from the whole text alone. Null and empty texts have one empty line. Columns named score or predicted are replaced;
    rows keep their number, repeated ones too.
    """
    weights = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            parts = [weights.scores(texts.slice(lo, hi - lo)) for lo, hi in text_slices(pc.fill_null(texts, ""), _SLICE)]
            score = np.concatenate([np.empty(0), *parts])
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("score", "predicted")}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    rest = docs.drop("score", "predicted")
    return arrow_stage(rest, scored, rest.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
