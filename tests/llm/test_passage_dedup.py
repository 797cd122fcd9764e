"""Removal of earlier passages against looking each window up in a set."""

import hashlib
import random
import re

import numpy as np
import pytest

from wayline.llm import passage_dedup as P, spans

from test_llm import corpus


def by_rule(rows, length=20):
    """Sorted (doc_id, n_words, n_removed, kept) of rows (doc_id, text) in the order in which they count."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone.update(range(s, s + length))
            seen.add(window)
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check(df, rows, **how):
    got = P.passage_dedup(df, **how).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == by_rule(in_order, how.get("length", 20))


@pytest.mark.parametrize("how", [{}, {"group": 1}, {"length": 3}, {"length": 7, "group": 2}, {"length": 50}])
def test_passages(spark, how):
    """Copies, near copies, shared passages and repeats in one text; null, empty and long texts; repeated rows; clashing columns."""
    df, rows = corpus(spark)
    rng = random.Random(2)
    shared = " ".join(f"common{k % 17}" for k in range(40))
    more = [(1000 + k, f"{' '.join(rng.choice('abcde') for _ in range(rng.randint(0, 30)))} {shared}\t{k} {shared[: rng.randint(100, 300)]}") for k in range(40)]
    more += [(2000, "x " * 100), (2001, ("y " * 19)[:-1]), (2002, "y " * 20), (2003, "y\n" * 20), (2004, f"{'w' * 5000} {shared}"), (2004, f"{'w' * 5000} {shared}")]
    all_rows = [(r[0], r[1]) for r in rows] + more
    df = df.select("doc_id", "text", "place", "word", "n").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(5)
    check(df, all_rows, **how)


def test_families_of_near_copies(spark):
    """Many edits of one text: what stands earlier depends on the edits of all."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for doc_id in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(4)}"] * rng.randint(0, 2)
        rows.append((doc_id, " ".join(words)))
    for group in (4096, 3):
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, group=group)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    check(df, [(1, None), (None, "")])
    assert P.passage_dedup(df.limit(0)).collect() == []


def test_codes_of_words_that_polynomials_confuse():
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64 in any base; their codes differ, as do those of words that differ in one byte."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    words = [a, b, a[:60], b[:60], a[:64], b[:64], a[:65], "x", "y", "xy", "x" * 8, "x" * 9, "x" * 7 + "y", "é"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    lo, hi = spans.tokens_between(spans.white(raw), np.array([0, len(raw)]))
    codes = spans.word_codes(raw, lo, hi)
    assert len(set(codes.tolist())) == len(words)
    twice = np.frombuffer(" ".join([*words, *words]).encode(), np.uint8)
    lo, hi = spans.tokens_between(spans.white(twice), np.array([0, len(twice)]))
    assert (spans.word_codes(twice, lo, hi) == np.tile(codes, 2)).all()
