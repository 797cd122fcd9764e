"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wayline.llm import ranked_search as R

from test_llm import corpus


def by_rule(docs, items, k=50):
    """Sorted (item_id, rank, doc_id, score) of rows (doc_id, text) for distinct rows (item_id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n_all, n_terms, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, counts, n in held:
            m = 50 + (50 * n * n_all) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in set(terms(text)) if counts[t])
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms, k", [(400_000, 50), (5, 3), (400_000, 2)])
def test_search(spark, block_terms, k):
    df, rows = corpus(spark)
    docs = [(r[0], r[1]) for r in rows] + [(500 + j, "tied words here") for j in range(9)] + [(500, "tied words here")]
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame(docs[len(rows) :], "doc_id long, text string"))
    items = [("a", "alpha1 Beta2 beta2 GAMMA3"), ("b", "tied words"), ("c", "nothing-of-this zzz"), ("d", ""), ("e", None), (None, "line same"), ("f", "épsilon3 théta"), ("a", "delta7"), ("b", "tied words"), ("g", rows[0][1])]
    got = R.ranked_search(more.withColumnRenamed("text", "body"), spark.createDataFrame(items, "item_id string, text string"), k, text_col="body", block_terms=block_terms).collect()
    assert sorted(map(tuple, got), key=str) == by_rule(docs, items, k)


def test_reading_ends_with_full_scores():
    """Every part's best against full scores, for lists of all shapes, reads of one entry up, and floors."""
    rng = np.random.default_rng(1)
    for trial in range(60):
        n_docs, n_terms = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        full = rng.integers(0, [3, 50, 10_000][trial % 3], (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)))
        term, doc = np.nonzero(full)
        lists = R.ImpactLists(term, doc, full[term, doc], n_docs, n_terms)
        terms, k = rng.permutation(n_terms)[: int(rng.integers(1, n_terms + 1))], int(rng.integers(1, 60))
        scores = full[terms].sum(0)
        kth = np.sort(scores)[-k] if n_docs >= k else 0
        floor = int(rng.integers(0, 2)) * int(np.median(scores))
        places, found = lists.best(terms, k, floor, first_read=int(rng.integers(1, 5)))
        want = {int(d): int(scores[d]) for d in np.flatnonzero((scores >= max(1, kth, floor)))}
        assert dict(zip(places.tolist(), found.tolist(), strict=True)) == want


def test_reading_stops_early():
    """Where a few documents lead in every list, the rest of the lists isn't read."""
    n = 100_000
    impact = np.concatenate([np.full(10, 1000), np.ones(n - 10, int)])
    lists = R.ImpactLists(np.repeat([0, 1], n), np.tile(np.arange(n), 2), np.tile(impact, 2), n, 2)
    lists.doc[5000:n] = lists.doc[n + 5000 :] = -1  # entries that must not be read
    places, scores = lists.best(np.array([0, 1]), 10, 0)
    assert sorted(places) == list(range(10)) and set(scores.tolist()) == {2000}


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.selectExpr("doc_id", "cast(null as string) AS text"), items)):
        out = R.ranked_search(d, i)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
