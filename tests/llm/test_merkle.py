"""The Merkle manifest against its rule said plainly, over several layers of superblocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wayline.llm import merkle

from test_llm import SCHEMA, corpus


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def by_rule(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each (doc_id, source, lang, n_chars, text)."""
    say = lambda values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    sources = {}
    for r in rows:
        odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None
        sources.setdefault(r[1], []).append((r[0], say(r), say((*r[:4], r[4] if odd else r[4].replace("\n", "")))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_of([x[1] for x in sources[s]])
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for a, s in enumerate(names):
        for k, (doc_id, leaf, fold) in enumerate(sources[s]):
            beside = ""
            for levels, place in ((trees[s], k), (top, a)):
                for level in levels[:-1]:
                    first = place - place % 3
                    left, right = "".join(level[first:place]), "".join(level[place + 1 : first + 3])
                    beside, fold, place = beside + left + right, sha(left + fold + right), place // 3
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha(beside), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def manifest(df, **how):
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return merkle.merkle_manifest(df, F.when(odd == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **how)


@pytest.mark.parametrize("levels", [7, 2])
def test_manifest(spark, levels):
    """With superblocks of nine nodes a tree has several layers of them."""
    df, rows = corpus(spark)
    hot = [(1000 + k, f"row\n{k}", "en", "sx", k, *["x"] * 7, 0.5) for k in range(70)]
    df = df.unionByName(spark.createDataFrame(hot, SCHEMA))
    got = manifest(df, levels=levels).collect()
    want = by_rule([(r[0], r[3], r[2], r[4], r[1]) for r in [*rows, *hot]])
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    for r in got:
        assert merkle.folded(r["leaf"], r["path"]) == r["root"] and merkle.sha(r["path"].replace("/", "").replace(".", "")) == r["proof_sha256"]


def test_ranges_of_one_source(spark, monkeypatch):
    """A source over many ranges is numbered without a gap, ties in the order of the leaf."""
    monkeypatch.setattr(merkle, "scaled_partitions", lambda *_: 7)
    rows = [(k // 3, "only", None, None, f"{k}") for k in range(200)] + [(5, "only", None, None, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted((tuple(r)[:7] for r in manifest(df).collect()), key=str) == by_rule(rows)


def test_manifest_of_one_row_and_none(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert sorted(tuple(r)[:7] for r in manifest(spark.createDataFrame([(1, None, None, None, None)], kind)).collect()) == by_rule([(1, None, None, None, None)])
    none = manifest(spark.createDataFrame([], kind))
    assert none.collect() == [] and none.schema["doc_id"].dataType.simpleString() == "bigint"
