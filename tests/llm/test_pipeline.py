"""Each stage of the pipeline against brute force, over rows whose ids are null, repeated in full, or shared by different texts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from wayline.llm.quality_crf import fit_quality
from wayline.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "this line stands on every site"
LEAKED = [f"leak{k}" for k in range(12)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(12)]
    near = lambda t: t + " more"
    bad = lambda t: t + " " + " ".join(LEAKED[:10])
    found = [(k, t) for k, t in enumerate(texts[:6])]
    found += [(None, texts[6]), (None, texts[7]), (None, near(texts[7])), (None, near(texts[0])), (None, texts[0])]  # null ids, alone, alike, like others
    found += [(1, texts[1]), (1, texts[1]), (1, near(texts[2])), (1, texts[8]), (20, texts[8]), (21, near(texts[8]))]  # full repeats, and an id of several groups
    found += [(None, bad(texts[9])), (3, bad(texts[10])), (30, bad(texts[11])), (30, bad(texts[11]))]
    found += [(None, None), (None, ""), (None, ""), (40, ""), (41, None), (42, " ")]
    found += [(50 + k, f"site words {k} {k + 1}\n{SHARED}") for k in range(9)] + [(None, SHARED), (50, SHARED), (50, SHARED)]
    return [(i, t, "en", f"s{k % 11}", len(t or "")) for k, (i, t) in enumerate(found)]


@pytest.fixture(scope="module")
def given(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, " ".join(LEAKED)), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA), at


def result(stage, spark, given):
    out = stage(spark, *given)
    assert out.columns == given[0].columns
    return Counter(tuple(r) for r in out.collect())


def test_good_documents(spark, given, rows):
    model = fit_quality(given[0], spark.read.parquet(f"{given[1]}/labels.parquet"))
    assert result(P.good_documents, spark, given) == Counter(r for r in rows if model.scores(pa.array([r[1] or ""]))[0] >= 0.3)


def test_own_lines(spark, given, rows):
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites[line.strip()].add(r[3])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if len(x.split()) < 3 or len(sites[x.strip()]) < 8]
        if len(left) == len(lines):
            want[r] += 1
        elif " ".join(left).split():
            want[(r[0], "\n".join(left), *r[2:4], len("\n".join(left)))] += 1
    assert result(P.own_lines, spark, given) == want


def test_one_of_each_group(spark, given, rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in ((r[1] or "").split() for r in rows)]
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 10 * len(x & y) >= 8 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    groups = defaultdict(list)
    for r, g in zip(rows, label, strict=True):
        groups[g].append(r)
    least = lambda g: min((r[0] is None, r[0]) if r[0] is not None else (True, 0) for r in g)
    got = result(P.one_of_each_group, spark, given)
    assert sum(got.values()) == len(groups)
    for g in groups.values():
        kept = [r for r in got.elements() if r in g]
        assert len(kept) == 1 or not words(g[0][1])
        assert all((r[0] is None, r[0] or 0) == least(g) for r in kept)
    assert Counter(r for r in rows if not words(r[1])) == Counter(r for r in got.elements() if not words(r[1]))


def test_decontaminated(spark, given, rows):
    grams = {tuple(LEAKED[s : s + 10]) for s in range(3)}
    clean = lambda t: not any(tuple(words(t)[s : s + 10]) in grams for s in range(len(words(t))))
    want = Counter(r for r in rows if clean(r[1]))
    assert len(rows) - sum(want.values()) == 4 and want[rows[6]] == 1
    assert result(P.decontaminated, spark, given) == want


def test_packed(spark, given, rows):
    tokenizer = Tokenizer.from_file(vocabulary())
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = P.packed(spark, *given).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True))
    places = {(r["sequence_id"], k) for r in got for k in range(r["offset"], r["offset"] + r["length"])}
    assert len(places) == sum(map(len, ids)) and max(k for _, k in places) < 4096
