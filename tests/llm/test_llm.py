"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import decontaminate, jaccard_join, line_dedup, packing, quality_crf, quality_rules, sharding, substring_dedup, token_files, warc
from wayline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, h string, place string, word string, shard string, n string, sid string, score double"


def corpus(spark, empty=False):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "***", "x|y"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    shared = "A line that every single site shows at its end, word for word, again and again, so that it is boilerplate for all of them and over two hundred bytes long in order to be found by the removal of repeated strings."
    texts = [t + ("\n" + shared if k % 2 else "") for k, t in enumerate(texts)]
    texts += [texts[0], texts[1], texts[2] + " more", texts[4].replace("alpha", "omega", 1), "", "   \n ", "one", "one two", "One two", None, "long " * 8000, "\n".join(["same line here now"] * 9)]
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 12}" if k % 13 else None, len(t or ""), "d", "h", "p", "w", "s", "n", "i", 0.5) for k, t in enumerate(texts)]
    rows += [rows[3], (None, "a null id", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([] if empty else rows, SCHEMA), [] if empty else rows


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(pattern, low)


def test_jaccard(spark):
    df, rows = corpus(spark)
    sets = {}
    for k, r in enumerate(rows):
        w = words_of(r[1])
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)].append(r[0])
    want = sorted(((r[0], len(sets[k]), min(least[root(k)], default=None)) for k, r in enumerate(rows)), key=str)
    for salt in (50_000, 1):
        got = jaccard_join.jaccard_components(df, salt_over=salt).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_jaccard_family_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(300)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(300)] = str(rng.random())
        texts.append(" ".join(t))
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_components(df).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    label = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_jaccard_of_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64 in any base."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x"), (4, f"{b} x"), (5, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_tree_pairs_against_all_pairs():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 6, (900, jaccard_join.GROUPS))
    points[450:] = np.maximum(points[:450] + rng.integers(-1, 2, (450, jaccard_join.GROUPS)) * (rng.random((450, jaccard_join.GROUPS)) < 0.1), 0)
    points[:300] //= 3
    n, classes = points.sum(1), np.arange(900)
    tree = jaccard_join.CountTree(points, n)
    assert len(tree.levels) == 3
    got = [(min(x, y), max(x, y)) for a, b in tree.pairs(80, [classes]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(900) for j in np.flatnonzero((100 * np.minimum(n[i], n) >= 80 * np.maximum(n[i], n)) & (np.minimum(points[i], points).sum(1) * 180 >= 80 * (n[i] + n))).tolist() if i < j}
    assert len(got) == len(want) and set(got) == want


def test_jaccard_null_ids_join_others(spark):
    words = [f"w{k}" for k in range(60)]
    a, bridge, c = " ".join(words), " ".join([*words[:-5], *"vwxyz"]), " ".join([*words[5:-5], *"vwxyz"])
    df = spark.createDataFrame([(1, a), (None, bridge), (None, bridge), (3, c), (None, "alone here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (None, 1), (3, 1), (None, None)], key=str)


@pytest.mark.parametrize("unit", [1 << 20, 6000])
def test_jaccard_families_that_hardly_link(spark, monkeypatch, unit):
    """Families whose members' similarities lie around the threshold, with a very frequent shingle, in one unit and in parts."""
    rng = random.Random(8)
    texts = []
    for family in range(4):
        base = [f"f{family}w{rng.random()}" for _ in range(80 + 20 * family)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = str(rng.random())
            texts.append(" ".join([*t, *"a very frequent little phrase".split()]))
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for _ in sets:
        old = list(label)
        for a, x in enumerate(sets):
            for b in range(a):
                if label[a] != label[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    assert 4 < len(set(label)) < 100
    rows, found, links = jaccard_join.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), salt_over=4)
    doc = {r["sid"]: r["doc"] for r in found.collect()}
    assert all(100 * len(sets[doc[r["a"]]] & sets[doc[r["b"]]]) >= 80 * len(sets[doc[r["a"]]] | sets[doc[r["b"]]]) for r in links.collect())
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), salt_over=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (3, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}


def test_sharding(spark):
    df, rows = corpus(spark)
    got = sharding.shard(df, n_shards=5).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    totals, slots = Counter(), defaultdict(list)
    for r in got:
        totals[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in got} == {"bytes"}
    biggest = max(size(r[1]) for r in rows)
    assert all(abs(t - sum(totals.values()) / 5) <= biggest for t in totals.values())


def test_sharding_splits_a_hot_text(spark):
    df = spark.createDataFrame([(k, "hot " * 50 if k % 3 else f"t{k} " * 50) for k in range(3000)], "doc_id long, text string")
    totals = [r["sum(size)"] for r in sharding.shard(df, n_shards=8).groupBy("shard").sum("size").collect()]
    assert len(totals) == 8 and max(totals) - min(totals) < 0.1 * np.mean(totals)


def test_packing(spark):
    df, rows = corpus(spark)
    got = packing.pack_documents(df, capacity=256).collect()
    from tokenizers import Tokenizer

    from wayline.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 256):
            want[(r[0], p // 256, p, len(ids[p : p + 256]), zlib.crc32(np.array(ids[p : p + 256], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.05 * -(-sum(r["length"] for r in got) // 256) + 1


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 30, 40), strict=True)}
    plan = packing.packing_plan(histogram, 100)
    seen, bins = Counter(), defaultdict(list)
    for length, rank, n, sequence, offset in plan:
        for k in range(n):
            seen[(length, rank + k)] += 1
            bins[sequence + k].append((offset, length))
    assert seen == Counter((length, k) for length, n in histogram.items() for k in range(n))
    for b in bins.values():
        b.sort()
        assert all(o == sum(x[1] for x in b[:k]) for k, (o, _) in enumerate(b)) and sum(x[1] for x in b) <= 100


def test_line_dedup(spark):
    df, rows = corpus(spark)
    got = line_dedup.without_shared_lines(df, min_sites=4)
    assert set(df.columns) < set(got.columns)
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(line.split()) >= 3:
                sites[line.strip(" \t\x0b\f\r")].add(r[3] or "")
    bad = {k for k, s in sites.items() if len(s) >= 4}
    keep = lambda t: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\x0b\f\r") not in bad)
    assert bad and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], keep(r[1])) for r in rows)


def test_line_dedup_joins_and_word_counts(spark, monkeypatch):
    lines = ["a", "a b", "a b c", " \tx\x0b y\x0cz\t ", "é\u00a0è ö ü", "", "   ", "one two three four " * 300, "w" * 200_000]
    df = spark.createDataFrame([(k, "\n".join([*lines, f"own line of {k}"]), f"s{k % 5}") for k in range(10)], "doc_id long, text string, source string")
    for least in (0, 1, 2, 3, 4):
        want = [line for line in lines if len([w for w in re.split("[\x20\x09-\x0d]+", line) if w]) < least]
        for limit in (500_000, 0):  # keys broadcast, and joined by a shuffle
            monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
            got = {r["doc_id"]: r["text"] for r in line_dedup.without_shared_lines(df, min_sites=5, min_words=least).collect()}
            assert got == {k: "\n".join([*want, f"own line of {k}"]) for k in range(10)}


def test_spread_near_the_threshold_is_exact(spark):
    df = spark.createDataFrame([(k, f"line number {n}", f"s{s}") for n in range(30) for k, s in enumerate(range(n * 10))], "doc_id long, text string, source string")
    got = line_dedup.without_shared_lines(df, min_sites=100).where("n_removed > 0").select("text", "source").count()
    assert got == sum(n * 10 for n in range(30) if n * 10 >= 100)


def test_decontamination(spark):
    df, rows = corpus(spark)
    items = [(1, rows[5][1]), (2, "One Two"), (3, ""), (4, None), (10, " ".join(words_of(rows[7][1])[2:14])), (None, rows[8][1])]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = defaultdict(set)
    for i, t in items:
        w = words_of(t, pattern)
        for s in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[s : s + 10])].add(i)
    want = []
    for r in rows:
        w, hit, found = words_of(r[1], pattern), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[g]
        want.append((r[0], len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), bool(hit)))
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_token_files(spark, tmp_path):
    df, rows = corpus(spark)
    token_files.write_token_files(df, str(tmp_path / "t"))
    got = sorted(token_files.token_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    from tokenizers import Tokenizer

    from wayline.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    ids = {k: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for k, r in enumerate(rows)}
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r[0], tuple(ids[k])) for k, r in enumerate(rows))
    assert all(token_files.token_at(spark, str(tmp_path / "t"), rows[k][0], p) == ids[k][p] for k, p in ((0, 0), (5, 3), (70, -1 + len(ids[70]))))
    with pytest.raises(IndexError):
        token_files.token_at(spark, str(tmp_path / "t"), 0, len(ids[0]))
    with pytest.raises(KeyError):
        token_files.token_at(spark, str(tmp_path / "t"), 10_000, 0)
    sums = token_files.token_checksums(spark, str(tmp_path / "t")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sums) == Counter((r[0], len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, r in enumerate(rows))


def test_any_token_of_a_segment():
    rng = np.random.default_rng(4)
    ids = rng.choice([1, 200, 255, 256, 49_000, 70_000, 2**31], 3000).astype(np.uint32)
    s = token_files.Segment(token_files.pack_segment(ids, np.array([0, 10, 10, 3000])))
    assert (s.all_ids() == ids).all() and all(s.token(t) == ids[t] for t in range(0, 3000, 7))
    assert (s.document(0) == ids[:10]).all() and len(s.document(1)) == 0
    with pytest.raises(IndexError):
        s.token(3000)


def test_quality_rules(spark):
    df, rows = corpus(spark)
    got = quality_rules.quality_rules(df, spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int"))
    want = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {x for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for x in range(i, i + 8)}
        lines = [x for x in (r[1] or "").split("\n") if x.strip(" \t\x0b\f\r")]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(covered), failed, not failed))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got.collect()) == Counter(want)


def test_binomial_tail_and_cutoffs(spark):
    from math import comb

    cases = [(0, 10), (3, 100), (7, 400), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p"))
    for r in df.collect():
        k, n = r["k"], r["n"]
        want = 1.0 if not n or k >= 0.05 * n else sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
        assert r["p"] == pytest.approx(want)
    text = lambda k: " ".join(f"w{k}x{j}" + ("***" if k % 10 == 0 else "") for j in range(30))
    docs = spark.createDataFrame([(k, text(k), "en") for k in range(5000)], "doc_id long, text string, lang string")
    out = quality_rules.quality_rules(docs, spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(5000)], "doc_id long, quality int"))
    kept = {r["doc_id"] for r in out.where("kept").collect()}
    assert kept == {k for k in range(5000) if k % 10}


def test_substring_dedup(spark):
    df, rows = corpus(spark)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[p : p + 200] for _, b in texts for p in range(len(b) - 199))
    want = Counter()
    for i, b in texts:
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                mark[p : p + 200] = True
        kept = bytes(x for x, m in zip(b, mark, strict=False) if not m)
        want[(i, len(b), int(mark.sum()), int((mark[:-1] & ~np.concatenate([[False], mark[:-2]])).sum()) if b else 0, kept)] += 1
    got = substring_dedup.substring_dedup(df).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_quality_classifier(spark):
    rng = random.Random(1)
    line = lambda bad: " ".join(f"w{rng.randint(0, 99)}" + ("###" if bad else "") for _ in range(8))
    docs = spark.createDataFrame([(k, "\n".join(line(k % 3 == 0 and j) for j in range(4)), 0.1) for k in range(300)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    model = quality_crf.fit_quality(docs, labels)
    out = quality_crf.score_quality(docs, model).withColumn("held", quality_crf.held_out(F.col("doc_id"))).where("held").collect()
    assert len(out) > 30 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out]) > 0.95
    df, rows = corpus(spark)
    got = quality_crf.score_quality(df, model)
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0 and set(got.columns) == {*df.columns, "predicted"}
    assert quality_crf.fit_quality(df, labels.limit(0)).scores is not None


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    x, first = rng.normal(size=(7, 3)), np.array([0, 4, 5])
    m = quality_crf.LineModel(rng.normal(size=3), rng.normal(size=(2, 2)), np.zeros(4))
    p, pairs = m.marginals(x, first)
    total = np.zeros((2, 2))
    for a, b in zip(first, [4, 5, 7], strict=True):
        weight, mark, moves = 0, np.zeros(b - a), np.zeros((2, 2))
        for s in range(2 ** (b - a)):
            y = [(s >> k) & 1 for k in range(b - a)]
            w = np.exp(sum(x[a + k] @ m.weights for k in range(b - a) if y[k]) + sum(m.moves[y[k], y[k + 1]] for k in range(b - a - 1)))
            weight, mark = weight + w, mark + w * np.array(y)
            for k in range(b - a - 1):
                moves[y[k], y[k + 1]] += w
        assert p[a:b] == pytest.approx(mark / weight)
        total += moves / weight
    assert pairs == pytest.approx(total)


def test_warc(spark, tmp_path):
    long = "é" * 90_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "u", "x" * 99, 0), (2, "u", "x" * 99, 0), (5, None, "y" * 100, 0), (3, "a b", "y" * 100, 0), (4, "u", long, 0), (9, "u", long, 0), (7, "u", "", 0), (8, "u", None, 0), (8, "u", None, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert all(r["verified"] for r in got)
    assert sorted((r["page_id"], r["kind"], r["refers_to"] or 0) for r in got) == sorted([(1, "response", 0), (2, "response", 0), (3, "response", 0), (5, "revisit", 3), (4, "response", 0), (9, "revisit", 4), (7, "response", 0), (8, "response", 0), (8, "response", 0)])
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["kind"] == "response"} == {p: h or "" for p, _, h, _ in rows if p not in (5, 9)}


def test_warc_repeated_rows_in_segments(spark, tmp_path):
    long = "0123456789" * 20_000
    rows = [(None, "u", long), (None, "u", long), (1, "u", long), (1, "u", long), (2, "u", long), (3, "u", long + "x"), (4, "u", long + "x")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert all(r["verified"] for r in got) and len({r["record_id"] for r in got}) == 7
    assert Counter((r["page_id"], r["kind"], r["refers_to"]) for r in got) == Counter([(None, "response", None)] * 2 + [(1, "response", None)] * 2 + [(2, "revisit", 1), (3, "response", None), (4, "revisit", 3)])
    assert Counter(len(r["payload"]) for r in got if r["kind"] == "response") == Counter([200_000] * 4 + [200_001])


def test_empty_tables(spark, tmp_path):
    df, _ = corpus(spark, empty=True)
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    token_files.write_token_files(df, str(tmp_path / "t"))
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    outs = [
        jaccard_join.jaccard_components(df), sharding.shard(df), packing.pack_documents(df), line_dedup.without_shared_lines(df), decontaminate.decontaminate(df, items), token_files.token_checksums(spark, str(tmp_path / "t")),
        quality_rules.quality_rules(df, labels), substring_dedup.substring_dedup(df), quality_crf.score_quality(df, quality_crf.fit_quality(df, labels)),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
