"""Groups of similar items against the sequential rule."""

import math
import random

import pytest

from wayline.operators import similarity
from wayline.operators.similarity import METRICS, first_leaders, greedy_similarity_groups
from pyspark.sql import functions as F


def by_rule(rows, near):
    lead = {}
    for group in {r[0] for r in rows}:
        heads = []
        for _, _, i, x in sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2])):
            hit = next((h for h, y in heads if x is not None and y is not None and near(y, x)), None)
            lead[i] = i if hit is None else hit
            if hit is None:
                heads.append((i, x))
    return lead


def cosine(a, b):
    n = math.hypot(*a) * math.hypot(*b)
    return n > 0 and sum(p * q for p, q in zip(a, b, strict=True)) / n


def items_of(metric, rng, n):
    if metric == "hamming":
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(n // 6)]
        return [None if rng.random() < 0.05 else rng.choice(base) ^ sum(1 << k for k in rng.sample(range(63), rng.choice([0, 1, 2, 4]))) for _ in range(n)]
    if metric == "tags":
        return [None if rng.random() < 0.05 else [f"t{int(rng.random() ** 2 * 25)}" for _ in range(rng.randint(0, 6))] for _ in range(n)]
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(n // 6)]
    return [None if rng.random() < 0.05 else [0.0] * 5 if rng.random() < 0.03 else [v + rng.gauss(0, 0.25) for v in rng.choice(base)] for _ in range(n)]


NEAR = {"hamming": (5, "long", lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 5), "tags": (2, "array<string>", lambda a, b: len(set(a) & set(b)) >= 2), "cosine": (0.9, "array<double>", lambda a, b: cosine(a, b) >= 0.9)}


@pytest.mark.parametrize("metric", sorted(METRICS))
@pytest.mark.parametrize("last_pairs", [200_000, 0])
def test_groups(spark, metric, last_pairs):
    """Several groups, ties of the order, equal items, missing and empty ones; decided in one task and by rounds alone."""
    rng = random.Random(len(metric))
    threshold, kind, near = NEAR[metric]
    items = items_of(metric, rng, 240)
    items[50:60] = [items[49]] * 10
    rows = [(k % 3, rng.randint(0, 60), k, x) for k, x in enumerate(items)]
    df = spark.createDataFrame(rows, f"group int, ord int, id long, item {kind}").repartition(4)
    got = greedy_similarity_groups(df, metric, threshold, last_pairs).collect()
    assert len(got) == len(rows) and {r["id"]: r["lead"] for r in got} == by_rule(rows, near)
    assert greedy_similarity_groups(df.limit(0), metric, threshold).collect() == []


def test_a_chain(spark):
    """Each item near the next one only: every other one leads, however long the chain."""
    pairs = spark.range(1, 41).select(F.struct(F.col("id").alias("ord"), "id").alias("a"), F.struct((F.col("id") + 1).alias("ord"), (F.col("id") + 1).alias("id")).alias("b"))
    for last in (200_000, 10):
        assert sorted((r["b"]["id"], r["lead"]["id"]) for r in first_leaders(pairs, last).collect()) == [(k, k - 1) for k in range(2, 42, 2)]


def test_one_large_group(spark):
    """A hundred thousand hashes in one group, a third of them equal, stay a matter of joins on parts: the pairs that meet are few."""
    rows = spark.range(100_000).select(F.lit(0).alias("group"), F.col("id").alias("ord"), "id", F.when(F.col("id") % 3 == 0, F.lit(77).cast("long")).otherwise(F.xxhash64((F.col("id") / 2).cast("long"))).alias("item"))
    out = greedy_similarity_groups(rows, "hamming", 5)
    assert out.count() == 100_000 and out.where("lead = 0").count() == 33_334


@pytest.mark.parametrize("metric", ["cosine", "hamming"])
@pytest.mark.parametrize("row_cost", [0, 200])
def test_groups_in_rounds(spark, monkeypatch, metric, row_cost):
    """A few items a round, the others in small parts; pairs for the rest where they cost nothing."""
    for name, n in {"FIRST": 7, "MOST": 11, "PART": 13, "ROW_COST": row_cost}.items():
        monkeypatch.setattr(similarity, name, n, raising=False)
    rng = random.Random(5)
    threshold, kind, near = NEAR[metric]
    rows = [(k % 2, rng.randint(0, 60), k, x) for k, x in enumerate(items_of(metric, rng, 160))]
    got = greedy_similarity_groups(spark.createDataFrame(rows, f"group int, ord int, id long, item {kind}"), metric, threshold).collect()
    assert len(got) == len(rows) and {r["id"]: r["lead"] for r in got} == by_rule(rows, near)


def test_where_most_are_near(spark, monkeypatch):
    """Thousands of hashes of which each is near a twelfth of all others: no pairs are written."""
    monkeypatch.setattr(similarity, "hamming_pairs", None)
    monkeypatch.setitem(METRICS, "hamming", (None, *METRICS["hamming"][1:]))
    rng = random.Random(3)
    rows = [(0, k, k, rng.getrandbits(60)) for k in range(3000)]
    got = greedy_similarity_groups(spark.createDataFrame(rows, "group int, ord int, id long, item long"), "hamming", 24).collect()
    assert {r["id"]: r["lead"] for r in got} == by_rule(rows, lambda a, b: (a ^ b).bit_count() <= 24)
