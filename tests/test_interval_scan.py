"""Interval joins by the segment tree, and ordered scans over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators.sequences import infer_timestamps_by_rank
from wayline.operators.spacetime import choose_track
from wayline.plans import interval, scan


def spans(rng, n):
    out = []
    for k in range(n):
        a = rng.uniform(-50_000, 50_000)
        out.append((k, a, a + rng.choice([0, 1, 30, 5000, 1e5, -5]), k % 3))
    return out


@pytest.mark.parametrize("broadcast, hot", [(100_000, 20_000), (0, 20_000), (0, 10)])
@pytest.mark.parametrize("open_start", [True, False])
def test_interval_join(spark, monkeypatch, broadcast, hot, open_start):
    monkeypatch.setattr(interval, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(interval, "HOT_POINTS", hot)
    rng = random.Random(1)
    ivs = [*spans(rng, 60), (60, -1e7, 1e7, 0), (61, None, 3.0, 1), (62, 100.0, 100.0, 2)]
    pts = [(k, rng.choice([rng.uniform(-60_000, 60_000), ivs[k % 60][1], ivs[k % 60][2]]), k % 3) for k in range(300)] + [(300, None, 0), (301, 100.0, 2)]
    points, intervals = spark.createDataFrame(pts, "p long, t double, k int"), spark.createDataFrame(ivs, "i long, a double, b double, k int")
    inside = lambda t, a, b: t is not None and a is not None and (a < t if open_start else a <= t) and t <= b
    for keys in ([], ["k"]):
        right = intervals if keys else intervals.drop("k")
        got = sorted((r["p"], r["i"]) for r in interval.interval_join(points, right, "t", "a", "b", 60, keys, open_start).collect())
        assert got == sorted((p, i) for p, t, k in pts for i, a, b, j in ivs if inside(t, a, b) and (not keys or k == j))


def test_cover_is_small_and_exact(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(-1000, 1000)) for k in range(300)]
    rows = [(k, a, a + rng.choice([0, 1, 7, 500, 100_000])) for k, a in rows]
    for _, a, b, nodes in spark.createDataFrame(rows, "k long, a long, b long").withColumn("c", interval.cover_nodes("a", "b")).collect():
        cells = sorted(x for n in nodes for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert cells == list(range(a, b + 1)) and len(nodes) <= 2 * (b - a + 1).bit_length()


def test_no_part_holds_many_points(spark, monkeypatch):
    """An interval over all of time and one over a third of the points: the parts that points are dealt to hold under one in 40 of all lookups each."""
    monkeypatch.setattr(interval, "HOT_POINTS", 50)
    points = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("t"))
    levels = [0, 6, 14]
    hot = interval.hot_nodes(points, "t", 1.0, levels, [])
    asked = interval.asked_for(points, "t", 1.0, levels).join(F.broadcast(hot), ["_level", "_node"], "left").withColumn("part", F.pmod(F.xxhash64("id", "t"), F.coalesce("_parts", F.lit(1))))
    most = asked.groupBy("_level", "_node", "part").count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] < most[1] / 40 and hot.count() <= interval.HOT_SHARE * len(levels)


def test_touching(spark):
    rng = random.Random(3)
    a, b = spans(rng, 50), spans(rng, 40)
    left = spark.createDataFrame([x[:3] for x in a], "i long, a double, b double")
    right = spark.createDataFrame([x[:3] for x in b] + [(99, a[0][2], a[0][2])], "j long, c double, d double")
    got = sorted((r["i"], r["j"]) for r in interval.touching(left, right, ("a", "b"), ("c", "d"), 60).collect())
    b = [*b, (99, a[0][2], a[0][2], 0)]
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] <= x[2] and y[1] <= y[2] and max(x[1], y[1]) <= min(x[2], y[2]))


def test_choose_track_by_rule(spark):
    """Media and tracks on few distinct instants, so that ends meet often; tracks without times; media apart from all."""
    rng = random.Random(4)
    tracks = [(k, a := float(rng.randint(0, 30)), a + rng.randint(0, 8)) for k in range(12)] + [(50, None, None), (51, 3.0, None)]
    media = [(k, a := float(rng.randint(-10, 60)), a + rng.choice([0, 0, 1, 5])) for k in range(80)] + [(80, None, None)]

    def best(a, b):
        ranked = []
        for i, c, d in tracks:
            if c is None or d is None:
                ranked.append((3, 0, i, "sin_rango", 0.0))
            elif c <= a and b <= d:
                ranked.append((0, d - c, i, "contiene", 0.0))
            elif (over := min(b, d) - max(a, c)) > 0:
                ranked.append((1, -over, i, "solapa", 0.0))
            else:
                gap = max(c - b, a - d, 0.0)
                ranked.append((2, gap, i, "cercano", gap))
        return min(ranked)[2:]

    kinds = "id long, start_s double, end_s double", "track_id long, track_start double, track_end double"
    got = choose_track(spark.createDataFrame(media, kinds[0]), spark.createDataFrame(tracks, kinds[1])).collect()
    want = {k: best(a, b) if a is not None else (None, None, None) for k, a, b in media}
    assert {r["id"]: (r["track_id"], r["mode"], r["gap_s"]) for r in got} == want
    alone = choose_track(spark.createDataFrame(media, kinds[0]), spark.createDataFrame(tracks[12:], kinds[1])).collect()
    assert {r["mode"] for r in alone if r["start_s"] is not None} == {"sin_rango"} and {r["track_id"] for r in alone if r["start_s"] is not None} == {50}


def test_ranges_of_any_key(spark):
    """Rows of one day, and of one path, are dealt over all ranges, in order; nulls come first."""
    rows = [(None if k % 50 == 0 else f"p{k % 7}", k, None if k % 4 else float(k)) for k in range(4000)]
    df = spark.createDataFrame(rows, "path string, id long, v double").repartition(3)
    bucket = scan.ordered_bucket(df, ["path", "id"], 8)
    by = {}
    for path, number, b in df.select("path", "id", bucket.alias("b")).collect():
        by.setdefault(b, []).append((path is not None, path or "", number))
    assert len(by) == 8 and max(map(len, by.values())) < 4000 / 8 * 2
    ends = [(min(by[b]), max(by[b])) for b in sorted(by)]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    last, want, total = None, {}, 0.0
    for _, number, v in order:
        total += v or 0.0
        want[number] = (last, total)
        last = v if v is not None else last
    got = scan.running_sums(scan.last_known(df, bucket, ["path", "id"], "before", F.col("v")), bucket, ["path", "id"], {"total": F.col("v")})
    assert {r["id"]: (r["before"], r["total"]) for r in got.collect()} == want
    assert scan.ordered_bucket(df.limit(0), ["path"], 8)._jc.toString() == "0"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_place_in_against_all_pairs(spark, monkeypatch, broadcast):
    """Each point once, with the interval that holds it or none; also with a dense stretch, a wide gap, points at the very ends and an instant that most points share."""
    monkeypatch.setattr(interval, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(interval, "HOT_POINTS", 5)
    rng = random.Random(19)
    ends = {k: sorted({rng.uniform(0, 10) for _ in range(60)} | {rng.uniform(1e6, 1e6 + 9000) for _ in range(40)} | {-5.0, 2e6 * k}) for k in (1, 2)}
    intervals = [(k, a, b, f"{k}/{n}") for k, e in ends.items() for n, (a, b) in enumerate(zip(e, e[1:], strict=False)) if n % 9]
    times = [t for e in ends.values() for t in e] + [rng.uniform(-10, 12) for _ in range(200)] + [rng.uniform(0, 3e6) for _ in range(50)] + [7.5] * 400 + [None]
    points = [(i, rng.choice([1, 2, 3, None]), t) for i, t in enumerate(times)]
    want = {i: next((x for c, a, b, x in intervals if c == k and t is not None and a < t <= b), None) for i, k, t in points}
    got = interval.place_in(spark.createDataFrame(points, "id long, k long, t double"), spark.createDataFrame(intervals, "k long, a double, b double, x string"), "t", "a", "b", ["k"]).collect()
    assert len(got) == len(points) and {r["id"]: r["x"] for r in got} == want


def test_a_range_is_looked_up_once_a_row(spark):
    """The group of splitters and the splitter within it: two searches, for a key that is made once and not for each splitter."""
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("path"))
    plan = df.select("id", scan.ordered_bucket(df, ["path", "id"], 64).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 2 and plan.count("struct(path, path#") == 1


@pytest.mark.parametrize("order", ["id", "path"])
def test_times_by_rank(spark, order):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), f"{rng.randint(0, 60):03d}", rng.choice([None, None, 1000 * k])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, carpeta string, path string, s long").withColumn("timestamp_utc", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want = {}
    for folder in "ab":
        own = sorted((r for r in rows if r[1] == folder), key=lambda r: (r[2], r[0]) if order == "path" else r[0])
        known = [n for n, r in enumerate(own) if r[3] is not None]
        for n, r in enumerate(own):
            before, after = [x for x in known if x < n], [x for x in known if x > n]
            if r[3] is None and before and after:
                p, q = before[-1], after[0]
                want[r[0]] = round(own[p][3] + (own[q][3] - own[p][3]) * (n - p) / (q - p), 3)
    assert {r["id"]: round(r["t_s"], 3) for r in infer_timestamps_by_rank(df, order).collect()} == want
