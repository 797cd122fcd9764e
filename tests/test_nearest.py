"""Nearest neighbours in place and in time against comparing all."""

import math
import random

from pyspark.sql import functions as F

from wayline.operators.spacetime import fill_by_time
from wayline.plans import knn


def metres(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, x)))


def check(spark, left, right, k):
    kinds = "l long, lat double, lon double", "r long, lat double, lon double"
    got = knn.nearest(spark.createDataFrame(left, kinds[0]), spark.createDataFrame(right, kinds[1]), k, "l", "r").collect()
    by = {}
    for row in got:
        by.setdefault(row["l"], []).append((row["rank"], round(row["metres"], 3), row["r"]))
    for i, a, b in left:
        want = sorted((round(metres(a, b, c, d), 3), j) for j, c, d in right)[:k]
        have = [(m, j) for _, m, j in sorted(by.get(i, []))]
        assert len(have) == len(want) and all(abs(x[0] - y[0]) < 0.01 for x, y in zip(have, want, strict=True))
        assert [j for _, j in have] == [j for _, j in want] or len({m for m, _ in want}) < len(want) or any(abs(x - y) < 0.01 for (x, _), (y, _) in zip(want, want[1:], strict=False))


def test_all_over_the_globe(spark):
    """Both poles, the meridian of 180 degrees, dense towns beside empty land, the same place many times, longitudes beyond 180."""
    rng = random.Random(1)
    right = [(k, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for k in range(150)]
    right += [(200 + k, 10 + rng.gauss(0, 0.001), 20 + rng.gauss(0, 0.001)) for k in range(100)]
    right += [(400 + k, 89.9 + rng.uniform(-0.2, 0.1), rng.uniform(-180, 180)) for k in range(40)] + [(500 + k, -12.0, 179.99) for k in range(20)] + [(600, 0.0, 181.0), (601, -90.0, 5.0)]
    left = [(k, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for k in range(60)]
    left += [(100, 90.0, 0.0), (101, -90.0, 77.0), (102, 89.95, 10.0), (103, -12.0, -179.99), (104, 10.0, 20.0), (105, 10.5, 20.0), (106, 0.0, -179.0), (107, 60.0, 179.9), (108, -12.0, 179.99), (109, 85.0, -120.0)]
    for k in (1, 3, 25):
        check(spark, left, right, k)


def test_fewer_than_wanted(spark):
    check(spark, [(1, 0.0, 0.0), (2, 80.0, 100.0)], [(7, -80.0, -80.0), (8, 1.0, 1.0)], 5)
    none = knn.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "l long, lat double, lon double"), spark.createDataFrame([], "r long, lat double, lon double"), 2, "l", "r")
    assert none.collect() == []


def test_nearest_in_time(spark):
    """Ties, photos at one instant, instants before and after all, some already found, fewer photos than wanted."""
    rng = random.Random(2)
    photos = [(k, float(rng.randint(0, 40))) for k in range(30)] + [(100 + k, 20.0) for k in range(12)]
    keypoints = [(k, float(t)) for k, t in enumerate([-50, 0, 7, 19, 20, 21, 40, 90, 20])] + [(50, None)]
    found = [(4, 100), (4, 101), (8, 105), (2, 3)]
    a, b, c = spark.createDataFrame(keypoints, "kp_id long, t_s double"), spark.createDataFrame(photos, "id long, t_s double"), spark.createDataFrame(found, "kp_id long, photo_id long")
    for k in (1, 2, 6, 60):
        got = {}
        for r in fill_by_time(a, b, c, k).collect():
            got.setdefault(r["kp_id"], []).append((r["delta_s"], r["photo_id"]))
        for kp, t in keypoints:
            have = [p for q, p in found if q == kp]
            want = sorted((abs(s - t), p) for p, s in photos if p not in have)[: max(0, k - len(have))] if t is not None else []
            assert sorted(got.get(kp, [])) == want


def test_no_comparison_with_all(spark):
    """The plan has no product and no loop join."""
    rows = spark.range(2000).select("id", (F.col("id") % 90).cast("double").alias("lat"), (F.col("id") % 170).cast("double").alias("lon"))
    plan = knn.nearest(rows.withColumnRenamed("id", "l"), rows.withColumnRenamed("id", "r"), 2, "l", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
