"""Literal cases, and properties of operators that SQL can't express."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import catalog, loop, matching, route, sequences
from wayline.plans.interval import interval_join
from wayline.sources import readers, writers
from wayline.streaming.jobs import incremental_ingest, selection_bursts

ROUTE = [
    (1, -34.6037, -58.3816, 10.0, 0), (2, -34.6, -58.38, 25.0, 5), (3, -34.59, -58.37, 50.0, 10), (4, -34.58, -58.36, 30.0, 15), (5, -34.57, -58.35, 45.0, 20), (6, -34.56, -58.34, 20.0, 25),
    (7, -34.55, -58.33, 60.0, 30), (8, -34.54, -58.32, 80.0, 35), (9, -34.535, -58.315, 100.0, 40), (10, -34.53, -58.31, 90.0, 45), (11, -34.52, -58.3, None, 50),
]


def media(spark, rows):
    base = dt.datetime(2025, 8, 10, 10)
    return spark.createDataFrame([(i, a, b, h, base + dt.timedelta(minutes=m)) for i, a, b, h, m in rows], "id long, latitude double, longitude double, altitude double, timestamp_utc timestamp_ntz")


def test_golden_route(spark):
    got = {r["id"]: r for r in route.route_gradients(media(spark, ROUTE)).collect()}
    assert got[1]["distance_m"] is None and got[1]["gradient_pct"] is None and got[1]["cumul_m"] == 0
    assert got[2]["distance_m"] == pytest.approx(436.71, abs=0.01) and got[2]["gradient_pct"] == pytest.approx(3.4348, abs=0.01)
    assert got[11]["gain_m"] is None and got[11]["cumul_gain_m"] == 135 and got[11]["cumul_m"] == pytest.approx(11960.56, abs=0.02)


def test_route_over_many_days_equals_one_window(spark):
    rows = [(i, -34 + i / 100, -58 - i / 90, float(i % 7), i * 300) for i in range(60)]
    got = sorted(route.route_gradients(media(spark, rows)).collect())
    assert [r["id"] for r in got if r["distance_m"] is None] == [0]
    assert got[-1]["cumul_m"] == pytest.approx(sum(r["distance_m"] for r in got[1:]), abs=1)


def test_golden_loop(spark):
    assert [s[2] for s in loop.loop_segments([7, 16, 13, 18], 300)] == [9, 21, 5]
    got = {r["hour"]: (r["seg_i"], r["t_loop"]) for r in loop.position_in_loop(spark.createDataFrame([(8.0,), (22.0,), (3.0,)], "hour double"), [7, 16, 13, 18], 300).collect()}
    assert got[8.0][0] == 0 and got[8.0][1] == pytest.approx(100 / 9)
    assert got[22.0][0] == 1 and got[22.0][1] == pytest.approx(100 + 100 * 6 / 21) and got[3.0][1] == pytest.approx(100 + 100 * 11 / 21)
    assert loop.position_in_loop(spark.createDataFrame([(8.0,), (20.0,)], "hour double"), [10, 16], 300).count() == 0
    for bad in (([7], 300), ([7, 9], 0)):
        with pytest.raises(ValueError):
            loop.loop_segments(*bad)


def instants(spark, minutes):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "id long, ts timestamp_ntz")


def test_anchored_groups_by_doubling_equal_the_fold(spark):
    rng = np.random.default_rng(1)
    minutes = np.sort(rng.integers(0, 3000, 200)).tolist()
    rows = instants(spark, minutes)
    want, lead, first = {}, None, None
    for i, m in enumerate(minutes):
        if first is None or m - first > 30:
            lead, first = i, m
        want[i] = lead
    for limit in (100_000, 3):
        assert {r["id"]: r["group"] for r in sequences.anchored_time_groups(rows, 30, island_rows=limit).collect()} == want


def test_anchored_groups_count_instants_not_rows(spark, monkeypatch):
    """Rows at one instant are in one group, so an island of many copies of few instants is not a large one."""
    monkeypatch.setattr(sequences, "_doubled", None)
    minutes = sorted(k * 7 % 400 for k in range(40) for _ in range(20))
    want, lead, first = {}, None, None
    for i, m in enumerate(minutes):
        if first is None or m - first > 30:
            lead, first = i, m
        want[i] = lead
    got = sequences.anchored_time_groups(instants(spark, minutes), 30, island_rows=100).collect()
    assert {r["id"]: r["group"] for r in got} == want and len(got) == len(minutes)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_places_of_rows_against_all_boxes(spark, monkeypatch, broadcast):
    """Every row stays, once; of overlapping boxes the first by name; lower bounds are included."""
    from wayline.operators import spacetime

    monkeypatch.setattr(spacetime, "BROADCAST_ROWS", broadcast)
    boxes = [("b", "p", 0.0, 1.0, 0.0, 1.0), ("a", "q", 0.5, 1.5, 0.5, 0.95), ("a", "p", 0.9, 2.0, 0.9, 2.0), (None, "z", 3.0, 3.01, 3.0, 3.01)]
    at = [(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.92, 0.93), (0.92, 0.95), (3.0, 3.0), (3.0, 3.01), (9.0, 9.0), (None, 0.1), (0.1, None), (0.1, 0.1), (0.1, 0.1)]
    holding = lambda y, x: [(m or "", p) for m, p, a, b, c, d in boxes if None not in (y, x) and a <= y < b and c <= x < d]
    want = {i: min(holding(*c), default=("none", None)) for i, c in enumerate(at)}
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(at)], "id long, lat double, lon double")
    got = spacetime.with_places(rows, spark.createDataFrame(boxes, "municipio string, provincia string, lat_min double, lat_max double, lon_min double, lon_max double"), "lat", "lon").collect()
    assert {r["id"]: (r["municipio"] or "", r["provincia"]) if r["_placed"] else ("none", None) for r in got} == want and len(got) == len(at)


def test_greedy_groups_respect_the_threshold(spark):
    rows = spark.createDataFrame([(1, k, k, h) for k, h in enumerate([0, 1, 3, 255, 254, None])], "group long, ord long, id long, item long")
    got = {r["id"]: r["lead"] for r in sequences.greedy_similarity_groups(rows, "hamming", 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_interval_join_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    spans = [(k, float(a), float(a + b)) for k, (a, b) in enumerate(zip(rng.integers(0, 10**6, 60), rng.choice([1, 50, 5000, 400_000], 60), strict=True))]
    points = [(k, float(t)) for k, t in enumerate(rng.integers(0, 1_400_000, 200))]
    got = interval_join(spark.createDataFrame(points, "p long, t double"), spark.createDataFrame(spans, "i long, a double, b double"), "t", "a", "b", 100)
    assert sorted((r["p"], r["i"]) for r in got.select("p", "i").collect()) == sorted((p, i) for p, t in points for i, a, b in spans if a < t <= b)


def test_best_offset():
    long = np.sin(np.arange(60) / 3)
    assert matching.best_offset(long, long[17:37] * 2 + 5) == (17, pytest.approx(1.0))


def test_safe_where(spark):
    df = spark.range(5).withColumn("x", F.lit("a;b"))
    assert catalog.safe_where(df, "id > 2 AND x = 'a;b'").count() == 2
    for bad in ("1 = 1; DROP TABLE x", "id > 1 UNION SELECT 1", "id > 1 -- x"):
        with pytest.raises(ValueError):
            catalog.safe_where(df, bad)


def test_skip_twice_is_skip_once(spark):
    a, b = spark.range(5).withColumn("v", F.lit("a")), spark.range(3, 8).withColumn("v", F.lit("b"))
    once = writers.merge_by_mode(a, b, ["id"], "skip")
    assert sorted(writers.merge_by_mode(once, b, ["id"], "skip").collect()) == sorted(once.collect()) and once.count() == 8


def test_reroot_at_separators_only(spark):
    got = spark.createDataFrame([("C:/A",), ("C:/A/x",), ("C:/A2/x",)], "p string").select(writers.reroot_paths(F.col("p"), "C:/A", "/n")).collect()
    assert [r[0] for r in got] == ["/n", "/n/x", "C:/A2/x"]


def test_text_sections(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nautor: Ana\ntags: viaje, ruta\n---\n## Uno\nfecha: 2024-01-02\nlugar: -34.5, -58.25\ntags: Ruta, lluvia\n\nHola\nmundo\n## Dos\nfin")
    one, two = sorted(readers.read_text_collections(spark, str(tmp_path)).collect(), key=lambda r: r["section"])
    assert (one["title"], one["date"], one["latitude"], one["longitude"], one["tags"], one["body"], one["author"]) == ("Uno", "2024-01-02", -34.5, -58.25, ["viaje", "ruta", "lluvia"], "Hola\nmundo", "Ana")
    assert (two["title"], two["body"], two["place"]) == ("Dos", "fin", None)


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(milliseconds=m), u, v) for m, u, v in [(0, 1, "a"), (300, 1, "b"), (600, 1, "a"), (5000, 1, "c"), (100, 2, "z"), (900_000, 9, "end")]]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long, value string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = selection_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    shown = lambda d: sorted((r["user_id"], r["n"], tuple(r["values"])) for r in d.collect())
    assert shown(spark.table("bursts")) == [x for x in shown(selection_bursts(df)) if x[0] != 9]


def test_ingestion_skips_what_it_has(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    make = lambda ids, hashes: spark.createDataFrame([(base, i, h) for i, h in zip(ids, hashes, strict=True)], "ts timestamp, id long, file_hash string")
    make([1, 2, 3], ["a", "b", "a"]).write.parquet(str(tmp_path / "in"))
    for extra in (None, ([4, 5], ["b", "c"])):
        if extra:
            make(*extra).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, id long, file_hash string").parquet(str(tmp_path / "in"))
        incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["file_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
