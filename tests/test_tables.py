"""Stored tables: merging, deleting and undoing touch only the partitions that change; listing of files."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from wayline.sources import readers, tables, writers

KIND = "id long, v string, part string"


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def held(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "v", "part").collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, "old", "abcd"[k % 4]) for k in range(40)] + [(100, "old", None), (101, "lone", "e")]
    tables.write_table(spark.createDataFrame(rows, KIND), path, "part")
    return path, rows


@pytest.mark.parametrize("mode", ["skip", "update", "replace"])
def test_merge(spark, stored, mode):
    """Keys that stay, that move to another partition and that are new; a derived slice; an emptied partition; a null one."""
    path, rows = stored
    source = [(4, "new", "a"), (8, "new", "b"), (200, "new", "z"), (200, "new", "z"), (101, "new", "b")]
    before = files(path)
    derived = (F.col("part") == "c") & (F.col("id") < 10)
    changed = tables.merge_table(spark, path, spark.createDataFrame(source, KIND), ["id"], mode, "part", derived)
    new, old = {r[0]: r for r in source}, {r[0]: r for r in rows}
    if mode == "skip":
        want = list((new | old).values())
    else:
        want = list(({i: r for i, r in old.items() if not (mode == "replace" and r[2] == "c" and i < 10)} | new).values())
    assert held(spark, path) == sorted(want, key=str)
    assert set(changed) == {"skip": {"z"}, "update": {"a", "b", "e", "z"}, "replace": {"a", "b", "c", "e", "z"}}[mode]
    after = files(path)
    same = {p for p in before if not any(f"part={c}" in p for c in changed)} if mode != "skip" else set(before)
    assert all(after.get(p) == before[p] for p in same) and any("part=d" in p for p in same) and any("HIVE" in p for p in same)
    if mode != "skip":
        assert not any("part=e" in p for p in after)


def test_delete_and_unlink(spark, stored):
    path, rows = stored
    before = files(path)
    gone = spark.createDataFrame([(4,), (101,), (100,), (999,)], "id long")
    assert set(tables.delete_rows(spark, path, "part", gone, ["id"])) == {"a", "e", None}
    assert held(spark, path) == sorted((r for r in rows if r[0] not in (4, 100, 101)), key=str)
    assert all(files(path).get(p) == before[p] for p in before if "part=b" in p or "part=c" in p)
    assert tables.delete_rows(spark, path, "part", F.col("id") == 12345) == []
    assert tables.set_null(spark, path, "part", "v", spark.createDataFrame([("old",)], "x string"), "x") and {r[1] for r in held(spark, path)} == {None}


def test_undo_of_a_batch(spark, tmp_path):
    media = spark.createDataFrame([(1, "image", 3), (2, "image", 4), (3, "video", 3), (4, "text", None)], "id long, type string, ingest_batch_id long")
    child = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l"), (None, "l")], "media_id long, key string")
    preview, left = writers.undo_batch(media, {"metadata": child}, 3, {"attachments": child})
    assert {r["what"]: r["n"] for r in preview.collect()} == {"media": 2, "metadata": 2, "attachments": 2}
    assert sorted(r["id"] for r in left["media"].collect()) == [2, 4]
    assert sorted(map(tuple, left["metadata"].collect()), key=str) == [(2, "k"), (None, "l")]
    assert sorted(map(tuple, left["attachments"].collect()), key=str) == [(2, "k"), (None, "k"), (None, "l"), (None, "l")]
    at = {"media": (str(tmp_path / "m"), "type"), "metadata": (str(tmp_path / "c"), "key"), "attachments": (str(tmp_path / "a"), "key")}
    for name, df in (("media", media), ("metadata", child), ("attachments", child)):
        tables.write_table(df, *at[name])
    tables.undo_stored_batch(spark, at, 3)
    for name in at:
        columns = left[name].columns
        assert sorted(map(tuple, spark.read.parquet(at[name][0]).select(columns).collect()), key=str) == sorted(map(tuple, left[name].collect()), key=str)


def test_undo_of_a_track(spark):
    """Each of the reset's rules at the ends of the range, within and outside."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    media = [(1, at(5), "track_gps"), (2, at(5), "track_interpolado"), (3, at(4), "track_gps"), (4, at(8), "track_interpolado"), (5, at(9), "track_interpolado"), (6, at(6), "metadata"), (7, None, "track_gps")]
    df = spark.createDataFrame([(i, t, 1.0, 2.0, 3.0, s) for i, t, s in media], "id long, timestamp_utc timestamp_ntz, latitude double, longitude double, altitude double, geolocation_source string")
    keypoints = [(1, "ubicacion_video", "x"), (6, "ubicacion_video", "x"), (5, "ubicacion_video", "x"), (2, "contexto_clima", "track_interpolado"), (2, "contexto_clima", "gps_propio"), (5, "contexto_clima", "track_interpolado"), (2, "contextoXclima", "track_interpolado"), (6, "voz", None)]
    metadata = [(1, "ubicacion_video_estado"), (6, "ubicacion_video_gaps"), (5, "ubicacion_video_gaps"), (1, "otra")]
    given = {
        "media": df, "keypoints": spark.createDataFrame(keypoints, "media_id long, key string, source string"), "metadata": spark.createDataFrame(metadata, "media_id long, key string"),
        "tracks": spark.createDataFrame([(9, at(4), at(8)), (8, None, None)], "track_id long, start_time timestamp_ntz, end_time timestamp_ntz"), "waypoints": spark.createDataFrame([(9,), (9,), (8,)], "track_id long"),
    }
    preview, left = writers.undo_track(given, 9)
    assert {r["what"]: r["n"] for r in preview.collect()} == {"waypoints": 2, "track_gps": 2, "track_interpolado": 2, "ubicacion_video": 3}
    got = {r["id"]: (r["latitude"], r["altitude"], r["geolocation_source"]) for r in left["media"].collect()}
    assert got == {1: (1.0, None, None), 2: (None, None, None), 3: (1.0, None, None), 4: (None, None, None), 5: (1.0, 3.0, "track_interpolado"), 6: (1.0, 3.0, "metadata"), 7: (1.0, 3.0, "track_gps")}
    assert sorted(map(tuple, left["keypoints"].collect()), key=str) == sorted([keypoints[k] for k in (2, 4, 5, 6, 7)], key=str)
    assert sorted(map(tuple, left["metadata"].collect())) == [(1, "otra"), (5, "ubicacion_video_gaps")]
    assert [r[0] for r in left["waypoints"].collect()] == [8] and [r[0] for r in left["tracks"].collect()] == [8]
    kept = writers.undo_track(given, 8)[1]
    assert kept["media"].collect() == df.collect() and kept["keypoints"].count() == len(keypoints)
    heights = {r["id"]: r["altitude"] for r in writers.undo_track(given, 8, heights_without_range=True)[1]["media"].collect()}
    assert {i for i, h in heights.items() if h is None} == {1, 3, 7}


def test_inventory_of_files(spark, tmp_path):
    for name, content in (("a/b/x.JPG", b"one"), ("a/y.mp4", b"two"), ("a/y.mp4.xmp", b"side"), ("a/._z.jpg", b"side"), ("c.unknown", b"no"), ("n.md", b"text")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    full = {r["path"].rsplit("/", 1)[1]: (r["type"], r["length"], r["fingerprint"]) for r in readers.file_inventory(spark, str(tmp_path), full_hash=True).collect()}
    import hashlib

    assert full == {n: (t, len(c), hashlib.sha256(c).hexdigest()) for n, t, c in (("x.JPG", "image", b"one"), ("y.mp4", "video", b"two"), ("n.md", "text", b"text"))}
    quick = readers.file_inventory(spark, str(tmp_path))
    assert all(r["fingerprint"].startswith(f"{r['length']}-") for r in quick.collect())
