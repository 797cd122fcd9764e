"""Operators against brute force where a shortcut would lose rows."""

import bisect
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline import registry
from wayline.functions.sun import epoch_seconds
from wayline.operators import matching, sequences, spacetime
from wayline.plans import sequence_queries
from wayline.sources.fixtures import Views

from conftest import SMALL


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_short_place_names_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8)))
    tags, names = sorted({"lujan", "ab", *(word() for _ in range(60))}), sorted({"lijen", "cd", *(word() for _ in range(60))})
    want = {}
    for t in tags:
        d, n = min((edits(t, n), n) for n in names)
        if d <= 2:
            want[t] = (n, "B" if d else "A", d)
    make = lambda w, c: spark.createDataFrame([(x, ["p"]) for x in w], f"{c} string, provinces array<string>")
    got = matching.match_place_names(make(tags, "tag"), make(names, "name")).collect()
    assert {r["tag"]: (r["official"], r["category"], r["distance"]) for r in got} == want and "lujan" in want


def test_repeated_passages_compares_all_users(spark):
    users = duckdb.sql(f"SELECT user_id, list(value ORDER BY ts, value) FROM '{SMALL}/events.parquet' GROUP BY 1 HAVING count(*) >= 8 ORDER BY 1").fetchall()
    want = []
    for i, (a, x) in enumerate(users):
        for b, y in users[i + 1 :]:
            long, short = (np.array(v, float) for v in ((x, y) if len(x) >= len(y) else (y, x)))
            scores = [np.corrcoef(long[k : k + len(short)], short)[0, 1] for k in range(len(long) - len(short) + 1)]
            want.append((-max(scores), a, b, int(np.argmax(scores))))
    got = registry.queries()["J19_repeated_passages"](spark, SMALL).collect()
    want = sorted(w for w in want if w[0] <= -0.3)[:20]
    assert [(r["id_a"], r["id_b"], r["offset"]) for r in got] == [w[1:] for w in want]
    assert [r["similarity"] for r in got] == pytest.approx([-w[0] for w in want])


def test_repeated_passages_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=40)
    rows = [(k, base[k : k + 10 + k % 9].tolist()) for k in range(20)] + [(20 + k, rng.normal(size=12).tolist()) for k in range(9)] + [(30, [1.0] * 12), (31, [1.0])]
    want = set()
    for i, x in rows:
        for j, y in rows:
            if i < j and min(len(x), len(y)) >= 8:
                k, s = matching.best_offset(np.array(x), np.array(y)) if len(x) >= len(y) else matching.best_offset(np.array(y), np.array(x))
                if s >= 0.5:
                    want.add((i, j, k, round(s, 9)))
    for block in (4, 512):
        monkeypatch.setattr(matching, "BLOCK", block)
        got = matching.repeated_passages(spark.createDataFrame(rows, "id long, values array<double>"), least=0.5, top=1000).collect()
        assert {(*r[:3], round(r[3], 9)) for r in got} == want and len(got) == len(want)


def test_repeated_passages_of_scaled_copies(spark, monkeypatch):
    """Copies at other volumes are all equally near, whatever the last digits: the pairs of the least ids are returned, also where scores come in many parts."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=33)
    rows = [(k, (base * rng.uniform(0.1, 9) + rng.normal()).tolist()) for k in range(60)] + [(100 + k, rng.normal(size=20 + k % 20).tolist()) for k in range(40)]
    monkeypatch.setattr(matching, "HELD", 640, raising=False)
    got = matching.repeated_passages(spark.createDataFrame(rows, "id long, values array<double>"), top=70).collect()
    assert [tuple(r) for r in got] == [(0, k, 0, 1.0) for k in range(1, 60)] + [(1, k, 0, 1.0) for k in range(2, 13)]


@pytest.mark.parametrize("untimed_only", [False, True])
def test_choose_track_against_all_pairs(spark, monkeypatch, untimed_only):
    monkeypatch.setattr(spacetime, "MANY_TRACKS", 1, raising=False)  # results once differed beyond it
    rng = random.Random(8)
    day = 86400.0
    spans = [(a, a + rng.choice([0.0, 10.0, 3000.0, 3 * day])) for a in (rng.randrange(0, 400) * day / 4 for _ in range(80))] + [(5000 * day, 5000 * day + 9), (-900 * day, -900 * day)]
    tracks = [] if untimed_only else [(k, a, a + rng.choice([0.0, 500.0, day, 9 * day])) for k, a in enumerate(rng.randrange(0, 100) * day for _ in range(14))]
    tracks += [(50, None, None), (49, None, 5.0)]

    def rank(m, t):
        (a, b), (k, c, d) = m, t
        if c is None or d is None:
            return (3, 0.0, 0.0, k)
        inside = min(b, d) - max(a, c)
        gap = max(c - b, a - d, 0.0)
        return (0, d - c, 0.0, k) if c <= a and b <= d else (1, -inside, 0.0, k) if inside > 0 else (2, gap, gap, k)

    want = {}
    for i, m in enumerate(spans):
        k, _, gap, t = min(rank(m, x) for x in tracks)
        want[i] = (t, ["contiene", "solapa", "cercano", "sin_rango"][k], gap)
    media = spark.createDataFrame([(i, *m) for i, m in enumerate(spans)], "id long, start_s double, end_s double")
    got = spacetime.choose_track(media, spark.createDataFrame(tracks, "track_id long, track_start double, track_end double")).collect()
    assert {r["id"]: (r["track_id"], r["mode"], r["gap_s"]) for r in got} == want and len(got) == len(spans)


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371000 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_nearest_photos_far_away_and_across_the_date_line(spark):
    rng = random.Random(9)
    photos = [(k, -34 + rng.random(), -58 + rng.random()) for k in range(30)] + [(40, 10.0, 179.99), (41, 10.0, -179.9), (42, 10.2, 179.9), (43, 88.0, 10.0), (44, 89.9, -170.0)]
    asked = [(0, -34.5, -57.5), (1, 40.0, 100.0), (2, 10.0, -179.99), (3, 89.9, 10.0), (4, -80.0, 60.0), (5, 0.0, 179.5)]
    want = {i: sorted((metres(a, b, c, d), k) for k, c, d in photos)[:3] for i, a, b in asked}
    got = spacetime.nearest_photos(spark.createDataFrame(asked, "kp_id long, lat double, lon double"), spark.createDataFrame(photos, "id long, lat double, lon double"), 3).collect()
    assert {(r["kp_id"], r["rank"]): r["photo_id"] for r in got} == {(i, n + 1): k for i, w in want.items() for n, (_, k) in enumerate(w)} and len(got) == 18


def test_photos_by_time_far_away(spark):
    year = 365 * 86400.0
    found = spark.createDataFrame([], "kp_id long, photo_id long")
    photos = spark.createDataFrame([(1, 0.0), (2, 40 * year), (3, 90 * year)], "id long, t_s double")
    got = spacetime.fill_by_time(spark.createDataFrame([(1, 100.0), (2, 60 * year)], "kp_id long, t_s double"), photos, found, 2).collect()
    assert sorted((r["kp_id"], r["photo_id"]) for r in got) == [(1, 1), (1, 2), (2, 2), (2, 3)]


def test_bursts_hash_whole_texts(spark):
    v = Views(spark, SMALL)
    whole = {r[0] for r in v.documents.select(F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")).collect()}
    rows = sequence_queries._bursts(v).collect()
    assert len(rows) == sequence_queries.images(v).count() and {r["hash"] for r in rows} <= whole and len({r["hash"] for r in rows}) > len(whole) / 2


def test_videos_are_placed_on_their_best_track(spark, monkeypatch):
    monkeypatch.setattr(sequence_queries.Q, "video_positions", lambda rows, *a: rows)
    v = Views(spark, SMALL)
    want = sequences.sample_media(v.media.where("type = 'video'"), v.track_points, spacetime.track_ranges(v.track_points), 30).where("source = 'track_interpolado'").collect()
    got = {(r["media_id"], r["offset_s"]): (r["lat"], r["lon"]) for r in registry.queries()["W8_video_positions"](spark, SMALL).collect()}
    assert want and all(got[r["media_id"], r["offset_s"]] == pytest.approx((r["lat"], r["lon"])) for r in want)


def positions_one_by_one(samples, end, gap_s, least_m, moving_kmh):
    """The rule for one video, said row by row: samples are (offset, lat, lon, seg_s) at offset seconds."""
    out, taken, candidates = [], None, []
    on = [s for s in samples if s[1] is not None]
    if not on:
        return []
    slow = [True] + [metres(*a[1:3], *b[1:3]) / (b[0] - a[0]) * 3.6 < moving_kmh for a, b in zip(on, on[1:])]
    in_gap = paused = False
    for s, is_slow in zip(on, slow):
        if s[3] is not None and s[3] > gap_s:
            if not in_gap:
                out.append((s[0], "gap"))
            in_gap = True
            continue
        in_gap = False
        if taken is None:
            take, paused = True, False
        elif is_slow:
            take, paused = not paused, True
        else:
            take, paused = metres(*taken[1:3], *s[1:3]) >= least_m, False
        if take:
            candidates.append(s)
            taken = s
    if end[1] is not None and end[3] is not None and end[3] > gap_s:
        out.append((end[0], "gap"))
    elif end[1] is not None and taken is not None and taken[0] < end[0]:
        candidates.append(end)
    kept = None
    for s in candidates:
        if kept is None or metres(*kept[1:3], *s[1:3]) >= least_m:
            out.append((s[0], "position"))
            kept = s
    return sorted(out)


def test_video_positions_against_the_rule(spark):
    rng, rows, want = random.Random(11), [], {}
    for video in range(60):
        lat, samples = -34.0, []
        for k in range(rng.randint(1, 25)):
            lat += rng.choice([0.0, 0.0, 1e-5, 3e-4, -3e-4])
            samples.append((k * 10.0, *((None, None, None) if rng.random() < 0.1 else (lat, -58.0, rng.choice([5.0, 5.0, 5.0, 900.0, None])))))
        last = samples[-1]
        end = (last[0] + rng.choice([0.0, 4.0]), *((None, None, None) if rng.random() < 0.1 else (lat, -58.0, rng.choice([5.0, 900.0]))))
        want[video] = positions_one_by_one(samples, end, 60, 20, 3)
        rows += [(video, o, 1000.0 + o, a, b, s, e) for e, part in ((False, samples), (True, [end])) for o, a, b, s in part]
    schema = "media_id long, offset_s double, t_s double, lat double, lon double, seg_s double, is_end boolean"
    got = {}
    for r in sequences.video_positions(spark.createDataFrame(rows, schema), 60, 20, 3).collect():
        got.setdefault(r["media_id"], []).append((r["offset_s"], r["kind"]))
    assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x}
    assert sequences.video_positions(spark.createDataFrame([], schema), 60, 20, 3).collect() == []


def test_times_by_rank_in_parts_of_a_folder(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", None]), f"2024-01-01 00:{rng.randrange(60):02d}:00" if rng.random() < 0.3 else None) for i in range(300)]
    media = spark.createDataFrame(rows, "id long, carpeta string, t string").select("id", "carpeta", F.to_timestamp("t").alias("timestamp_utc"))
    timed = {r["id"]: r["s"] for r in media.where("timestamp_utc IS NOT NULL").select("id", F.unix_timestamp("timestamp_utc").alias("s")).collect()}
    want = {}
    for folder in "ab":
        ids = [i for i, f, _ in rows if f == folder]
        at = [n for n, i in enumerate(ids) if i in timed]
        for p, q in zip(at, at[1:]):
            for n in range(p + 1, q):
                want[ids[n]] = timed[ids[p]] + (timed[ids[q]] - timed[ids[p]]) * (n - p) / (q - p)
    for bucket in (None, F.floor(F.col("id") / 7), F.lit(0)):
        got = {r["id"]: r["t_s"] for r in sequences.infer_timestamps_by_rank(media, bucket=bucket).collect()}
        assert got == pytest.approx(want) and len(want) > 50


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_work_on_small_groups_is_not_done_group_by_group(spark):
    """Videos share tasks; a medium's weather is one row from the join on."""
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["W8_video_positions"](spark, SMALL))
    assert "min_by" not in plan_of(registry.queries()["J10_attach_weather"](spark, SMALL))


def test_video_samples_are_made_and_moved_once(spark):
    """One row a video gets its track, and its samples are neither made again for gaps and ends nor joined back by number."""
    plan = plan_of(registry.queries()["W8_video_positions"](spark, SMALL))
    assert plan.count("Generate explode(sequence(0") == 1 and "Union" not in plan and plan.count("Join ") == 1


def test_video_positions_from_the_tables(spark):
    """The whole query, video by video: best track, samples every 30 s and the exact end, places between two points, the rule."""
    v = Views(spark, SMALL)
    seconds = lambda c: epoch_seconds(F.col(c)).alias("s")
    tracks = {}
    for k, s, *place in v.track_points.select("track_id", seconds("time"), "latitude", "longitude").collect():
        of_track = tracks.setdefault(k, {})
        of_track[s] = min(of_track.get(s, place), place)
    tracks = {k: sorted(x.items()) for k, x in tracks.items()}

    def rank(a, b, k):
        c, d = tracks[k][0][0], tracks[k][-1][0]
        inside = min(b, d) - max(a, c)
        return (0, d - c, k) if c <= a and b <= d else (1, -inside, k) if inside > 0 else (2, max(c - b, a - d, 0.0), k)

    def place(track, offset, t):
        n = bisect.bisect_left(track, t, key=lambda x: x[0])
        if n in (0, len(track)):
            return offset, None, None, None
        (s1, p1), (s2, p2) = track[n - 1 : n + 1]
        f = (t - s1) / (s2 - s1)
        return offset, p1[0] + (p2[0] - p1[0]) * f, p1[1] + (p2[1] - p1[1]) * f, s2 - s1

    videos = v.media.where("type = 'video' AND timestamp_utc IS NOT NULL").select("id", seconds("timestamp_utc"), "duration_secs").collect()
    for gap_s, least_m, kmh in ((40_000, 5, 0.05), (9_000, 900, 60)):
        want, got = {}, {}
        for i, a, length in videos:
            track = tracks[min(rank(a, a + length, k) for k in tracks)[-1]]
            samples = [place(track, float(o), a + o) for o in range(0, int(length) + 1, 30)]
            want[i] = positions_one_by_one(samples, place(track, a + length - a, a + length), gap_s, least_m, kmh)
        for r in sequences.video_positions(sequence_queries.video_samples(v), gap_s, least_m, kmh).collect():
            assert (r["kind"] == "gap") == (r["lat"] is None) == (r["lon"] is None)
            got.setdefault(r["media_id"], []).append((r["offset_s"], r["kind"]))
        assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x}
        assert len({kind for x in want.values() for _, kind in x}) == 2


def test_video_positions_over_many_batches(spark):
    """A video whose rows fill several batches, gaps first, an end at a sample's own time, and an end without samples."""
    n = 25_000
    still = [(1, k * 10.0, -34.0 + k // 5 * 1e-3, -58.0, 900.0 if k < 3 else 5.0) for k in range(n)]
    rows = [(m, o, o, a, b, s, False) for m, o, a, b, s in still] + [(1, (n - 1) * 10.0, (n - 1) * 10.0, -34.0, -58.0, 5.0, True), (2, 0.0, 0.0, -34.0, -58.0, 5.0, True), (2, 0.0, 0.0, None, None, None, False)]
    df = spark.createDataFrame(rows, "media_id long, offset_s double, t_s double, lat double, lon double, seg_s double, is_end boolean")
    got = sorted((r["media_id"], r["offset_s"], r["kind"]) for r in sequences.video_positions(df, 60, 20, 3).collect())
    samples = [(o, a, b, s) for _, o, a, b, s in still]
    assert got == [(1, *x) for x in positions_one_by_one(samples, ((n - 1) * 10.0, -34.0, -58.0, 5.0), 60, 20, 3)] and len(got) > n // 5
