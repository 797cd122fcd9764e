"""Streams over replayed files against the same tables at once."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.streaming.bursts import BurstProcessor, bursts_of, selection_stream
from wayline.streaming.jobs import incremental_ingest, known_fingerprints

KIND = "ts timestamp, user_id long, grp string, value string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def plain(rows):
    return sorted((r["user_id"], r["start"], r["end"], r["n"], r["hours"], sorted((r["chosen"] or {}).items())) for r in rows)


def test_bursts_with_state(spark, tmp_path, rocks):
    """Messages out of order, at the very gap, no hours, nulls, bursts over two deliveries; late ones are dropped and counted."""
    rows = lambda messages: spark.createDataFrame([(START + dt.timedelta(seconds=s), u, g, v) for s, u, g, v in messages], KIND)
    first = [(0.6, 1, "tags", "b"), (0.0, 1, "horas", "7"), (0.3, 1, "horas", "x"), (1.3, 1, "tags", "a"), (1.9, 1, "horas", "24"), (5.0, 1, "tags", None), (0.0, 2, "tags", "q"), (0.2, 2, "clima", "q")]
    second = [(0.4, 2, "tags", "p"), (5.5, 1, "horas", "3"), (5.6, 1, "horas", "03"), (5.7, 1, "tags", "a"), (5.8, 1, "tags", "a"), (100.0, 1, "tags", "z")]
    late, last = [(2.0, 1, "tags", "late"), (2.1, 3, "tags", "late")], [(500.0, 9, "end", None)]
    dropped = 0
    for delivery in (first, second, [(101.0, 9, "tags", "k")], late, last):
        rows(delivery).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        run = selection_stream(stream).writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
        run = run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
    got = plain(spark.read.parquet(str(tmp_path / "out")).where("user_id < 9").collect())
    want = plain(bursts_of(rows([*first, *second])).collect())
    assert dropped == 2 and got == want
    assert [(r[3], r[4], r[5]) for r in want if r[0] == 1][:2] == [(3, [7], [("tags", ["b"])]), (2, [], [("tags", ["a"])])]


def test_fingerprints_in_folders(spark, tmp_path):
    """Hashes that come again in the same delivery, in a later one and long after; a batch looks into its own folders only."""
    target = str(tmp_path / "out")
    deliveries = [[(0, 1, "aa1"), (1, 2, "bb1"), (2, 3, "aa1")], [(10, 4, "aa1"), (11, 5, "cc1")], [(9_000_000, 6, "bb1"), (9_000_001, 7, "cc2"), (9_000_002, 8, None)]]
    for delivery in deliveries:
        spark.createDataFrame([(START + dt.timedelta(seconds=s), i, h) for s, i, h in delivery], "ts timestamp, id long, file_hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, id long, file_hash string").parquet(str(tmp_path / "in"))
        incremental_ingest(stream, target, str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(target)
    assert sorted(str(r["file_hash"]) for r in out.collect()) == ["None", "aa1", "bb1", "cc1", "cc2"] and out.where("file_hash = 'aa1'").first()["id"] in (1, 3)
    seen = known_fingerprints(spark, f"{target}_seen", spark.createDataFrame([("cc9",)], "file_hash string"), 99)
    assert sorted(r[0] for r in seen.collect()) == ["cc1", "cc2"]
    scan = seen._jdf.queryExecution().executedPlan().toString()
    assert "prefix" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    read = seen.select(F.input_file_name()).distinct().collect()
    assert read and all("prefix=cc" in r[0] for r in read)


def test_one_timer_for_many_messages():
    """Not one for each message: the earliest end of a burst, and after it the next one's."""
    timers, held = [], []

    class State:
        exists = staticmethod(lambda: bool(held))
        appendList = staticmethod(held.extend)
        get = staticmethod(lambda: iter(held))

        @staticmethod
        def put(rows):
            held[:] = rows

    class Handle:
        getListState = staticmethod(lambda *a: State)
        registerTimer = staticmethod(timers.append)

    p = BurstProcessor(700)
    p.init(Handle)
    ts = pd.to_datetime([0, 100, 200, 2000, 2300, 5000], unit="ms")
    list(p.handleInputRows((1,), iter([pd.DataFrame({"ts": ts, "grp": "tags", "value": "a"})]), None))
    assert timers == [900]

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 1000)

    out = pd.concat(p.handleExpiredTimer((1,), Now, None))
    assert out["n"].tolist() == [3] and timers == [900, 3000] and len(held) == 3
