"""Bursts of selections as a stream with state of our own: what was chosen in each, by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The group whose values are hours of the day.
HOURS = "horas"
#: One burst: its first and last message, how many there were, the hours in order, and the values of each other group in the order in which they came.
BURST = "user_id long, start timestamp, end timestamp, n long, hours array<int>, chosen map<string,array<string>>"


def burst_row(user_id: int, messages: list[tuple]) -> dict:
    """One burst of ``messages`` (ts, grp, value), in order. Hours that are no whole number from 0 to 23 don't count; nor do null values."""
    hours, chosen = set(), {}
    for _, group, value in messages:
        if value is None:
            continue
        if group == HOURS:
            if value.strip().isdigit() and int(value) < 24:
                hours.add(int(value))
        elif value not in chosen.setdefault(group, []):
            chosen[group].append(value)
    return {"user_id": user_id, "start": messages[0][0], "end": messages[-1][0], "n": len(messages), "hours": sorted(hours), "chosen": chosen}


def split_bursts(messages: list[tuple], gap: pd.Timedelta) -> Iterator[list[tuple]]:
    """Messages in order, cut where ``gap`` or more has passed."""
    held: list[tuple] = []
    for m in sorted(messages, key=lambda m: (m[0], m[1] or "", m[2] or "")):
        if held and m[0] - held[-1][0] >= gap:
            yield held
            held = []
        held.append(m)
    if held:
        yield held


class BurstProcessor(StatefulProcessor):
    """Keeps a user's messages until the watermark has passed the silence after them; a timer then sends out what is complete."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "ts timestamp, grp string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [(ts, None if pd.isna(g) else g, None if pd.isna(v) else v) for ts, g, v in zip(frame["ts"], frame["grp"], frame["value"], strict=True)]
            self.messages.appendList([(ts.to_pydatetime(), g, v) for ts, g, v in new])
            self._wake(split_bursts(new, pd.Timedelta(self.gap_ms, "ms")))
        yield pd.DataFrame()

    def _wake(self, bursts: Iterable[list[tuple]]) -> None:
        """One timer, at the earliest end that is possible: whatever is held, its last message in a burst is the last in one of these, or has been before. What it finds incomplete waits for the next one."""
        first = min((b[-1][0] for b in bursts), default=None)
        if first is not None:
            self.handle.registerTimer(-(-first.value // 1_000_000) + self.gap_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gap = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"), pd.Timedelta(self.gap_ms, "ms")
        if not self.messages.exists():
            return
        done, left = [], []
        for burst in split_bursts([(pd.Timestamp(m[0]), m[1], m[2]) for m in self.messages.get()], gap):
            if burst[-1][0] + gap <= now:
                done.append(burst_row(key[0], burst))
            else:
                left.append(burst)
        if left:
            if done:
                self.messages.put([(ts.to_pydatetime(), g, v) for burst in left for ts, g, v in burst])
            self._wake(left)
        else:
            self.messages.clear()
        yield pd.DataFrame(done, columns=["user_id", "start", "end", "n", "hours", "chosen"]) if done else pd.DataFrame()

    def close(self) -> None:
        pass


def selection_stream(stream: DataFrame, gap_ms: int = 700, late: str = "10 seconds") -> DataFrame:
    """Bursts (see BURST) of a stream of messages (ts, user_id, grp, value): a user's messages up to a silence of ``gap_ms``. Messages later than ``late`` are
    dropped and counted by Spark (numRowsDroppedByWatermark). State holds open bursts only. The session must use the RocksDB state store."""
    keyed = stream.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "grp", "value").where("ts IS NOT NULL").withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(BurstProcessor(gap_ms), BURST, "Append", "EventTime")


def bursts_of(messages: DataFrame, gap_ms: int = 700) -> DataFrame:
    """The same of a table that is there as a whole."""
    gap = pd.Timedelta(gap_ms, "ms")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        user = rows["user_id"].iloc[0]
        all_of = [(ts, None if pd.isna(g) else g, None if pd.isna(v) else v) for ts, g, v in zip(rows["ts"], rows["grp"], rows["value"], strict=True)]
        return pd.DataFrame([burst_row(user, b) for b in split_bursts(all_of, gap)])

    return messages.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "grp", "value").where("ts IS NOT NULL").groupBy("user_id").applyInPandas(run, BURST)
