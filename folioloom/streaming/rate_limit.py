"""Sliding-window rate limit: a hit passes unless `limit` accepted hits are younger than the window.

Rejected hits are not remembered, so a plain count over a range would be wrong.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The session setting that streams with timers and typed state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LIMIT, WINDOW = 30, 60.0


def decide(times: Iterable[float], kept: deque, limit: int = LIMIT, window: float = WINDOW) -> list[bool]:
    """Accept or reject each hit in time order; `kept` holds accepted times, oldest first, and is updated."""
    out = []
    for t in times:
        while kept and kept[0] < t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def batch(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """hits: key, ts (timestamp), seq. Adds accepted.

    Rows stream through sorted by key and time, with the state of one key at a time,
    so a key's hits are never held together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for pdf in frames:
            out: list[bool] = []
            seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
            for k, group in seconds.groupby(pdf["key"].ne(pdf["key"].shift()).cumsum(), sort=False):
                now = pdf["key"].loc[group.index[0]]
                if now != key:
                    key, kept = now, deque()
                out += decide(group, kept, limit, window)
            yield pdf.assign(accepted=out)

    sorted_ = hits.select("key", "ts", "seq").repartition("key").sortWithinPartitions("key", "ts", "seq")
    return sorted_.mapInPandas(run, "key long, ts timestamp_ntz, seq long, accepted boolean")


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        kept = deque(self.kept.get()[0] if self.kept.exists() else ())
        seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
        accepted = decide(seconds, kept, self.limit, self.window)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.kept.update((list(kept),))
            self.handle.registerTimer(int((kept[-1] + self.window) * 1000) + 1)
        yield pd.DataFrame({"key": key[0], "seq": pdf["seq"], "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"key": [], "seq": [], "accepted": []}).astype({"key": "int64", "seq": "int64", "accepted": "bool"})

    def close(self) -> None:
        pass


def stream(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW, late: str = "0 seconds") -> DataFrame:
    """The same over a stream whose micro-batches come in order, hits later than `late` dropped.

    The state of a key is its accepted times, at most `limit`. A timer drops it when the
    watermark is past the window of the last one, so idle keys leave the state. A key's hits of one
    micro-batch are held together. Needs the RocksDB state store (STORE).
    """
    timed = hits.select("key", F.col("ts").cast("timestamp").alias("ts"), "seq").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Limiter(limit, window), "key long, seq long, accepted boolean", "Append", "EventTime")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling counts with a watermark; ts may be without zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
