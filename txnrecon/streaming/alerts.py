"""Windowed outcome rates and sustained alerts over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State of a stretch that has fired already.
FIRED = -1
ALERT_SCHEMA = "alert STRING, started TIMESTAMP, fires_at TIMESTAMP"


def outcome_rates(events: DataFrame, step: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts per step, source and disposition, emitted when the watermark has passed."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", step).alias("w"), "source", "disposition")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "source", "disposition", "n")
    )


def look_back(events: DataFrame, window: str = "1 hour", step: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Reviews of a sliding look-back window. The window is two-staged: steps are counted
    first, and only the counts are copied into the windows that hold them."""
    steps = events.withWatermark("ts", lateness).where(F.col("disposition") == "review").groupBy(F.window("ts", step))
    counted = steps.agg(F.count("*").alias("n"))
    return (
        counted.groupBy(F.window(F.window_time("window"), window, step).alias("w"))
        .agg(F.sum("n").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def last_values(
    events: DataFrame, value: str, labels: list[str], window: str = "3 hours", step: str = "5 minutes", lateness: str = "10 minutes",
    tie: str | None = None,
) -> DataFrame:
    """Newest value of each look-back window: of values of one time that with the greatest ``tie``
    (a column, the value itself where none is named). Two-staged: the newest of each step is found
    first, and only that is copied into the windows that hold the step."""
    newest = F.struct(F.col("ts"), F.col(tie or value).alias("tie"), F.col(value).alias("value"))
    steps = events.withWatermark("ts", lateness).groupBy(F.window("ts", step), *labels).agg(F.max(newest).alias("n"))
    return (
        steps.groupBy(F.window(F.window_time("window"), window, step).alias("w"), *labels)
        .agg(F.max("n").alias("n"))
        .select(F.col("w.end").alias("window_end"), *labels, F.col("n.value").alias(value))
    )


class Sustained(StatefulProcessor):
    """Fires once when a condition has held for a while.

    Input rows per alert: ts, firing. The state is the start of the current stretch; a
    timer set ``hold_ms`` after it fires the alert unless the condition ended before.
    """

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ms BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        start = self.since.get()[0] if self.since.exists() else None
        fired = []
        for ts, firing in zip(seen["ts"], seen["firing"]):
            now = int(ts.value // 1_000_000)
            if start is not None and start >= 0 and start + self.hold_ms <= now:
                # Held long enough; the stretch stays quiet until it ends.
                fired.append(start)
                self._disarm(start)
                start = FIRED
            if not firing:
                if start is not None and start >= 0:
                    self._disarm(start)
                start = None
            elif start is None:
                start = now
                self.handle.registerTimer(now + self.hold_ms)
        if start is None:
            self.since.clear()
        else:
            self.since.update((start,))
        yield self._rows(key, fired)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = self.since.get()[0] if self.since.exists() else None
        fired = []
        if start is not None and start >= 0 and start + self.hold_ms == expiredTimerInfo.getExpiryTimeInMs():
            fired.append(start)
            self.since.update((FIRED,))
        yield self._rows(key, fired)

    def close(self) -> None:
        pass

    def _disarm(self, start: int) -> None:
        self.handle.deleteTimer(start + self.hold_ms)

    def _rows(self, key: Any, starts: list[int]) -> pd.DataFrame:
        began = pd.to_datetime(pd.Series(starts, dtype="int64"), unit="ms")
        return pd.DataFrame(
            {"alert": pd.Series([key[0]] * len(starts), dtype="object"), "started": began, "fires_at": began + pd.Timedelta(milliseconds=self.hold_ms)}
        )


def sustained(signals: DataFrame, hold_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Alerts of a stream of (alert, ts, firing). Needs the RocksDB state store."""
    return (
        signals.withWatermark("ts", lateness)
        .groupBy("alert")
        .transformWithStateInPandas(
            statefulProcessor=Sustained(hold_seconds * 1000),
            outputStructType=ALERT_SCHEMA,
            outputMode="append",
            timeMode="eventTime",
        )
    )
