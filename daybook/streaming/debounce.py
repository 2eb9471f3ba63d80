"""The debounce as keyed state: of each path the last event, once it has been quiet for a while.

A path's state is its last event and a timer. A newer event takes the place of the older one and sets the timer anew; when the timer
comes due, the event is given and the state goes. An event that comes back after an outage never takes the place of a newer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: seconds of quiet before a changed file is read.
QUIET = 45
EVENT = "kind string, ts timestamp, event_id long, attempts int"
OUT = f"path string, {EVENT}"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounce(StatefulProcessor):
    """Keyed by path. by_event: quiet is measured by the events' own times against the watermark, so that a replay gives the same rows;
    otherwise by the clock, from an event's arrival."""

    def __init__(self, quiet: float, by_event: bool):
        self.quiet, self.by_event = int(quiet * 1000), by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{EVENT}, due long")

    def _given(self, path: str, event: tuple) -> pd.DataFrame:
        kind, ts, number, attempts = event[:4]
        return pd.DataFrame({"path": [path], "kind": [kind], "ts": [pd.Timestamp(ts)], "event_id": [number], "attempts": [attempts]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All of a path's rows at once, and what they give as one frame: the cost is of paths, not of events."""
        came = pd.concat(rows).sort_values(["again", "ts", "event_id"], kind="stable")
        stored = self.last.get() if self.last.exists() else None
        last = tuple(stored) if stored else None
        fresh = came[~came["again"].to_numpy(bool)]
        if last:
            ts = pd.Timestamp(last[1])
            fresh = fresh[(fresh["ts"] > ts) | ((fresh["ts"] == ts) & (fresh["event_id"] >= last[2]))]
        elif fresh.empty:
            fresh = came.head(1)
        if fresh.empty:
            return
        newest = next(fresh.tail(1).itertuples())
        due = (int(newest.ts.timestamp() * 1000) if self.by_event else timerValues.getCurrentProcessingTimeInMs()) + self.quiet
        if self.by_event:
            seen = fresh[["kind", "ts", "event_id", "attempts"]]
            if last:
                seen = pd.concat([self._given(key[0], last)[list(seen.columns)], seen])
            micros = seen["ts"].to_numpy("datetime64[us]").astype("int64")
            given = seen.iloc[:-1][np.diff(micros) >= self.quiet * 1000]  # it was quiet after these
            if len(given):
                given.insert(0, "path", key[0])
                yield given
        if not last or due != last[4]:
            if last:
                self.handle.deleteTimer(last[4])
            self.handle.registerTimer(due)
        self.last.update((newest.kind, newest.ts.to_pydatetime(), int(newest.event_id), int(newest.attempts), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            last = tuple(self.last.get())
            if last[4] <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._given(key[0], last)

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers need the RocksDB store; it keeps state on disk and writes only what changed to the checkpoint."""
    spark.conf.set(*STORE)


def debounced(events: DataFrame, quiet: float = QUIET, by_event: bool = False, late: str = "10 minutes") -> DataFrame:
    """(path, kind, ts, event_id, attempts) of a stream of events (path, kind, ts, event_id and, if it has them, attempts, again).

    `again` marks what an outage gave back: it counts only where the path has nothing newer. Of equal times the greater event_id is
    newer. With by_event, events later than `late` behind the newest are dropped, and bursts that lie `quiet` apart are given each;
    otherwise a path is given once it has been quiet by the clock, and nothing is dropped. State is one row a waiting path.
    """
    keep_state_on_disk(events.sparkSession)
    has = set(events.columns)
    rows = events.select(
        "path", "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"),
        (F.coalesce("attempts", F.lit(0)) if "attempts" in has else F.lit(0)).cast("int").alias("attempts"),
        (F.coalesce("again", F.lit(False)) if "again" in has else F.lit(False)).alias("again"),
    ).where("path IS NOT NULL AND ts IS NOT NULL")
    if by_event:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("path").transformWithStateInPandas(Debounce(quiet, by_event), OUT, "Append", "EventTime" if by_event else "ProcessingTime")
