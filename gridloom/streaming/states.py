"""The state of every run, as a stream and as a batch. An extension: the audits that it follows read committed files once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours without an event after which a run that goes on counts as stalled.
STALL = 48
OUT = "run string, state string, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_states(events: DataFrame, now: Column, stall_hours: int = STALL) -> DataFrame:
    """run, state of a table of events (run, event, ts): STOPPED once it failed, else DONE, else RUNNING, or RUNNING-STALLED if ``now`` is ``stall_hours`` or more past its last event.

    Events are start, beat, done and failed; others and null times do not count. A run without a start that goes on is RUNNING from its first event.
    """
    own = events.where(F.col("event").isin("start", "beat", "done", "failed") & F.col("ts").isNotNull())
    one = own.groupBy("run").agg(F.bool_or(F.col("event") == "failed").alias("failed"), F.bool_or(F.col("event") == "done").alias("done"), F.max("ts").alias("last"))
    late = now.cast("double") - F.col("last").cast("double") >= stall_hours * 3600
    return one.select("run", F.when(F.col("failed"), "STOPPED").when(F.col("done"), "DONE").when(late, "RUNNING-STALLED").otherwise("RUNNING").alias("state"))


class _Runs(StatefulProcessor):
    """Keeps a run's state and the time of its last event; a timer of event time is set to when it would have stalled."""

    def __init__(self, stall_hours: int):
        self.wait = timedelta(hours=stall_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, last timestamp")

    def _changed(self, key: tuple, state: str, at) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "state": [state], "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, last = self.held.get() if self.held.exists() else ("", None)
        before, at = state, last
        for pdf in rows:
            own = pdf[pdf["event"].isin(("start", "beat", "done", "failed")) & pdf["ts"].notna()]
            if own.empty:
                continue
            seen, newest = set(own["event"]), own["ts"].max().to_pydatetime()
            last = newest if last is None else max(last, newest)
            if "failed" in seen or state == "STOPPED":
                state = "STOPPED"
            elif "done" in seen or state == "DONE":
                state = "DONE"
            elif at is None or last > at:  # an event older than the last one is no sign of life
                state = "RUNNING"
        if not state:
            return
        if last != at:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if state == "RUNNING":
                self.handle.registerTimer(int((pd.Timestamp(last) + self.wait).timestamp() * 1000))
        self.held.update((state, last))
        if state != before:
            yield self._changed(key, state, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last = self.held.get()
        if state == "RUNNING":
            self.held.update(("RUNNING-STALLED", last))
            yield self._changed(key, "RUNNING-STALLED", pd.Timestamp(last) + self.wait)

    def close(self) -> None:
        pass


def state_changes(events: DataFrame, late: str = "1 hour", stall_hours: int = STALL) -> DataFrame:
    """run, state, at: a row each time the state of a run changes, of a stream of events (run, event, ts).

    The rules are those of ``run_states``, with the watermark (``late`` behind the newest event) as the present time. Events that come later than the watermark are left
    out; a stall is told by a timer, without any event of that run; an event after it sets the run going again. State is a value a run.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = events.select(F.col("run").cast("string").alias("run"), "event", "ts").withWatermark("ts", late)
    return own.groupBy("run").transformWithStateInPandas(_Runs(stall_hours), OUT, "Append", "EventTime")
