"""Sources that go quiet by themselves: live while lines come, idle and then stale when none does, told by timers and not by lines.

State is kept by source: the time of its last line and what was told of it. Each line sets a timer; when it expires without a further line, the
source is told to be idle, and a later timer tells that it is stale. The clock is that of the events (behind the stream's watermark, which makes replays
and tests exact) or that of the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TOLD = "project_id string, source_id string, state string, last_ms long, at_ms long, told long"


class Quiet(StatefulProcessor):
    def __init__(self, idle_ms: int, stale_ms: int, by_events: bool):
        self.idle_ms, self.stale_ms, self.by_events = idle_ms, stale_ms, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", "last_ms long, state string, told long")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at + 1)  # a source is as it was up to and with the moment itself

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, state, told = self.state.get() if self.state.exists() else (None, None, 0)
        newest = max((r["ms"] for r in rows if r["ms"] is not None), default=None) if self.by_events else timerValues.getCurrentProcessingTimeInMs()
        if newest is None or (last is not None and newest <= last):
            return
        self._timer(newest + self.idle_ms)
        self.state.update((newest, "live", told + 1))
        yield Row(project_id=key[0], source_id=key[1], state="live", last_ms=newest, at_ms=newest, told=told + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        last, state, told = self.state.get()
        now = timerValues.getCurrentWatermarkInMs() if self.by_events else timerValues.getCurrentProcessingTimeInMs()
        for after, wait in (("idle", self.idle_ms), ("stale", self.stale_ms)):  # a clock that has jumped may have passed both
            if (state, after) in (("live", "idle"), ("idle", "stale")) and now > last + wait:
                state, told = after, told + 1
                yield Row(project_id=key[0], source_id=key[1], state=state, last_ms=last, at_ms=last + wait, told=told)
        self.state.update((last, state, told))
        if state != "stale":
            self._timer(last + (self.idle_ms if state == "live" else self.stale_ms))

    def close(self) -> None:
        pass


def watched(stream: DataFrame, time: str, idle: timedelta = timedelta(seconds=60), stale: timedelta = timedelta(seconds=300), late: str | None = "0 seconds") -> DataFrame:
    """A stream with project_id, source_id and a time -> a row whenever lines of a source have come or its state changes: state (live, idle or stale), the time of its last
    line, when the state began, and which telling of the source this is. late: the watermark's delay, by events; None: the machine's clock."""
    ms = lambda t: int(t.total_seconds() * 1000)
    rows = stream.select(F.coalesce("project_id", F.lit("")).alias("project_id"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.col(time).alias("_time"), F.unix_millis(time).alias("ms"))
    if late is not None:
        rows = rows.withWatermark("_time", late)
    return rows.groupBy("project_id", "source_id").transformWithState(statefulProcessor=Quiet(ms(idle), ms(stale), late is not None), outputStructType=TOLD, outputMode="Update", timeMode="EventTime" if late is not None else "ProcessingTime")


def current(told: DataFrame) -> DataFrame:
    """The last that was told of each source."""
    return told.groupBy("project_id", "source_id").agg(F.max_by(F.struct("state", "last_ms", "at_ms"), "told").alias("r")).select("project_id", "source_id", "r.*")


def projects(sources: DataFrame) -> DataFrame:
    """project_id, live, idle, stale (sources in each state) and status: live with a live source, else stale with a stale one, else idle."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    g = sources.groupBy("project_id").agg(*[n(s).alias(s) for s in ("live", "idle", "stale")])
    return g.withColumn("status", F.when(F.col("live") > 0, "live").when(F.col("stale") > 0, "stale").otherwise("idle"))
