"""Request summaries as a stream: the state of a request is what its records add up to, so late and repeated looks end where a batch ends.

The state merges: of starts the first and of ends the last by the records' order, of each field the first value that isn't null, counts, times
and sources. Whenever records of a request come, its summary is told again, so the last one told is that of all records so far. Without `idle`
the state is that of Spark's own streaming aggregation, with the aggregates of a batch. With it, state that has had no record for `idle` is let
go of, by a processor in Python: each request then costs a few messages to the JVM whenever records of it come.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import traces as tr

KINDS = {"status_code": "int", "method": "string", "path": "string", "api": "string", "summary": "string"}
EDGE = "ord: string, us: long, duration_ms: double, event_type: string, status: string"
STATE = ", ".join([f"s struct<{EDGE}>", f"e struct<{EDGE}>", *[f"{c} struct<ord: string, value: {k}>" for c, k in KINDS.items()],
                   "first_us long", "last_us long", "error_count long", "event_count long", "stage_count long", "source_ids array<string>", "told long"])
OUTPUT = ", ".join(["project_key string", "request_id string", STATE])


def order_text(o: Column) -> Column:
    """The order of records as a text that sorts in the same way: without a time last, then by time, line and number."""
    wide = lambda c: F.lpad((F.coalesce(c, F.lit(0)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.when(o["late"], "1").otherwise("0"), wide(F.unix_micros(o["t"])), wide(o["line"]), wide(o["seq"]))


def earlier(a, b):
    return a if b is None or (a is not None and a[0] <= b[0]) else b


def later(a, b):
    return a if b is None or (a is not None and a[0] >= b[0]) else b


class Summary(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, e, *firsts, first, last, errors, events, stages, sources, told = self.state.get() or (None, None, *[None] * len(KINDS), None, None, 0, 0, 0, [], 0)
        known = set(sources)
        for r in rows:
            edge = (r["ord"], r["us"], r["duration_ms"], r["event_type"], r["status"])
            if r["is_start"]:
                s = earlier(s, edge)
            if r["is_terminal"]:
                e = later(e, edge)
            firsts = [old if r[c] is None else earlier(old, (r["ord"], r[c])) for c, old in zip(KINDS, firsts, strict=True)]
            if r["us"] is not None:
                first = r["us"] if first is None else min(first, r["us"])
                last = r["us"] if last is None else max(last, r["us"])
            errors, events, stages = errors + bool(r["is_error"]), events + 1, stages + bool(r["is_stage"])
            if r["source_id"] is not None:
                known.add(r["source_id"])
        plain = lambda x: None if x is None else tuple(x)
        state = (plain(s), plain(e), *map(plain, firsts), first, last, errors, events, stages, sorted(known), told + 1)
        self.state.update(state)
        yield Row(project_key=key[0], request_id=key[1], **dict(zip(NAMES, state, strict=True)))

    def close(self) -> None:
        pass


NAMES = ["s", "e", *KINDS, "first_us", "last_us", "error_count", "event_count", "stage_count", "source_ids", "told"]


def summarised(records: DataFrame, mapping: dict[str, str] | None = None, idle: timedelta | None = None) -> DataFrame:
    """A stream of parsed records -> a stream of request summaries, as `traces.requests` has them, with told, which grows with each telling of a
    request. `latest` keeps the last one. With `idle` the session's state store must be RocksDB's; without, it should be."""
    if idle is None:
        return tr.finished(tr.added_up(tr.contributions(records, mapping)).withColumn("told", F.col("event_count")), "told")
    rows = tr.contributions(records, mapping).withColumn("ord", order_text(F.col("ord"))).withColumn("project_key", F.coalesce(F.concat(F.lit("="), "project_id"), F.lit(""))).drop("project_id")
    rows = rows.withColumns({"status_code": F.col("status_code").cast("int"), "us": F.unix_micros("timestamp")}).drop("timestamp")
    ms = int(idle.total_seconds() * 1000)
    out = rows.groupBy("project_key", "request_id").transformWithState(statefulProcessor=Summary(ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")
    flat = out.withColumn("project_id", F.when(F.col("project_key") != "", F.substring("project_key", F.lit(2), F.length("project_key")))).withColumns({c: F.col(f"{c}.value") for c in KINDS})
    edge = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.timestamp_micros(f"{c}.us").alias("timestamp"), *[F.col(f"{c}.{x}").alias(x) for x in tr.EDGE if x != "timestamp"]))
    return tr.finished(flat.withColumns({"s": edge("s"), "e": edge("e"), "first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us")}), "told")


def latest(told: DataFrame) -> DataFrame:
    """The last summary of each request."""
    rest = [c for c in told.columns if c not in tr.KEY]
    return told.groupBy(*tr.KEY).agg(F.max_by(F.struct(*rest), "told").alias("r")).select(*tr.KEY, "r.*")
