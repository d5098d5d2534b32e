"""Trace analytics: log lines to records, records to requests, stages, errors and health. Plain DataFrame work throughout: the
same functions serve a batch and a micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.frames import computed, quantile
from quillspark.functions.text import none_if_blank

NO_LINE = 1_000_000_000
SUMMARY_FIELDS = ["summary", "display_summary", "message", "title", "name", "operation"]
MESSAGE_FIELDS = ["summary", "display_summary", "message", "exception", "error_type", "name", "operation"]
DETAIL_FIELDS = ["exception", "summary", "display_summary", "message", "error_type"]
REDACTED = "[REDACTED]"

# name of a record's column -> keys to look under, at the root first, then among the attributes
ALIASES = {
    "timestamp_raw": ["timestamp"], "event": ["event", "message"], "explicit_span": ["span_name", "operation", "name"], "service": ["service"], "logger": ["logger"], "level": ["level"],
    "span_id": ["span_id"], "parent_span_id": ["parent_span_id"], "own_trace": ["trace_id"], "own_request": ["request_id"], "kind": ["kind", "span.kind"], "own_status": ["status", "span.status"],
    "code_text": ["status_code", "http.status_code"], "duration_text": ["duration_ms", "duration"], "error_type": ["error_type", "exception.type"], "exception": ["exception"], "method": ["method", "http.method"],
    "path": ["path", "http.path"], "summary": ["summary", "display_summary"], "version_text": ["schema_version"],
}


@dataclass(frozen=True)
class LogSource:
    project_id: str | None = None
    source_id: str | None = None
    timezone: str = "Asia/Shanghai"
    service_hint: str | None = None
    redact_fields: tuple[str, ...] = ()


class Number(float):
    """A number that remembers how it was written."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


def redacted(value, fields: frozenset[str]):
    """A JSON value in which whatever stands under one of these keys, at any depth, in objects and lists, is replaced whole."""
    left = [value]
    while left:
        node = left.pop()
        for k, v in list(node.items() if isinstance(node, dict) else enumerate(node)):
            if isinstance(node, dict) and k in fields:
                node[k] = REDACTED
            elif isinstance(v, (dict, list)):
                left.append(v)
    return value


def as_text(value) -> str | None:
    """A JSON value as text: strings and numbers as they are, what holds others as compact JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, Number):
        return value.text
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def decoded(line: str | None, fields: frozenset[str]) -> tuple[str | None, dict, dict | None]:
    """(error, values by key as text, attributes by key as text)."""
    text = (line or "").strip()
    if not text:
        return "empty line", {}, None
    try:
        value = json.loads(text, parse_float=Number)
        if not isinstance(value, dict):
            return "not a JSON object", {}, None
        if fields:
            redacted(value, fields)
        inner = value.get("attributes")
        return None, {k: as_text(v) for k, v in value.items()}, {k: as_text(v) for k, v in inner.items()} if isinstance(inner, dict) else None
    except (ValueError, RecursionError):
        return "invalid JSON", {}, None


def found_under(keys: list[str], root: dict, attributes: dict) -> str | None:
    """The value under the first key that is there, at the root or else among the attributes; a null that is there ends the search."""
    for k in keys:
        if k in root or k in attributes:
            value = root[k] if k in root else attributes[k]
            return (value or "").strip() or None
    return None


def read_lines(lines: DataFrame, line: str, fields: tuple[str, ...]) -> DataFrame:
    """lines without `line`, with parse_error, raw and attributes (maps of texts) and a column for each of ALIASES. Every line is decoded once."""
    made = ["parse_error", "raw", "attributes", *ALIASES]
    keep = [c for c in lines.columns if c not in made and c != line]
    hidden, pairs = frozenset(fields), pa.map_(pa.string(), pa.string())
    clean = lambda d: None if d is None else list(d.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decoded(x, hidden) for x in batch.column("_line").to_pylist()]
            named = [pa.array([found_under(keys, root, attr or {}) for _, root, attr in rows], pa.string()) for keys in ALIASES.values()]
            maps = [pa.array([clean(root) if e is None else None for e, root, _ in rows], pairs), pa.array([clean(attr) for *_, attr in rows], pairs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([e for e, *_ in rows], pa.string()), *maps, *named], names=[*keep, *made])

    schema = ", ".join([*[f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep], "parse_error string", "raw map<string,string>", "attributes map<string,string>", *[f"{c} string" for c in ALIASES]])
    return lines.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{line}`").alias("_line")).mapInArrow(run, schema)


def timestamps(raw: Column, zone: str) -> tuple[Column, Column]:
    """(UTC time, name of the format): local with a fraction, epoch seconds or milliseconds, ISO without or with a zone."""
    text = none_if_blank(raw)
    local = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$"), F.try_to_timestamp(text))
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
    digits = F.length(F.regexp_extract(text, r"^[+-]?(\d+)", 1))
    in_ms = (F.abs(number) >= 1e11) | (digits >= 13)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), text)
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & iso.rlike(":"), F.try_to_timestamp(F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    naive = F.when(~iso.rlike(r":.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(iso))
    utc = lambda t: F.to_utc_timestamp(t, zone)
    epoch = F.timestamp_micros(F.round(F.when(in_ms, number * 1000).otherwise(number * 1_000_000)).cast("long"))
    time = F.coalesce(utc(local), F.when(number.isNotNull(), epoch), zoned, utc(naive))
    kind = F.when(local.isNotNull(), "local_datetime").when(number.isNotNull(), F.when(in_ms, "epoch_ms").otherwise("epoch_s")).when(zoned.isNotNull(), "rfc3339").when(naive.isNotNull(), "iso8601_naive")
    return time, kind


def whole_number(text: Column) -> Column:
    """An int where the text is one, or a float without a fraction."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("int"), F.when(number == F.floor(number), number.try_cast("int")))


def known_zone(zone: str) -> tuple[str, str | None]:
    """(zone that Spark takes, warning)."""
    import re
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    z = (zone or "").strip() or "Asia/Shanghai"
    if z in ("UTC", "Z"):
        return "UTC", None
    if m := re.fullmatch(r"([+-]\d{2}):?(\d{2})", z):
        return f"{m[1]}:{m[2]}", None
    try:
        ZoneInfo(z)
    except (ZoneInfoNotFoundError, ValueError):
        return "UTC", f"unknown timezone {z!r}; falling back to UTC"
    return z, None


def parse(lines: DataFrame, source: LogSource = LogSource(), line: str = "line") -> DataFrame:
    """lines (line, line_number, ...) -> records. A line that is empty, no JSON or no object stays as a row: valid is false,
    parse_error says why. The original line isn't kept, so that redacted values are gone."""
    zone, warning = known_zone(source.timezone)
    rows = read_lines(lines, line, source.redact_fields).withColumn("valid", F.col("parse_error").isNull())
    time, kind = timestamps(F.col("timestamp_raw"), zone)
    event = F.col("event")
    suffix = F.regexp_extract(event, r"(?:^|\.)(start|end|error)$", 1)
    event_type = F.when(event.isNull(), None).when(suffix != "", suffix).otherwise("event")
    base = F.when(event.isin("start", "end", "error"), None).when(suffix != "", F.regexp_replace(event, r"\.(start|end|error)$", "")).otherwise(event)
    code = F.when(~F.lower("code_text").isin("true", "false"), whole_number(F.col("code_text")))
    rows = computed(rows, {"timestamp": time, "timestamp_format": kind, "event_type": event_type, "span_name": F.coalesce("explicit_span", base), "status_code": code,
                             "duration_ms": F.col("duration_text").try_cast("double"), "trace_id": F.coalesce("own_trace", "own_request"), "request_id": F.coalesce("own_request", "own_trace"), "schema_version": F.when(F.col("valid"), F.coalesce(whole_number(F.col("version_text")), F.lit(1)))})
    status = F.coalesce("own_status", F.when(F.col("status_code") >= 400, "error").when(F.col("status_code").isNotNull(), "ok").when((F.col("event_type") == "error") | F.col("error_type").isNotNull() | F.col("exception").isNotNull(), "error").when(F.col("event_type") == "end", "ok"))
    warnings = F.array_compact(F.array(F.lit(warning), F.when(F.col("timestamp_raw").isNotNull() & F.col("timestamp").isNull(), F.concat(F.lit("unparsed timestamp value: "), "timestamp_raw"))))
    rows = computed(rows, {"status": status, "warnings": warnings, "project_id": F.lit(source.project_id).cast("string"), "source_id": F.lit(source.source_id).cast("string"), "service": F.coalesce("service", F.lit(source.service_hint))})
    return rows.drop("own_trace", "own_request", "own_status", "code_text", "duration_text", "version_text", "explicit_span")


def canonical_event() -> Column:
    """The event's full name: span and type where the event itself is only a type."""
    bare = F.col("event").isNull() | F.col("event").isin("start", "end", "error", "event")
    return F.when(~bare, F.col("event")).when(F.col("span_name").isNotNull() & F.col("event_type").isin("start", "end", "error"), F.concat_ws(".", "span_name", "event_type")).when(F.col("span_name").isNotNull() & (F.col("event_type") == "event"), F.col("span_name")).otherwise(F.coalesce("event", "span_name"))


def marked(records: DataFrame) -> DataFrame:
    """records with name (the canonical event), stage (null for request events), is_start, is_terminal, is_error, ord (their order)."""
    request = F.coalesce(F.col("span_name") == "http.request", F.lit(False))
    typed = lambda *t: F.coalesce(F.col("event_type").isin(*t), F.lit(False))
    is_event = lambda *e: F.coalesce(F.col("event").isin(*e), F.lit(False))
    out = computed(records, {"name": canonical_event()})
    of_request = F.coalesce(F.col("name").startswith("http.request."), F.lit(False)) | (request & typed("start", "end", "error"))
    event = F.col("event")
    stage = F.when(F.col("span_name").isNotNull(), F.when(~of_request, F.col("span_name"))).when(event.startswith("http.request."), None).otherwise(F.regexp_replace(event, r"\.(start|end|error)$", ""))
    error = (F.col("level") == "ERROR") | F.col("exception").isNotNull() | F.col("error_type").isNotNull() | typed("error") | ((F.col("status") == "error") & ~F.coalesce(F.col("name").isin("http.request.start", "http.request.end"), F.lit(False)))
    never = F.coalesce(F.col("name") == "http.request.error", F.lit(False)) | (request & typed("error"))
    return computed(out, {
        "stage": stage, "is_start": is_event("http.request.start") | (request & typed("start")), "is_terminal": is_event("http.request.end", "http.request.error") | (request & typed("end", "error")),
        "is_error": ~never & F.coalesce(error, F.lit(False)),
        "ord": F.struct(F.col("timestamp").isNull().alias("late"), F.col("timestamp").alias("t"), F.coalesce("line_number", F.lit(NO_LINE)).cast("long").alias("line"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq") if "seq" in records.columns else F.lit(0).cast("long").alias("seq"))})


def field_text(name: str) -> Column:
    columns = {"summary", "exception", "error_type"}
    inside = [none_if_blank(F.col("raw")[name]), none_if_blank(F.col("attributes")[name])]
    return F.coalesce(F.col(name), *inside) if name in columns else F.coalesce(*inside)


def summary_text(mapping: dict[str, str] | None = None) -> Column:
    """A record's summary: the field that the project maps its event to, then the general fields."""
    mapped = []
    for by in ("event", "name", "span_name"):
        mapped += [F.when(F.col(by) == k, field_text(v)) for k, v in (mapping or {}).items()]
    return F.coalesce(*mapped, *[field_text(f) for f in SUMMARY_FIELDS])


def project_mapping(mappings: dict[str, dict[str, str]], project: str | None) -> dict[str, str]:
    return mappings.get(project) or mappings.get("*") or mappings.get("default") or {} if mappings else {}


KEY = ["project_id", "request_id"]


#: Of a request's records in their order, the first that isn't null.
FIRSTS = ["status_code", "method", "path", "api", "summary"]
#: What the first start and the last end tell.
EDGE = ["timestamp", "duration_ms", "event_type", "status"]


def contributions(records: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Of each record of a request what counts: KEY, ord, is_start, is_terminal, is_error, is_stage, EDGE, FIRSTS, source_id."""
    m = marked(records.filter(F.col("valid") & F.col("request_id").isNotNull()))
    named = F.coalesce("stage", "name")
    api = F.when(named.startswith("api."), F.get(F.split(named, r"\."), F.lit(1)))
    stage = F.col("stage").isNotNull() & F.col("duration_ms").isNotNull()
    return m.select(*KEY, "ord", "is_start", "is_terminal", "is_error", stage.alias("is_stage"), *EDGE, "status_code", "method", "path", api.alias("api"), summary_text(mapping).alias("summary"), "source_id")


def requests(records: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """One row per project and request: type, start, end, method, path, status code and status, duration, summary, counts, partial."""
    return finished(added_up(contributions(records, mapping)))


def added_up(m: DataFrame) -> DataFrame:
    """What the contributions of each request's records add up to; they may come in any order, and in parts."""
    edge, count = F.struct(*EDGE), lambda c: F.count(F.when(F.col(c), 1))
    return m.groupBy(*KEY).agg(
        F.min_by(edge, F.when(F.col("is_start"), F.col("ord"))).alias("s"), F.max_by(edge, F.when(F.col("is_terminal"), F.col("ord"))).alias("e"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in FIRSTS],
        count("is_error").alias("error_count"), F.count("*").alias("event_count"), count("is_stage").alias("stage_count"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def finished(g: DataFrame, *more: str) -> DataFrame:
    """The summary of each request, from the aggregates of its records, and more columns of g."""
    started, ended, errors = F.col("s").isNotNull(), F.col("e").isNotNull(), F.col("error_count") > 0
    partial = ~started | (~ended & ~errors)
    status = F.when(ended & (F.col("e.event_type") == "error"), "failed").when(F.col("status_code") >= 400, "failed").when(errors, "failed").when(partial, "partial").when(ended & (F.col("e.status") == "error"), "failed").otherwise("ok")
    ms = lambda a, b: F.greatest(F.lit(0.0), (F.unix_micros(b) - F.unix_micros(a)) / 1000)
    both = started & ended
    duration = F.coalesce(F.when(both, F.coalesce("e.duration_ms", ms(F.col("s.timestamp"), F.col("e.timestamp")))), ms(F.col("first_seen"), F.col("last_seen")))
    tail = F.filter(F.split(F.regexp_replace("path", r"^[a-z]+://[^/]*|[?#].*$", ""), "/"), lambda p: p != "")
    return g.select(*KEY, F.coalesce("api", F.get(tail, F.size(tail) - 1)).alias("request_type"), F.coalesce("s.timestamp", "first_seen").alias("started_at"), F.coalesce("e.timestamp", "last_seen").alias("ended_at"), "method", "path", "status_code", status.alias("status"), duration.alias("duration_ms"), "summary", "error_count", (status == "failed").alias("failed"), F.col("last_seen").alias("last_event_at"), partial.alias("partial"), "event_count", "stage_count", "source_ids", *more)


def self_times(events: DataFrame, request: list[str], span: str = "span_id", parent: str = "parent_span_id", duration: str = "duration_ms") -> DataFrame:
    """events with self_ms (duration less that of the children in the same request, 0 at least) and is_leaf."""
    children = events.filter(F.col(span).isNotNull() & F.col(parent).isNotNull()).groupBy(*request, F.col(parent).alias(span)).agg(F.sum(F.coalesce(duration, F.lit(0.0))).alias("_children"))
    out = events.join(children, [*request, span], "left")
    return out.withColumns({"is_leaf": F.col("_children").isNull(), "self_ms": F.when(F.col("_children").isNull(), F.col(duration)).otherwise(F.greatest(F.lit(0.0), F.col(duration) - F.col("_children")))}).drop("_children")


def stage_events(records: DataFrame) -> DataFrame:
    m = marked(records.filter(F.col("valid") & F.col("request_id").isNotNull())).filter(F.col("stage").isNotNull() & F.col("duration_ms").isNotNull())
    return self_times(m.withColumn("project_id", F.coalesce("project_id", F.lit(""))), KEY)


def top_stages(stages: DataFrame, request: list[str], n: int = 5) -> DataFrame:
    """The n slowest stages of each request by self time; one of 0 counts with its whole duration."""
    slow = F.coalesce(F.nullif(F.col("self_ms"), F.lit(0.0)), F.col("duration_ms"), F.lit(0.0))
    w = Window.partitionBy(*request).orderBy(slow.desc(), F.col("timestamp").asc_nulls_last(), F.coalesce("line_number", F.lit(NO_LINE)))
    return stages.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def stage_stats(stages: DataFrame, by: list[str], value: str = "self_ms", error: Column | None = None) -> DataFrame:
    """Per stage: count, errors, average, exact interpolated p95 and maximum of self time, last seen, leaves."""
    failed = error if error is not None else F.col("is_error")
    sums = stages.groupBy(*by).agg(F.count("*").alias("count"), F.count(F.when(failed, 1)).alias("error_count"), F.avg(value).alias("avg_ms"), F.max(value).alias("max_ms"), F.max("timestamp").alias("last_seen_at"), F.count(F.when(F.col("is_leaf"), 1)).alias("leaf_count"))
    p95 = quantile(stages, by, value, 0.95, "p95_ms")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by])
    return sums.alias("s").join(p95.alias("q"), same, "left").select(*[F.col(f"s.{c}") for c in by], "count", "error_count", "avg_ms", "p95_ms", "max_ms", "last_seen_at", "leaf_count")


def errors(records: DataFrame) -> DataFrame:
    """Error records: of requests, without a request, and lines that couldn't be read; with message and detail."""
    rows = marked(records).filter(~F.col("valid") | F.col("is_error"))
    good = lambda c, other=None: F.when(F.col("valid"), c).otherwise(other)
    text = lambda fields: F.coalesce(*[field_text(f) for f in fields], "name")
    return rows.select("project_id", "source_id", "request_id", "timestamp", "line_number", good(F.col("name"), F.lit("parse_error")).alias("event"), good(text(MESSAGE_FIELDS), F.col("parse_error")).alias("message"), good(text(DETAIL_FIELDS), F.col("parse_error")).alias("detail"),
                       good(F.col("error_type"), F.lit("ParseError")).alias("error_type"), good(F.col("level"), F.lit("ERROR")).alias("level"), good(F.col("status"), F.lit("error")).alias("status"), "status_code", "path", "method")


def newest(rows: DataFrame, n: int, time: str = "timestamp", *ties: str) -> DataFrame:
    """The newest n, those without a time last."""
    return rows.orderBy(F.col(time).desc_nulls_last(), *ties).limit(n)


def overview(request_rows: DataFrame, error_rows: DataFrame) -> DataFrame:
    """One row: requests, failed and partial ones, errors, first and last event, p95 of durations."""
    r = request_rows.agg(F.count("*").alias("requests"), F.count(F.when(F.col("failed"), 1)).alias("failed_requests"), F.count(F.when(F.col("partial"), 1)).alias("partial_requests"), F.min("started_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"))
    e = error_rows.agg(F.count("*").alias("errors"))
    p = quantile(request_rows, [], "duration_ms", 0.95, "p95_ms")
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(r).join(one(e), "_one").join(one(p), "_one", "left").drop("_one")


def filtered(rows: DataFrame, equal: dict[str, object]) -> DataFrame:
    """Rows that equal every given value; a null never does."""
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None], F.lit(True)))


def one_request(request_rows: DataFrame, request_id: str) -> tuple[str, DataFrame]:
    """("found", row), ("missing", none) or ("ambiguous", rows of several projects)."""
    rows = request_rows.filter(F.col("request_id") == request_id)
    n = rows.limit(2).count()
    return ("missing", "found", "ambiguous")[n], rows


def within(rows: DataFrame, lookback: str | None, now: Column, time: str = "timestamp") -> DataFrame:
    """Rows of the last 15m, 2h and so on before now; rows without a time are left out. No or bad text: all rows."""
    import re

    m = re.fullmatch(r"\s*(\d+)([smhd])\s*", lookback or "")
    if not m:
        return rows
    seconds = int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
    return rows.filter(F.col(time) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def capped(records: DataFrame, n: int, *ties: str) -> DataFrame:
    """The newest n records; those without a time go first."""
    return newest(records, n, "timestamp", *ties)


RANKS = ["live", "idle", "stale", "offline", "degraded", "error"]


def health(sources: DataFrame, now: Column, idle: int = 60, stale: int = 300) -> DataFrame:
    """sources: project_id, source_id, exists, last_seen_at, last_error -> project_id, status and counts by state of its sources.

    A source that is missing is offline, with an error degraded; otherwise live, idle or stale by its age in seconds. A project with a
    live source is live, degraded if another source is in trouble; without any, it takes the worst state.
    """
    age = (F.unix_micros(now) - F.unix_micros("last_seen_at")) / 1e6
    state = F.when(~F.col("exists"), "offline").when(F.col("last_error").isNotNull(), "error").when(F.col("last_seen_at").isNull(), "idle").when(age <= idle, "live").when(age <= stale, "idle").otherwise("stale")
    s = sources.withColumn("state", state)
    n = lambda *k: F.count(F.when(F.col("state").isin(*k), 1))
    g = s.groupBy("project_id").agg(*[n(k).alias(k) for k in ("live", "idle", "stale", "offline", "error")])
    trouble = F.col("error") + F.col("offline") > 0
    status = F.when((F.col("live") > 0) & trouble, "degraded").when(F.col("live") > 0, "live").when(F.col("error") > 0, "error").when(F.col("offline") > 0, "offline").when(F.col("stale") > 0, "stale").otherwise("idle")
    return g.withColumn("status", status)
