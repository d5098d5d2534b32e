"""Trace queries. Events become log lines: a request is a user's day, and an event type is a span in it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import form_of, scratch, spread, table
from quillspark.operators import traces as tr
from quillspark.streaming import health, jobs
from quillspark.streaming import requests as request_stream
from quillspark.streaming.tail import LogReplay

from .registry import ORACLES, query

SQL_LOG = """ev AS (SELECT event_id, ts, user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, event_type AS kind, value, CASE event_type WHEN 'signup' THEN 'http.request.start' WHEN 'purchase' THEN 'http.request.end' WHEN 'error' THEN 'api.ask.error' ELSE 'api.' || event_type || '.end' END AS event FROM events),
rq AS (SELECT request_id, min_by(ts, (ts, event_id)) FILTER (kind = 'signup') AS s, max_by(ts, (ts, event_id)) FILTER (kind = 'purchase') AS e, max_by(value, (ts, event_id)) FILTER (kind = 'purchase') AS ed, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (kind = 'error') AS errors, count(*) AS events,
        count(*) FILTER (kind NOT IN ('signup', 'purchase')) AS stages, min_by(CASE WHEN kind = 'error' THEN 'ask' ELSE kind END, (ts, event_id)) FILTER (kind NOT IN ('signup', 'purchase')) AS request_type FROM ev GROUP BY request_id),
rs AS (SELECT *, s IS NULL OR (e IS NULL AND errors = 0) AS partial FROM rq),
rt AS (SELECT *, CASE WHEN errors > 0 THEN 'failed' WHEN partial THEN 'partial' ELSE 'ok' END AS status, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN ed ELSE epoch_us(last_seen) / 1000 - epoch_us(first_seen) / 1000 END AS duration FROM rs)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, line_number (the event's id)."""
    e = spread(table(spark, sf_dir, "events"))
    kind = F.col("event_type")
    event = F.when(kind == "signup", "http.request.start").when(kind == "purchase", "http.request.end").when(kind == "error", "api.ask.error").otherwise(F.concat(F.lit("api."), kind, F.lit(".end")))
    request = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct(at.alias("timestamp"), request.alias("request_id"), event.alias("event"), F.col("value").alias("duration_ms"), F.struct(F.col("props").alias("props"), F.lit("secret").alias("question")).alias("attributes")))
    return e.select(line.alias("line"), F.col("event_id").alias("line_number"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.parse(log_lines(spark, sf_dir), tr.LogSource("p", "s", "UTC", redact_fields=("question",)))


@query(f"WITH {SQL_LOG} SELECT event_id AS line_number, TRUE AS valid, request_id, event, CASE kind WHEN 'signup' THEN 'start' WHEN 'error' THEN 'error' ELSE 'end' END AS event_type, CASE WHEN kind IN ('signup', 'purchase') THEN 'http.request' WHEN kind = 'error' THEN 'api.ask' ELSE 'api.' || kind END AS span_name, CASE kind WHEN 'signup' THEN NULL WHEN 'error' THEN 'error' ELSE 'ok' END AS status, round(value, 6) AS duration_ms, epoch_us(ts) AS us FROM ev")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("line_number", "valid", "request_id", "event", "event_type", "span_name", "status", F.round("duration_ms", 6).alias("duration_ms"), F.unix_micros("timestamp").alias("us"))


SECRETS = [
    ("one word", '"question": "secret", "k": 1'), ("long", '"question": "' + "secret " * 300 + '"'), ("escaped", r'"question": "a \"secret\" \\"'), ("number", '"question": 4711'), ("null", '"question": null'), ("object", '"question": {"a": {"b": "secret"}}'),
    ("list", '"question": [["secret"], "x]"]'), ("bracket in a string", '"question": ["a ] secret", "}"]'), ("deep", '"k": {"l": [{"question": "secret", "m": 1}, 2]}'), ("other key", '"questions": "public"'), ("in a list of lists", '"k": [[{"question": "secret"}]]'), ("as a value", '"k": "question"'),
]


@query("""WITH k AS (SELECT event_id, event_id % 12 AS kind FROM events)
SELECT event_id AS line_number, TRUE AS valid, CASE WHEN kind < 8 THEN '[REDACTED]' END AS question, FALSE AS leaked,
       CASE kind WHEN 0 THEN '1' WHEN 8 THEN '{"l":[{"question":"[REDACTED]","m":1},2]}' WHEN 10 THEN '[[{"question":"[REDACTED]"}]]' WHEN 11 THEN 'question' END AS k, CASE WHEN kind = 9 THEN 'public' END AS questions FROM k""")
def log_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line that hides something another way: long and escaped strings, numbers, objects, lists, brackets in strings, at any depth."""
    forms = F.array(*[F.lit(form) for _, form in SECRETS])
    e = spread(table(spark, sf_dir, "events"))
    inner = F.get(forms, (F.col("event_id") % len(SECRETS)).cast("int"))
    lines = e.select(F.col("event_id").alias("line_number"), F.concat(F.lit('{"event": "api.x.end", "attributes": {'), inner, F.lit("}, "), inner, F.lit("}")).alias("line"))
    r = tr.parse(lines, tr.LogSource(redact_fields=("question",)))
    leaked = F.to_json(F.struct("raw", "attributes")).contains("secret") | F.coalesce(F.col("raw")["k"] != F.col("attributes")["k"], F.lit(False))
    return r.select("line_number", "valid", F.col("attributes")["question"].alias("question"), leaked.alias("leaked"), F.col("attributes")["k"].alias("k"), F.col("attributes")["questions"].alias("questions"))


@query("""WITH e AS (SELECT event_id, event_id % 8 AS k, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_id, CASE WHEN k IN (0, 2, 3) THEN (ms - 28800000) * 1000 WHEN k IN (1, 4) THEN ms * 1000 WHEN k = 5 THEN ms // 1000 * 1000000 END AS us, ['local_datetime', 'epoch_ms', 'iso8601_naive', 'rfc3339', 'rfc3339', 'epoch_s', NULL, NULL][k + 1] AS format FROM e""")
def log_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of every event, written in one of eight ways; a source's zone is eight hours ahead."""
    ts, ms, k = F.col("ts").cast("timestamp"), F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 8
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ways = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), ms.cast("string"), iso, F.concat(iso, F.lit("+08:00")), F.concat(iso, F.lit("Z")), F.floor(ms / 1000).cast("string"), F.lit("nonsense"), F.lit("")]
    rows = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*ways), k.cast("int")).alias("raw"))
    time, kind = tr.timestamps(F.col("raw"), "Asia/Shanghai")
    return rows.select("event_id", F.unix_micros(time).alias("us"), kind.alias("format"))


@query(f"WITH {SQL_LOG} SELECT request_id, request_type, epoch_us(coalesce(s, first_seen)) AS started_us, epoch_us(coalesce(e, last_seen)) AS ended_us, round(duration, 3) AS duration_ms, errors AS error_count, events AS event_count, stages AS stage_count FROM rt")
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tr.requests(records(spark, sf_dir))
    return r.select("request_id", "request_type", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), F.round("duration_ms", 3).alias("duration_ms"), "error_count", "event_count", "stage_count")


@query(ORACLES["request_summary"])
def stream_request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all events as a stream of several batches, out of order: the last summary told of each request."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = scratch(spark, "stream")
    for part in range(3):  # three batches, each with lines from everywhere
        log_lines(spark, sf_dir).filter(F.pmod(F.xxhash64("line_number"), F.lit(3)) == part).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("line string, line_number long").option("maxFilesPerTrigger", max(1, -(-len(spark.read.parquet(f"{at}/in").inputFiles()) // 3))).parquet(f"{at}/in")
    told = request_stream.summarised(tr.parse(stream, tr.LogSource("p", "s", "UTC", redact_fields=("question",))))
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    r = request_stream.latest(spark.read.parquet(f"{at}/out").drop("batch"))
    return r.select("request_id", "request_type", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), F.round("duration_ms", 3).alias("duration_ms"), "error_count", "event_count", "stage_count")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id DESC) AS k FROM events) WHERE k <= 50 GROUP BY user_id")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events rendered to sixteen log files; of each the last fifty lines, read from its end."""
    spark.dataSource.register(LogReplay)
    at = scratch(spark, "logs")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("log"), "event_id", F.to_json(F.struct("user_id", "event_id", "props")).alias("value"))
    e.repartition(16, "log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(f"{at}/text")
    last = spark.read.format("log_replay").options(path=f"{at}/text", lines="50").load().filter(F.col("log_path").endswith(".txt"))
    own = last.select(F.from_json("line", "user_id long, event_id long").alias("e")).select("e.*")
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(f"WITH {SQL_LOG} SELECT request_id, status, partial, status = 'failed' AS failed FROM rt")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.requests(records(spark, sf_dir)).select("request_id", "status", "partial", "failed")


@query("""WITH c AS (SELECT l_orderkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey AS request, round(greatest(0, o_totalprice / 100 - coalesce(s, 0)), 6) AS self_ms, s IS NULL AS is_leaf FROM orders LEFT JOIN c ON k = o_orderkey""")
def span_self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are parent spans, their lines are children."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.lit("o").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), (F.col("o_totalprice") / 100).alias("duration_ms"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("span_id"), F.lit("o").alias("parent_span_id"), F.col("l_quantity").alias("duration_ms"))
    return tr.self_times(o.unionByName(li), ["request"]).filter("span_id = 'o'").select("request", F.round("self_ms", 6).alias("self_ms"), "is_leaf")


@query("""SELECT l_orderkey AS request, l_linenumber AS line, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_shipdate, l_linenumber) AS place FROM lineitem) WHERE place <= 5""")
def top_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("line_number"), F.col("l_extendedprice").alias("self_ms"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_shipdate").alias("timestamp"))
    return tr.top_stages(li, ["request"]).select("request", F.col("line_number").alias("line"), F.col("place").cast("long").alias("place"))


@query("SELECT event_type AS stage, count(*) AS count, count(*) FILTER (event_type = 'error') AS error_count, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(max(value), 6) AS max_ms, epoch_us(max(ts)) AS last_us FROM events GROUP BY event_type")
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("self_ms"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(True).alias("is_leaf"))
    s = tr.stage_stats(e, ["stage"], error=F.col("stage") == "error")
    return s.select("stage", "count", "error_count", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p95_ms", "max_ms")], F.unix_micros("last_seen_at").alias("last_us"))


@query(f"WITH {SQL_LOG} SELECT event_id AS line_number, request_id, event, event AS message FROM ev WHERE kind = 'error'")
def error_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tr.errors(records(spark, sf_dir))
    return e.select("line_number", "request_id", "event", "message")


BAD = ["not-json #", "[1, #]", "", '{"event": "x", "level": "ERROR", "message": "boom"}', '{"span_name": "a.b", "event": "end", "status_code": "503", "trace_id": "t#"}']


@query("""WITH e AS (SELECT * FROM (VALUES (0, FALSE, 'invalid JSON', NULL, NULL, NULL), (1, FALSE, 'not a JSON object', NULL, NULL, NULL), (2, FALSE, 'empty line', NULL, NULL, NULL), (3, TRUE, NULL, 'x', NULL, NULL), (4, TRUE, NULL, 'end', '503', 'error')) t(form, valid, parse_error, event, status_code, status))
SELECT event_id AS n, valid, parse_error, event, status_code, status, CASE WHEN form = 4 THEN 't' || event_id END AS request_id FROM events JOIN e ON form = event_id % 5""")
def log_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every event: no JSON, no object, nothing, a record without a request, and one whose request is its trace."""
    line = F.replace(form_of("event_id", BAD), F.lit("#"), F.col("event_id").cast("string"))
    r = tr.parse(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_number"), line.alias("line")))
    return r.select(F.col("line_number").alias("n"), "valid", "parse_error", "event", F.col("status_code").cast("string").alias("status_code"), "status", "request_id")


@query(f"WITH {SQL_LOG} SELECT count(*) AS requests, count(*) FILTER (status = 'failed') AS failed_requests, count(*) FILTER (partial) AS partial_requests, round(quantile_cont(duration, 0.95), 3) AS p95_ms, (SELECT count(*) FROM ev WHERE kind = 'error') AS errors FROM rt")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return tr.overview(tr.requests(r), tr.errors(r)).select("requests", "failed_requests", "partial_requests", F.round("p95_ms", 3).alias("p95_ms"), "errors")


@query(f"WITH {SQL_LOG} SELECT request_id FROM rt WHERE status = 'failed' AND request_type = 'click'")
def request_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.filtered(tr.requests(records(spark, sf_dir)), {"status": "failed", "request_type": "click", "method": None}).select("request_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 DAY")
def lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    return tr.within(e, "2d", F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id")


@query("SELECT DISTINCT user_id || ':' || project AS project_id, status FROM events, (VALUES ('a', 'degraded'), ('b', 'idle'), ('c', 'stale'), ('d', 'error'), ('e', 'live'), ('f', 'offline')) t(project, status)")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six projects for every user, with sources seen so many seconds before the user's last event: lately, a while ago, long ago, never, missing, in error."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    source = lambda project, no, exists, ago, error: F.struct(F.lit(project).alias("project"), F.lit(no).alias("source_id"), F.lit(exists).alias("exists"), F.lit(ago).cast("long").alias("ago"), F.lit(error).cast("string").alias("last_error"))
    kinds = F.array(source("a", "1", True, 30, None), source("a", "2", False, None, None), source("b", "1", True, 210, None), source("c", "1", True, 86_430, None), source("d", "1", True, None, "boom"), source("e", "1", True, 30, None), source("f", "1", False, 5, None))
    s = last.select("user_id", "last", F.inline(kinds)).withColumns({"project_id": F.concat_ws(":", F.col("user_id").cast("string"), "project"), "last_seen_at": F.timestamp_micros(F.unix_micros("last") - F.col("ago") * 1_000_000)})
    return tr.health(s, F.col("last")).select("project_id", "status")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 5000")
def cache_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.capped(table(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp")), 5000, "event_id").select("event_id")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS largest FROM events GROUP BY ALL")
def stream_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted per hour and type until the stream is through."""
    at = scratch(spark, "stream")
    stream = jobs.from_parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.stage_counts(stream, "ts", "event_type", "value", late="60 days")
    sink: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        sink.append(f"{at}/out/batch={n}")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(sink[-1])  # in complete mode the last batch holds all
    return out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.round("total", 4).alias("total"), F.round("largest", 6).alias("largest"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a stream by user and type: per batch the last of each key, across batches the last again."""
    at = scratch(spark, "stream")
    stream = jobs.from_parquet(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    jobs.coalesced(stream, ["user_id", "event_type"], ["ts", "event_id"], lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint").awaitTermination()
    return jobs.latest_by_key(spark.read.parquet(f"{at}/out").drop("batch"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


SQL_STATE = """e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE event_type END AS kind FROM events),
g AS (SELECT request_id, min(ts) AS f, max(ts) AS l, count(*) AS event_count, count(*) FILTER (kind = 'error') AS error_count, bool_or(kind = 'start') AS s, bool_or(kind = 'end') AS e FROM e GROUP BY request_id)"""


@query(f"WITH {SQL_STATE} SELECT request_id, epoch_us(f) AS first_us, epoch_us(l) AS last_us, event_count, error_count, CASE WHEN error_count > 0 THEN 'failed' WHEN s AND e THEN 'ok' ELSE 'partial' END AS status FROM g WHERE e OR l <= (SELECT max(l) FROM g) - INTERVAL 40 MINUTE")
def stream_request_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests assembled from a stream: told when they end, or after 30 idle minutes behind a watermark of 10."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = scratch(spark, "stream")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").otherwise(F.col("event_type"))
    stream = jobs.from_parquet(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    jobs.run_to_table(jobs.assembled(stream), f"{at}/out", f"{at}/checkpoint")
    out = spark.read.parquet(f"{at}/out")
    return out.select("request_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "event_count", "error_count", "status")


@query("""WITH l AS (SELECT user_id, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY user_id), c AS (SELECT epoch_us(max(ts)) // 1000 AS now FROM events)
SELECT user_id, CASE WHEN now - last_ms <= 6 * 3600000 THEN 'live' WHEN now - last_ms <= 30 * 3600000 THEN 'idle' ELSE 'stale' END AS state, last_ms FROM l, c""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a source whose lines are its events, as a stream in the order of time; who has none for six hours is idle, for thirty stale. The
    clock is that of the events: at its end, the last one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = scratch(spark, "stream")
    e = table(spark, sf_dir, "events").select(F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    for part in range(4):  # files whose times follow one another, each a batch
        span = (last - first) // 4 + 1
        e.filter((F.unix_micros("ts") >= first + part * span) & (F.unix_micros("ts") < first + (part + 1) * span)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    told = health.watched(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "ts", timedelta(hours=6), timedelta(hours=30))
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return health.current(spark.read.parquet(f"{at}/out").drop("batch")).select(F.col("source_id").cast("long").alias("user_id"), "state", "last_ms")


@query("SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished FROM orders GROUP BY ROLLUP (o_orderpriority)")
def grouping_sets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the traces: a roll-up."""
    return table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"))
