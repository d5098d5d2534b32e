"""Streams end where a batch over the same rows ends."""

from pyspark.sql import functions as F

from quillspark.streaming import jobs
from quillspark.streaming.tail import LogTail


def drain(df, at):
    df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()


def test_tail_follows_appends_and_truncation(spark, tmp_path):
    spark.dataSource.register(LogTail)
    log, at = tmp_path / "a.log", tmp_path / "s"
    read = lambda: spark.readStream.format("log_tail").option("path", str(log)).load()

    def run():
        q = read().writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["line"] for r in spark.read.parquet(f"{at}/out").collect())

    log.write_bytes(b"one\ntwo\nhalf")
    assert run() == ["one", "two"]
    log.write_bytes(b"one\ntwo\nhalf done\nfour \xff\n")
    assert run() == ["four �", "half done", "one", "two"]
    log.write_bytes(b"new\n")
    assert run() == ["four �", "half done", "new", "one", "two"]


def test_requests_are_assembled(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "start"), ("a", "2024-01-01 00:01:00", "end"), ("b", "2024-01-01 00:00:00", "start"), ("b", "2024-01-01 00:02:00", "error"), ("z", "2024-01-02 00:00:00", "start")]
    src = spark.createDataFrame(rows, "request_id string, t string, kind string").select("request_id", F.to_timestamp("t").alias("ts"), "kind")
    src.write.parquet(f"{tmp_path}/in/1")
    src.limit(0).unionByName(spark.createDataFrame([("y", "2024-01-05 00:00:00", "start")], "request_id string, t string, kind string").select("request_id", F.to_timestamp("t").alias("ts"), "kind")).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    drain(jobs.assembled(stream), tmp_path)
    got = {r["request_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["a"]["status"] == "ok" and got["a"]["event_count"] == 2
    assert got["b"]["status"] == "failed" and got["b"]["error_count"] == 1


def test_envelopes(spark):
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "project string, n int")
    many = jobs.enveloped(rows, "overview", ["project"])
    assert many.first()["topic"] == "stream.batch" and jobs.unwrapped(many).count() == 2
    assert jobs.enveloped(rows.limit(1), "overview", ["project"]).first()["topic"] == "overview"
    sizes = [len(r["items"]) for r in jobs.enveloped(spark.range(40).selectExpr("cast(id AS string) AS project", "id AS n"), "overview", ["project"]).collect()]
    assert sum(sizes) == 40 and max(sizes) == 16
    bad = spark.createDataFrame([("x", ["{"]), ("x", None)], "topic string, items array<string>")
    assert jobs.unwrapped(bad).count() == 0


def test_a_range_in_blocks(spark, tmp_path):
    """Every size of a block gives every line once, wherever blocks cut lines."""
    from quillspark.streaming.tail import blocks, read_range

    data = b"one\r\n\n  \ntwo \xc3\xa9\n" + b"x" * 50 + b"\nlast\nrest without end"
    path = tmp_path / "a.log"
    path.write_bytes(data)
    whole = [("one", 0), ("two é", 9), ("x" * 50, 16), ("last", 67)]
    for start, lines in ((0, whole), (9, whole[1:])):
        for size in range(1, 90):
            got = [r for p in blocks(str(path), start, 72, size) for r in read_range(p)]
            assert [(text, at) for _, at, text in got] == lines, size


def test_replay_reads_the_end_alone(spark, tmp_path):
    from quillspark.streaming.tail import LogReplay

    spark.dataSource.register(LogReplay)
    texts = [f"line {i} " + "y" * (i % 37) for i in range(500)]
    (tmp_path / "a.log").write_text("\n".join(texts) + "\n")
    (tmp_path / "b.log").write_text("short\nunfinished")
    (tmp_path / "c.log").write_text("")

    def read(**options):
        rows = spark.read.format("log_replay").options(path=str(tmp_path), **{k: str(v) for k, v in options.items()}).load().collect()
        return [[r["line"] for r in sorted(rows, key=lambda r: r["byte_offset"]) if r["log_path"].endswith(f)] for f in ("a.log", "b.log")]

    for block in (7, 64, 1 << 20):
        assert read(lines=3, block=block) == [texts[-3:], ["short", "unfinished"]]
        assert read(lines=1, block=block) == [texts[-1:], ["unfinished"]]
        assert read(lines=10_000, block=block) == [texts, ["short", "unfinished"]]
        tail = len(texts[-1]) + len(texts[-2]) + 2
        assert read(bytes=tail, block=block) == [texts[-2:], ["short", "unfinished"]]
        assert read(bytes=tail - 1, block=block) == [texts[-1:], ["short", "unfinished"]]
        assert read(bytes=5, lines=9, block=block)[0] == []
    assert read(block=50)[0] == texts


def test_replay_looks_no_further_than_asked(tmp_path):
    from quillspark.streaming.tail import last_start

    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.read_bytes += n
            return self.data[self.at : self.at + n]

    source = Counted(b"0123456789\n" * 100_000)
    assert last_start(source, 1_100_000, 5, 1024) == 1_100_000 - 55 and source.read_bytes == 1024


def test_request_summaries_of_a_stream(spark, tmp_path):
    """Lines in many small files, late and out of order: the last telling of each request is what a batch over all of them gives."""
    import json

    from quillspark.operators import traces as tr
    from quillspark.streaming import requests as rq

    lines = []
    for i in range(240):
        request, k = f"r{i % 17}", i // 17
        event = ["http.request.start", "api.ask.end", "retrieve.end", "http.request.end", "api.ask.error", "note"][(i * 7 + k) % 6]
        value = {"timestamp": f"2024-01-0{1 + (i * 5) % 3} 10:00:{(i * 11) % 60:02d}.{i:03d}", "request_id": request, "event": event, "duration_ms": i % 50}
        if i % 9 == 0:
            value |= {"method": "GET", "path": f"/v1/x{i}", "status_code": 200 if i % 2 else 500, "summary": f"s{i}"}
        if i % 31 == 0:
            del value["timestamp"]
        lines.append((json.dumps(value), i))
    df = spark.createDataFrame(lines, "line string, line_number int")
    for part in (0, 2, 1):
        df.filter(f"line_number % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    parse = lambda rows: tr.parse(rows, tr.LogSource("p", "s", "UTC"))
    stream = spark.readStream.schema("line string, line_number int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = rq.summarised(parse(stream))

    def keep(batch, n):
        batch.write.mode("append").parquet(f"{tmp_path}/out")

    told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.agg({"told": "max"}).first()[0] > 1
    want = tr.requests(parse(df))
    assert sorted(map(tuple, rq.latest(out).select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_request_summaries_without_idle_need_no_python_state(spark, tmp_path):
    """Spark's own aggregation keeps what is never let go of; a processor in Python that lets go sends two messages for a request."""
    from datetime import timedelta

    from pyspark.sql import Row

    from quillspark.operators import traces as tr
    from quillspark.streaming import requests as rq

    stream = tr.parse(spark.readStream.schema("line string, line_number int").parquet(str(tmp_path)), tr.LogSource("p", "s", "UTC"))
    plan = lambda **o: rq.summarised(stream, **o)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan() and "TransformWithState" in plan(idle=timedelta(hours=1))
    handle, p = Counted(), rq.Summary(1000)
    p.init(handle)
    row = lambda o, us, **k: Row(**{"ord": o, "us": us, "duration_ms": 1.0, "event_type": "end", "status": "ok", "source_id": "s", **dict.fromkeys(rq.KINDS), **dict.fromkeys(("is_start", "is_terminal", "is_error", "is_stage"), False), **k})
    (first,) = p.handleInputRows(("=p", "r"), iter([row("b", 2, path="/b"), row("c", 3, is_terminal=True)]), None)
    assert handle.calls == 2 and (first["path"], first["s"], first["told"]) == (("b", "/b"), None, 1)
    (again,) = p.handleInputRows(("=p", "r"), iter([row("a", 1, path="/a", is_start=True)]), None)
    assert handle.calls == 4 and (again["path"], again["first_us"], again["last_us"], again["event_count"], again["told"]) == (("a", "/a"), 1, 3, 3, 2)
    assert again["s"][0] == "a" and again["e"][0] == "c"


def test_order_texts_sort_like_orders(spark):
    from quillspark.streaming.requests import order_text

    rows = spark.sql("""SELECT struct(t IS NULL AS late, t, line, seq) AS o FROM (SELECT explode(array(timestamp'1600-01-01 00:00:00', timestamp'1969-12-31 23:59:59.999999', timestamp'2024-01-01 00:00:00', null)) AS t),
        (SELECT explode(array(0L, 9L, 10L, 9223372036854775807L)) AS line), (SELECT explode(array(0L, 2L)) AS seq)""")
    by = lambda *c: [r["o"] for r in rows.select("o", order_text(F.col("o")).alias("x")).orderBy(*c).collect()]
    assert by("o.late", "o.t", "o.line", "o.seq") == by("x")


def test_sources_go_quiet_by_the_machines_clock(spark, tmp_path):
    """No line after the first ones: idle, then stale, by timers alone; a line makes one live again."""
    import time
    from datetime import timedelta

    from quillspark.streaming import health

    rows = spark.createDataFrame([("p", "a"), ("p", "b"), (None, None)], "project_id string, source_id string").withColumn("ts", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    told = health.watched(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", timedelta(seconds=3), timedelta(seconds=8), late=None)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    q = told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        out = lambda: spark.read.parquet(f"{tmp_path}/out").drop("batch")
        until = time.time() + 90
        while time.time() < until and (not q.recentProgress or out().filter("state = 'stale'").count() < 3):
            time.sleep(2)
        for who in out().select("source_id").distinct().collect():
            assert [r["state"] for r in out().filter(F.col("source_id") == who["source_id"]).orderBy("told").collect()] == ["live", "idle", "stale"]
        rows.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
        until = time.time() + 60
        while time.time() < until and out().filter("told = 4").count() < 1:
            time.sleep(2)
        again = out().filter("told = 4").first()
        assert again["state"] == "live" and health.current(out()).count() == 3
    finally:
        q.stop()


class Counted:
    """A handle of state that counts the messages it would send."""

    def __init__(self, value=None):
        self.value, self.calls, self.timers = value, 0, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    exists = get

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_few_messages_for_a_request():
    """Three for a new request; a known one has one timer, at its last time."""
    from pyspark.sql import Row

    handle, p = Counted(), jobs.RequestAssembler(1000)
    p.init(handle)
    row = lambda us, kind: Row(us=us, kind=kind)
    assert not list(p.handleInputRows(("a",), iter([row(5_000_000, "start"), row(3_000_000, "error")]), None))
    assert handle.calls == 3 and handle.timers == {6000}
    assert not list(p.handleInputRows(("a",), iter([row(4_000_000, "view")]), None)) and handle.timers == {6000}
    told = list(p.handleInputRows(("a",), iter([row(9_000_000, "end")]), None))
    assert handle.timers == {10_000} and [tuple(t) for t in told] == [("a", 3_000_000, 9_000_000, 4, 1, "failed")]
    assert not list(p.handleInputRows(("a",), iter([row(9_500_000, "end")]), None))
