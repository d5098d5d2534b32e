import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import sharding as sh


def place(*values):
    return int(hashlib.md5(":".join("" if v is None else str(v) for v in values).encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    """Splits a bucket bit by bit as long as it is above the limit and holds more than one row."""
    out = {}

    def split(items, depth):
        size = sum(b for _, _, b in items)
        if size <= limit or len(items) == 1 or depth == sh.HASH_BITS:
            for key, h, _ in items:
                out[key] = (format(h >> (sh.HASH_BITS - depth), f"0{depth}b") if depth else "", depth, size, len(items))
            return
        halves = defaultdict(list)
        for item in items:
            halves[item[1] >> (sh.HASH_BITS - depth - 1) & 1].append(item)
        for half in halves.values():
            split(half, depth + 1)

    split([(k, place(k, t), len((t or "").encode())) for k, t in rows], 0)
    return out


def test_against_recursion(spark):
    rows = [(i, "é" * (i * 37 % 90)) for i in range(400)] + [(1000, None), (1001, "")]
    got = {r["doc_id"]: (r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for r in sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=700).collect()}
    assert got == brute(rows, 700)


def test_deep_cells_get_more_bits(spark):
    rows = [(i, "x" * (1 if i % 50 else 3000)) for i in range(300)]
    got = {r["doc_id"]: (r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for r in sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=3000, step=1).collect()}
    assert got == brute(rows, 3000)


def test_equal_rows_overflow_into_parts(spark):
    rows = [(1, "x" * 10)] * 100 + [(2, "y")]
    out = sh.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=35).collect()
    assert len(out) == 101 and max(r["shard_bytes"] for r in out) <= 35
    sizes = defaultdict(int)
    for r in out:
        sizes[r["shard"]] += r["bytes"]
    assert all(sizes[r["shard"]] == r["shard_bytes"] for r in out)


def test_limits_hold_and_nothing_is_lost(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = sh.shard(d, limit=20_000)
    assert out.count() == d.count()
    assert out.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter("b > 20000 AND n > 1").count() == 0


def test_empty_clashing_and_one_shard(spark):
    d = spark.createDataFrame([(1, "a", "mine")], "doc_id long, text string, shard string")
    assert sh.shard(d.limit(0)).count() == 0
    assert sh.shard(d).first()["shard"] == ""


def test_native(spark):
    plan = sh.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_overflow_under_another_layout(spark):
    """Equal rows in many partitions, after a shuffle, keep their parts and are all there."""
    rows = spark.range(0, 5000, 1, 50).selectExpr("1L AS doc_id", "repeat('x', 100) AS text").repartition(23)
    out = sh.shard(rows, limit=1000)
    got = out.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("sb"), F.max("shard_rows").alias("sn")).collect()
    assert sum(r["n"] for r in got) == 5000 and all(r["b"] == r["sb"] <= 1000 and r["n"] == r["sn"] for r in got)


def test_one_very_long_text(spark):
    rows = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["bytes"], r["shard_rows"]) for r in sh.shard(rows, limit=1000).collect()}
    assert got[1] == (3_000_000, 1)


def test_large_directories_are_not_broadcast(spark, monkeypatch):
    """Also not by Spark's own choice, which goes by the size of their files; results are the same."""
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 5)) for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, sh.shard(docs, 100).drop("text").collect()))
    monkeypatch.setattr(sh, "BROADCAST_ENTRIES", 4)
    out = sh.shard(docs, 100).drop("text")
    assert sorted(map(tuple, out.collect())) == want
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
