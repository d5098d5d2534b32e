import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.mixing import fit, mix, mixed, targets


@pytest.mark.parametrize("seed", range(40))
def test_fit_is_nearest(seed):
    """Against all subsets of a small set of documents, and never more of a length than there are."""
    rng = random.Random(seed)
    docs = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
    lengths, counts = np.unique(docs, return_counts=True)
    budget = rng.randint(0, sum(docs) + 5)
    taken = fit(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    best = min(abs(sum(c) - budget) for k in range(len(docs) + 1) for c in itertools.combinations(docs, k))
    assert abs(int((taken * lengths).sum()) - budget) == best


def test_fit_hits_large_budgets():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(1, 3000, 20_000), return_counts=True)
    budget = int((lengths * counts).sum() * 0.37)
    assert int((fit(lengths, counts, budget) * lengths).sum()) == budget


def test_targets_share_the_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 1000)]
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 30.0  # at three times its size
    left = 3010 - 30.0
    assert got["b"] == pytest.approx(left * 2 / 8) and got["c"] == pytest.approx(left * 1 / 8) and got[None] == pytest.approx(left * 5 / 8)
    assert sum(got.values()) == pytest.approx(3010)


DOCS = [(1, "s", "a b c"), (2, "s", "a b"), (2, "s", "a b"), (None, "s", "x"), (3, None, "one two three four"), (4, None, None), (5, "t", ""), (6, "t", "w " * 50), (7, "u", "z")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, text string")


def test_edges(spark):
    out = mix(docs(spark)).collect()
    assert len(out) == len(DOCS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (4, 5)} == {0}
    assert sum(r["size"] for r in out) == 3 + 2 + 2 + 1 + 4 + 50 + 1


def test_reruns_and_layout_agree(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    a = {(r["doc_id"], r["taken"]) for r in mix(d).collect()}
    b = {(r["doc_id"], r["taken"]) for r in mix(d.repartition(7, "text").orderBy(F.rand(3))).collect()}
    assert a == b


def test_sources_come_near_their_targets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    by = mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(25, r["shortest"]) for r in by)


def test_empty_and_clashing_columns(spark):
    d = docs(spark)
    assert mix(d.limit(0)).count() == 0
    odd = d.withColumn("taken", F.lit("mine")).withColumn("size", F.lit("mine"))
    assert dict(mix(odd).dtypes)["taken"] == "bigint"
    assert mixed(odd).columns == odd.columns and {(r["taken"], r["size"]) for r in mixed(odd).collect()} == {("mine", "mine")}


def test_mixed_repeats(spark):
    out = mixed(docs(spark)).groupBy("doc_id").count().collect()
    n = {r["doc_id"]: r["count"] for r in out}
    assert n[4] == 1 and n[5] == 1 and n[7] <= 3


def test_repeated_rows_and_one_hot_length(spark):
    """A third of all rows are one row; another third has one length: the same totals as without hashes, and no row is lost."""
    rows = spark.createDataFrame([(i, "a", "one two three") for i in range(300)] + [(7, "a", "four five six")] * 300 + [(i, "b", "x " * (i % 9)) for i in range(300)] + [(1, "c", "long " * 200_000)], "doc_id long, source string, text string")
    for d in (rows, rows.repartition(13)):
        out = mix(d)
        assert out.count() == 901
        by = {r["source"]: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect()}
        assert all(abs(by[s]["taken"] - by[s]["target"]) <= 3 for s in "ab") and all(r["most"] <= 3 for r in by.values())
    a, b = ([(r["doc_id"], r["taken"]) for r in mix(d).filter("doc_id <> 7 OR source <> 'a'").collect()] for d in (rows, rows.repartition(13)))
    assert sorted(a) == sorted(b)


def test_against_a_plain_choice(spark, sf, monkeypatch):
    """The chosen documents are the first by bucket and hash of every source and length, as many as the plan says; both joins agree."""
    from quillspark.llm import mixing as mx

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.substring("text", 1, 120).alias("text"))
    rows = mix(d).withColumn("hash", F.xxhash64(F.lit(20), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["source"], r["size"]), []).append((r["hash"] % mx.BUCKETS, r["hash"], r["copies"]))
    for g in groups.values():
        copies = [c for *_, c in sorted(g)]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1
    monkeypatch.setattr(mx, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["copies"]) for r in mix(d).collect()} == {(r["doc_id"], r["copies"]) for r in rows}
