"""Questions over a small library: what is found, held back, shown and cited."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import asking, semantic

TEXTS = {
    "redis": ("databases/redis.md", ["Redis keeps data in memory and writes snapshots to disk from time to time.", "A replica of Redis follows its primary and repeats every write in order.",
                                     "The append only file of Redis records each command before the answer goes out.", "Sentinel watches Redis primaries and promotes a replica when one is gone."]),
    "raft": ("consensus/raft.md", ["Raft elects a leader by randomised timeouts and majority votes.", "The leader of Raft replicates log entries and commits those that a majority holds.", "Snapshots of Raft cut the log when it has grown too long."]),
    "cooking": ("kitchen/bread.md", ["Bread dough rests for an hour in a warm place.", "An oven of two hundred degrees bakes bread in forty minutes."]),
}


@pytest.fixture(scope="module")
def asked(spark):
    rows = []
    for doc, (path, parts) in TEXTS.items():
        rows += [(f"{doc}:{i}", doc, doc, path, [doc.title()], i // 2, i, t, 2 * i + 1, 2 * i + 2) for i, t in enumerate(parts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document string, document_id string, file_path string, title_path array<string>, section_index int, chunk_index int, content string, start_line int, end_line int")
    chunks = chunks.withColumn("embedding", semantic.hash_embedding(F.col("content")))
    questions = [("1", "Redis replica follows primary write order", ["Redis replica follows primary write order", "Sentinel promotes a Redis replica"]), ("2", "quantum chromodynamics lattice gauge", ["quantum chromodynamics lattice gauge"]),
                 ("3", "Raft 分类 leader majority votes", ["raft 分类 leader majority votes"]), ("4", "Redis 相比 Raft 区别 snapshots", ["Redis 相比 Raft 区别 snapshots"]), ("5", "", [])]
    r = spark.createDataFrame(questions, "request string, question string, queries array<string>")
    return asking.ask(r, chunks)


def test_several_queries_find_and_merge(asked):
    by = {r["request"]: r["n"] for r in asked.queries.groupBy("request").agg(F.count("*").alias("n")).collect()}
    assert by["1"] >= 2 and "5" not in by and asked.counts["queries"] == sum(by.values())
    hits = {r["chunk_id"]: r["place"] for r in asked.hits.filter("request = '1'").collect()}
    assert hits["redis:1"] <= 2 and "redis:3" in hits  # each query's own best
    assert len(hits) == asked.hits.filter("request = '1'").count()  # once each


def test_constraints_hold(asked):
    assert {r["document"] for r in asked.hits.filter("request = '3'").collect()} == {"raft"}


def test_decisions(asked):
    d = {r["request"]: (r["abstained"], r["reason"]) for r in asked.decisions.collect()}
    assert not d["1"][0] and d["2"][0] and d["5"][0] and len(d) == 5
    prompts = {r["request"]: r["prompt"] for r in asked.prompts.collect()}
    assert prompts["2"] == prompts["5"] == "" and "A replica of Redis follows its primary" in prompts["1"]


def test_evidence_has_neighbours_and_citations_are_checked_on_it(asked, spark):
    e = {r["chunk_id"]: r for r in asked.evidence.filter("request = '1'").collect()}
    one = e["redis:1"]
    assert one["n_chunks"] == 3 and TEXTS["redis"][1][0] in one["content"] and one["start_line"] == 1
    said = "Redis keeps data in memory and writes snapshots to disk from time to time. [redis:1]"  # the neighbour's words, under the chunk that was shown with it
    answers = spark.createDataFrame([("1", said), ("3", "Bread dough rests for an hour in a warm place, they say. [redis:1]")], "request string, answer string")
    got = {r["request"]: r for r in asked.checked(answers).collect()}
    assert not got["1"]["unverified"] and got["1"]["matched_ids"] == ["redis:1"] and got["3"]["unverified"]


def test_counts_are_those_of_the_tables(asked):
    assert asked.counts["hits"] == asked.hits.count() and asked.counts["evidence"] == asked.evidence.count() and asked.counts["profiles"] == 5
    assert asked.counts["reranked"] >= asked.counts["hits"] > 0
