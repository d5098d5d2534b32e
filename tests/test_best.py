"""What a task keeps of its rows: the best of each query, and no more, however many rows tie."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import best, lexical, semantic, vector_index


@pytest.mark.parametrize("kind", ["int", "text"])
def test_best_of_each_query(monkeypatch, kind):
    monkeypatch.setattr(best, "CELLS", 64)
    made = np.random.default_rng(3)
    values = made.integers(0, 12, (5, 400)) / 4 + made.random((5, 400)) * 1e-12  # many ties
    keys = [f"k{i * 7 % 400}" if kind == "text" else i * 7 % 400 for i in range(400)]
    b = best.Best(6, 5, least=0.5)
    for a in range(0, 400, 37):
        b.add(values[:, a : a + 37], pa.array(keys[a : a + 37]))
    got = next(b.batches([f"q{i}" for i in range(5)], "score")).to_pydict()
    want = [(f"q{q}", keys[i]) for q in range(5) for i in sorted(range(400), key=lambda i, q=q: (-round(values[q, i], 8), keys[i]))[:6]]
    assert list(zip(got["q"], got["k"], strict=True)) == want
    assert not list(best.Best(3, 2).batches(["a", "b"], "score"))


def test_bm25_sends_on_the_best_of_each_task(spark):
    """A thousand copies of a text and others, in four tasks: five rows of a query leave each, and they are the right ones."""
    made = random.Random(5)
    texts = ["alpha beta gamma"] * 1000 + [" ".join(made.choices(["alpha", "beta", "gamma", "delta", "other"], k=made.randint(0, 9))) for _ in range(400)]
    docs = spark.createDataFrame([(i, None if i % 9 else "beta", t) for i, t in enumerate(texts)], "doc_id long, title string, content string").repartition(4)
    queries = spark.createDataFrame([("a", "alpha beta alpha"), ("b", "delta"), ("c", ""), ("d", "nothing")], "q string, text string")
    fields = {"title": 2.5, "content": 1.5}
    words = {"alpha": 0, "beta": 1, "delta": 2}
    counted = lexical.counted_terms(docs, "doc_id", fields, list(words))
    assert counted.count() == 1400 and counted.agg(F.sum("n")).first()[0] == sum(len(t.split()) + (not i % 9) for i, t in enumerate(texts))
    parts = counted.rdd.getNumPartitions()
    some = lexical.best_scores(counted, [("a", "alpha"), ("a", "beta"), ("b", "delta")], np.ones(3), words, 3.0, 5, "string")
    assert some.count() <= 2 * 5 * parts

    tf = [(2.5 if not i % 9 else 0, t.split()) for i, t in enumerate(texts)]
    mean = sum(len(w) + (t > 0) for t, w in tf) / len(tf)
    f = lambda i, w: 1.5 * tf[i][1].count(w) + (tf[i][0] if w == "beta" else 0)
    own = {w: np.array([f(i, w) for i in range(len(tf))]) for w in words}
    n = np.array([len(w) + (t > 0) for t, w in tf])
    part = lambda w: max(np.log((len(tf) - (own[w] > 0).sum() + 0.5) / ((own[w] > 0).sum() + 0.5)), 1e-6) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * n / mean))
    got = lexical.bm25_topk(docs, queries, "doc_id", "q", "text", 5, fields).orderBy("q", "rank").collect()
    for q, terms in (("a", ["alpha", "beta"]), ("b", ["delta"])):
        want = sorted((-round(s, 8), i) for i, s in enumerate(sum(map(part, terms))) if s > 0)[:5]
        assert [(-round(r["score"], 8), r["doc_id"]) for r in got if r["q"] == q] == want
    assert {r["q"] for r in got} == {"a", "b"}


def test_equal_vectors_stay_in_their_task(spark):
    """Three thousand copies of a vector: of each task the five with the least keys, by the exact search and by lists."""
    rows = [(i, [1.0, 2.0] if i < 3000 else [-1.0, float(i % 7)]) for i in range(3500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 4.0])], "q string, embedding array<double>")
    lists = vector_index.centroids_of(v, "vec_id", 2)
    index = vector_index.assigned(v, lists, "vec_id")
    for near in (semantic.nearest_rows(v, q, "vec_id", "q", 5), vector_index.nearest_rows(index, lists, q, "vec_id", "q", 5, 2)):
        assert near.count() <= 2 * 5 * 3
    for hits in (semantic.knn_cosine(v, q, "vec_id", "q", 5), vector_index.search(index, lists, q, "vec_id", "q", 5, 1)):
        assert sorted((r["q"], r["rank"], r["vec_id"]) for r in hits.collect()) == [(x, i + 1, i) for x in "ab" for i in range(5)]
