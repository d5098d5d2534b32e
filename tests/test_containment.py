"""Passages in texts, against looking everywhere."""

import random

import pytest

from quillspark.operators.containment import SHORTEST, containment, fingerprints


def brute(docs, items):
    return sorted((i, d) for i, p in items if p for d, t in docs if t and p in t)


def found(spark, docs, items):
    out = containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "case_id long, passage string"), "doc_id", "text", "case_id", "passage")
    return sorted((r["case_id"], r["doc_id"]) for r in out.collect())


def test_against_looking_everywhere(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "é", "文字", "gamma", "x", "a b", "the", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 80))) for i in range(150)] + [(900, None), (901, ""), (902, "x" * 5000), (903, "the " * 4000)]
    items = []
    for i in range(120):
        t = rng.choice(docs[:150])[1]
        a = rng.randrange(0, max(1, len(t)))
        items.append((i, t[a : a + rng.choice([1, 2, 3, 8, 20, 31, 32, 60, 200])]))
    items += [(500, None), (501, ""), (502, "not in any of the texts at all, surely not"), (503, "zz"), (504, "x" * SHORTEST), (505, "the " * 100), (506, "the " * 100)]
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("extra", [0, 1, 15, 16, 40])
def test_passages_of_every_offset(spark, extra):
    rng = random.Random(extra)
    text = "".join(rng.choice("abcdefgh") for _ in range(130))
    n = SHORTEST + extra
    items = [(a, text[a : a + n]) for a in range(len(text) - n + 1)]
    assert found(spark, [(1, "z" + text + "z"), (2, text[1:]), (3, text[:-1])], items) == brute([(1, "z" + text + "z"), (2, text[1:]), (3, text[:-1])], items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a passage of more than thirty-one bytes")]) == [] and found(spark, [(1, "text")], []) == []


def test_fingerprints_are_few(spark):
    df = spark.createDataFrame([(1, "".join(random.Random(1).choice("abcdefghij ") for _ in range(100_000)))], "k long, t string")
    assert fingerprints(df, "k", "t").count() < 100_000 / 7
