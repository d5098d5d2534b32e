"""Runs against a search of all periods word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import periodic
from quillspark.llm.periodic import of_texts, op12_periodic_runs, periodic_runs, repeating, runs_of


def brute(words):
    """Every period by every place; the smallest period of a stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def row_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def got_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from("ab"), st.sampled_from("abcde")), max_size=70), min_size=1, max_size=6))
def test_small_alphabets(texts):
    got = list(of_texts([" ".join(t).encode() for t in texts]))
    for words, (runs, collapsed, n) in zip(texts, got, strict=True):
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want and n == len(words)
        assert collapsed.decode() == collapse(words, want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=8), st.integers(1, 40))
def test_powers_in_blocks(parts, points):
    words = [w for block, k in parts for w in block * k]
    old, periodic.POINTS = periodic.POINTS, points  # grids in many blocks
    try:
        (runs, _, _), = of_texts([" ".join(words).encode()])
    finally:
        periodic.POINTS = old
    assert [(r["start"], r["length"], r["period"]) for r in runs] == brute(words)


def test_hashes_that_lie_are_found_out():
    rng = random.Random(5)
    texts = [[rng.choice("abcdef") for _ in range(60)] for _ in range(20)] + [list("abc" * 9)]
    ids = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, start, length, period = runs_of(ids, offsets, np.ones(len(ids), np.uint64))
    got = [[] for _ in texts]
    for k, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[k].append(tuple(run))
    assert got == [brute(t) for t in texts]


def test_long_texts():
    rng = random.Random(3)
    the = ["the"] * 20_000
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 3_000:
        fib.append(f"{fib[-1]} {fib[-2]}")
    block = [str(rng.random()) for _ in range(5_000)]
    for words, want in ((the, [(0, 20_000, 1)]), (block * 4 + block[:7], [(0, 20_007, 5_000)]), (fib[-1].split(), None)):
        (runs, _, _), = of_texts([" ".join(words).encode()])
        assert [(r["start"], r["length"], r["period"]) for r in runs] == (brute(words) if want is None else want)


def test_odd_rows(spark):
    docs = [(None, None, "x"), (1, "", "x"), (2, " \t\n\x0b\x0c\r ", "x"), (3, "a " * 7, "x"), (3, "a " * 7, "x"), (4, "a a a a a", "x"), (5, "é文 " * 8 + "é", "x"), (None, "b b b b b b", "x"), (10**12, "a b " * 40, "x")]
    docs += [(i, " ".join(f"w{k % 7}" for k in range(i % 90)), "x") for i in range(100, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, runs string")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"] and out.count() == len(docs)
    assert periodic_runs(df.limit(0)).count() == 0
    changed = repeating(df.select("doc_id", "text"))
    assert changed.count() == len(docs) and sum(a["text"] != b[1] for a, b in zip(changed.collect(), docs, strict=True)) > 10
    from unittest.mock import patch

    with patch.object(periodic, "read_table", lambda *_: df):
        got = got_rows(op12_periodic_runs(spark, ""))
    assert got == sorted((row_of(i, t) for i, t, _ in docs), key=repr)


def test_table(spark, sf):
    want = sorted((row_of(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"]) < 4_000), key=repr)
    keys = {w[0] for w in want}
    got = got_rows(op12_periodic_runs(spark, sf))
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and [g for g in got if g[0] in keys] == want
