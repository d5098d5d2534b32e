"""Shares, distances and ranks against plain counting, and tries against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.divergence import CUT, OP13_SQL, Counts, divergence, op13_divergence, share, terms

from ..compare import assert_same, connection


def plain(rows, least=30, top=50):
    docs = [(la or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        having = Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w in having if having[w] >= least]
        counts = {s: Counter() for _, s, _ in own}
        for _, s, ws in own:
            counts[s].update(w for w in ws if having[w] >= least)
        part = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: part(c) for s, c in counts.items()}, part(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in p if o != s]
            words = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for name, items, most in (("pair", pairs, 10**9), ("term", words, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, name, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def sample(seed, n, sources=7):
    rng = random.Random(seed)
    words = ["the", "The", "ab", "abc", "abd", "a", "é", "Éa", "文", "文字", "\U0001f600", "ａ", "z-y", "x1y", "_q_", "İ"] + [f"w{chr(97 + i)}" for i in range(26)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    return [(rng.choice([None, "", text(), text(), text()]), rng.choice(["en", "de", None, ""]), rng.choice([None, "", *[f"s{i}" for i in range(sources)]])) for _ in range(n)]


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("sizes", [{}, {"buffer": 20, "strip": 3, "shares": 40}])
def test_rows_against_plain_counting(spark, sizes):
    docs = sample(1, 900)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert got(divergence(df, **sizes)) == plain(docs)
    assert got(divergence(df, least=2, top=3, **sizes)) == plain(docs, 2, 3)


def test_ranks_with_ties(spark):
    """Many terms of one frequency: their order is that of their bytes, also beyond the basic plane."""
    words = [chr(c) for c in (*range(0x61, 0x7B), *range(0x3B1, 0x3C9), 0xFF41, 0xFF42, 0x1F600, 0x1F601, 0xE000)]
    docs = [(" ".join(words), "en", "a")] * 30 + [("b " * 9, "en", "b"), ("", "en", "c")]
    want = plain(docs)
    assert got(divergence(spark.createDataFrame(docs, SCHEMA))) == want and sum(r[2] == "term" for r in want) > 50


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert divergence(df).collect() == [] and divergence(df).columns == ["lang", "source", "part", "item", "value", "rank"]
    few = [("a b", "en", "x"), (None, "en", "y"), ("", None, None), ("q " * 100_000, "de", "z")]
    assert got(divergence(spark.createDataFrame(few, SCHEMA))) == plain(few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    twice = [("a b a", "en", "x"), ("a c", "en", "y")] * 40
    more = spark.createDataFrame([(*r, 1, "t", 2) for r in twice], f"{SCHEMA}, rank int, term string, range int")
    assert got(divergence(more)) == plain(twice)


def test_registered_query(spark, sf):
    assert_same(op13_divergence(spark, sf), connection(sf), OP13_SQL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abé文", min_size=1, max_size=6), st.sampled_from("xyz")), max_size=40), max_size=4))
def test_tries(parts):
    """Merged tries hold what was counted, and are walked in the order of bytes."""
    whole, want, texts = Counts(), Counter(), Counter()
    for part in parts:
        by_source = {s: Counter(t.encode() for t, x in part if x == s) for s in sorted({x for _, x in part})}
        own = Counter(t.encode() for t, _ in part)
        whole.merge(Counts(own, by_source))
        want.update((t.encode(), s) for t, s in part)
        texts.update(own)
    walked = list(whole.trie.walk())
    assert [t for t, _ in walked] == sorted(texts)
    term = {k: t for t, k in walked}
    assert {(term[k], whole.sources[s]): n for k, s, n in whole.cells.T.tolist()} == want
    assert {term[k]: n for k, n in enumerate(whole.texts.tolist())} == texts
    rows = [r for b in whole.serial("en", 3) for r in b.to_pylist()]
    assert [(r["term"].encode(), r["texts"], {x["source"]: x["n"] for x in r["leaves"]}) for r in rows] == [(t, texts[t], {s: n for (u, s), n in want.items() if u == t}) for t in sorted(texts)]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 9 * 10**15), st.integers(1, 9 * 10**15))
def test_shares_are_exact(count, whole):
    count = min(count, whole)
    assert int(share(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * count // whole


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_terms(text):
    assert [t.decode() for own in terms(text.encode()) for t in own] == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]


def test_terms_of_long_texts_are_cut_between_terms():
    text = "Abc " * (CUT // 2) + "é" * CUT + " end"
    assert [t.decode() for own in terms(text.encode()) for t in own] == ["abc"] * (CUT // 2) + ["é" * CUT, "end"] and sum(1 for _ in terms(text.encode())) >= 3
