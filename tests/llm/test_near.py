import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import order_minhash as om
from quillspark.llm.components import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def shingled(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(a, b):
    sa, sb = shingled(a), shingled(b)
    c = lcs(sa, sb)
    return c / (len(sa) + len(sb) - c) if sa and sb else 0.0


def ids(items):
    table = {}
    return np.array([table.setdefault(x, len(table) + 1) for x in items], np.uint64), table


@pytest.mark.parametrize("seed", range(60))
def test_similarity_is_the_alignment(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdefghij") if seed % 2 else f"w{rng.random()}" for _ in range(rng.randint(1, 90))]
    b = list(a)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(b) + 1)
        b[k : k + rng.randint(0, 2)] = [f"x{rng.random()}"] * rng.randint(0, 2)
    shingle_table = {}
    sa, sb = (np.array([shingle_table.setdefault(x, len(shingle_table) + 1) for x in shingled(t)], np.uint64) for t in (a, b))
    want = brute(a, b)
    got = om.similarity(sa, sb)
    assert (got >= 0.8) == (want >= 0.8 - 1e-9)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def brute_classes(texts):
    words = [t.split() if t else [] for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, w in enumerate(words):
        for s in set(shingled(w)):
            by[s].append(i)
    seen = set()
    for group in by.values():
        for x in group:
            for y in group:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    if brute(words[x], words[y]) >= 0.8:
                        root[max(find(x), find(y))] = min(find(x), find(y))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [5, 6])
def test_classes_against_all_pairs(spark, seed):
    texts = corpus(seed, 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in om.classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):  # near copies of one text, and chains away from it
        t = list(base)
        for k in range(i % 4):
            t[(i * 7 + k * 31) % 100] = f"x{rng.random()}"
        texts.append(" ".join(t))
    monkeypatch.setattr(om, "BLOCK_NODES", 16)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in om.classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("seed", range(100))
def test_aligned_in_a_band(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(1, rng.choice([2, 5, 40])) for _ in range(rng.randint(0, 60))] for _ in range(2))
    if seed % 2:
        b = a[rng.randint(0, 5) :] + b[:5]
    most = rng.randint(0, 70)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y and abs(i - j) <= most else max(row[j + 1], new[j]))
        row = new
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert om.aligned(a, b, most) >= row[-1] >= 0 and om.aligned(a, b, most) <= lcs(a, b)
    if most >= max(len(a), len(b)):
        assert om.aligned(a, b, most) == lcs(a, b) and head <= lcs(a, b)
    else:  # whatever alignment has few enough insertions and deletions lies in the band
        best = lcs(a, b)
        assert len(a) + len(b) - 2 * best > most or om.aligned(a, b, most) == best


def test_long_near_copies_in_bounded_memory():
    import resource

    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 60, 100_000).astype(np.uint64)
    other = words.copy()
    other[rng.integers(0, len(words), 1000)] = 7
    (sa, _), (sb, _) = (om.shingles(w, np.array([0, len(w)])) for w in (words, other))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert om.similarity(sa, sb) > 0.9
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
    ones = np.ones(50_000, np.uint64)
    assert om.similarity(ones, ones[:45_000]) == pytest.approx(0.9)


@pytest.mark.parametrize(("stalled", "seed"), [(-1, 1), (0.9, 2)])
def test_large_buckets_in_every_way(spark, monkeypatch, stalled, seed):
    """Near copies, chains, and texts with a long passage in common that are not similar enough."""
    rng = random.Random(seed)
    shared, base = [f"s{i}" for i in range(75)], [f"w{i}" for i in range(100)]
    texts = [" ".join(shared + [f"u{seed}-{i}-{k}" for k in range(22)]) for i in range(30)]
    for i in range(40):
        t = list(base)
        for k in range(i % 4):
            t[(i * 7 + k * 31) % 100] = f"x{rng.random()}"
        texts.append(" ".join(t))
    texts += [t + " end" for t in texts[:5]]
    monkeypatch.setattr(om, "STALLED", stalled)
    monkeypatch.setattr(om, "BLOCK_NODES", 16)
    monkeypatch.setattr(om, "SMALL_BUCKET", 2)
    monkeypatch.setattr(om, "PORTION", 5)
    monkeypatch.setattr(om, "BROADCAST_NODES", 10 if seed == 2 else 1000)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in om.classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


EDGES = [(1, None), (2, None), (3, ""), (4, ""), (5, " \n"), (6, "a b"), (7, "a b"), (7, "a b"), (8, "a c"), (None, "a b"), (9, "one " * 400), (10, "one " * 399), (11, "b a")]


def test_edges(spark):
    rows = spark.createDataFrame(EDGES, "doc_id long, text string")
    got = defaultdict(set)
    for r in om.classes(rows).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[1] == {1} and got[2] == {2} and got[3] == {3} and got[4] == {3} and got[5] == {5}
    assert got[6] == got[7] == got[None] == {6} and got[8] == {8} and got[11] == {11}
    assert got[9] == got[10] == {9}
    assert om.classes(rows.limit(0)).count() == 0


def test_deduplicated_keeps_one(spark):
    rows = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("class_id", F.lit("mine"))
    out = om.deduplicated(rows)
    assert out.columns == ["doc_id", "text", "fp", "class_id"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 5, 6, 8, 9, 11]
    again = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (1, "x y z")], "doc_id long, text string")
    assert om.deduplicated(again).count() == 1


def test_components_of_chains(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("zz", "zy"), ("a", "a")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "x string, y string")).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(41)) and got["zz"] == got["zy"] == "zy" and "a" not in got
    assert components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_recall_on_documents(spark, sf):
    """Pairs of different texts at 0.8 or more, found by an index of all shingles, against the classes; and no class holds texts that no chain of such pairs connects."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    got = {r["doc_id"]: r["class_id"] for r in om.classes(docs).collect()}
    rows = docs.collect()
    labelled = [x[1] for x in om.shingles_of(pa.array([r["text"] for r in rows]))]
    plain = [x[0] for x in om.shingles_of(pa.array([r["text"] for r in rows]))]
    size = [len(x) for x in labelled]
    row, which = np.repeat(np.arange(len(rows)), size), np.unique(np.concatenate(labelled), return_inverse=True)[1]
    order = np.argsort(which, kind="stable")
    common = defaultdict(int)
    for group in np.split(row[order], np.flatnonzero(np.diff(which[order])) + 1):
        for i, x in enumerate(group.tolist() if len(group) > 1 else ()):
            for y in group[i + 1 :].tolist():
                common[x, y] += 1
    pairs = [(x, y) for (x, y), c in common.items() if c >= 0.8 * (size[x] + size[y] - c) - 1e-9 and om.similarity(plain[x], plain[y]) >= 0.8]
    found = sum(got[rows[x]["doc_id"]] == got[rows[y]["doc_id"]] for x, y in pairs)
    print(f"recall: {found} of {len(pairs)} pairs")
    assert pairs and found >= 0.99 * len(pairs)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    assert len({got[r["doc_id"]] for r in rows if r["text"].split()}) >= len({find(i) for i, r in enumerate(rows) if r["text"].split()})
