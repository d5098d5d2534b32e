import itertools
import random
import re

import pytest

from quillspark.llm import decontamination as dc


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for i, item in items:
        v = words(item)
        if len(v) < dc.SHORTEST:
            continue
        w = min(dc.WINDOW, len(v))
        for d, text in docs:
            t = words(text)
            for a in range(len(v) - w + 1):
                if any(sum(x == y for x, y in zip(v[a : a + w], t[b : b + w], strict=True)) >= dc.LEAST * w - 1e-9 for b in range(len(t) - w + 1)):
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 15, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 2:
            p = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(p) // 4))):
                p[rng.randrange(len(p))] = rng.choice(vocabulary)
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
        docs.append((d, " ".join(t)))
    got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute(docs, items)
    assert got.count() == got.select("doc_id", "item_id").distinct().count()


def test_masks_leave_no_pattern():
    """Every way to substitute a fifth of 15 or 20 words leaves some mask a place where it lies on equal words."""
    for n, k in ((15, 3), (20, 4)):
        for gone in itertools.combinations(range(n), k):
            ok = any(all(m == "0" or a + j not in gone for j, m in enumerate(mask)) for mask in dc.MASKS for a in range(n - len(mask) + 1))
            assert ok, gone


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_edges(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "too short to count"), (1, PASSAGE)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 5000 + PASSAGE.upper() + "!"), (3, PASSAGE.replace(" ", ", ")), (None, PASSAGE), (4, "too short to count")], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["first_word"]) for r in dc.overlaps(docs, items).collect()]
    assert sorted(got, key=repr) == sorted([(3, 1, 5000), (3, 1, 5000), (3, 1, 0), (3, 1, 0), (None, 1, 0), (None, 1, 0)], key=repr)
    assert dc.overlaps(docs.limit(0), items).count() == 0 and dc.overlaps(docs, items.limit(0)).count() == 0
    kept = dc.decontaminated(docs, items)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, None), (2, ""), (4, "too short to count")] or kept.count() == 3


def test_blocks_are_the_whole(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(30)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "text")
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]) for r in dc.overlaps(docs, items).collect()} == {(i, i) for i in range(30)}
    assert dc.decontaminated(docs, items).count() == 0


@pytest.mark.parametrize("n", range(8, dc.WINDOW + 1))
def test_masks_of_every_length(n):
    most = n - int(-(-(dc.LEAST * n - 1e-9) // 1))
    for gone in itertools.combinations(range(n), most):
        assert any(all(m == "0" or a + j not in gone for j, m in enumerate(mask)) for mask in dc.masks_of(n) for a in range(n - len(mask) + 1)), gone


def test_short_items_and_unspaced_scripts(spark, tmp_path):
    chinese = "机器学习模型在训练数据中看到了考试的题目和答案"
    items = [(1, "yes"), (2, "two words"), (3, "one two three four five"), (4, "a b c d e f g"), (5, chinese), (6, "!"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (8, "МОСКВА это столица России и самый большой город")]
    docs = [(1, "Yes!"), (2, "say two, words"), (3, "one two three four 5"), (4, "x A b c d e f G x"), (5, "以前说过：「" + chinese.replace("考", "测") + "」。"), (6, "words two"), (7, "w1 w2 w3 X w5 X w7 w8 w9 w10"), (8, "«москва» это столица россии — и самый большой город"), (9, None), (10, "!")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r["doc_id"], r["item_id"]) for r in dc.op7_spaced_seeds(spark, str(tmp_path)).collect()} == {(k, k) for k in (1, 2, 4, 5, 7, 8)}
    assert {r["doc_id"] for r in dc.decontaminated(d, i, exact_short=True).collect()} == {3, 6, 9, 10}


@pytest.mark.parametrize("n", range(8, 21))
def test_lengths_against_all_windows(n):
    """Every item length, with as many words substituted as count, at all places: one block finds each."""
    import pyarrow as pa

    item = [f"w{i}" for i in range(n)]
    most = n - int(-(-(dc.LEAST * n - 1e-9) // 1))
    texts = []
    for gone in itertools.combinations(range(n), most):
        texts.append(" ".join(["left"] * 3 + ["other" if i in gone else w for i, w in enumerate(item)] + ["right"]))
    found = {int(r) for row, *_ in dc.Block([1], [" ".join(item)]).search(pa.array(texts)) for r in row}
    assert found == set(range(len(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_join_is_the_block(spark, monkeypatch, seed):
    """The same rows, with the same best windows, by seed tables as by one block; hot seeds, repeated and long texts and odd columns included."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 8, 9, 10, 11, 12, 15, 20, 21, 40, 200])))) for i in range(25)]
    items += [(99, None), (98, ""), (97, items[0][1]), (96, "机器学习模型在训练数据中看到了考试的题目")]
    docs = []
    for d in range(80):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 2:
            p = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(p) // 4))):
                if p:
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
        docs.append((d, " ".join(t)))
    docs += [docs[1], docs[1], (500, None), (501, "x " * 30_000 + items[3][1]), (None, items[5][1]), (502, "说机器学习模型在训练数据中看到了考试的题目。")]
    d = spark.createDataFrame([(*x, "mine", 1) for x in docs], "doc_id long, text string, item string, h long")
    i = spark.createDataFrame([(*x, "mine", 1) for x in items], "item_id long, text string, doc string, n long")
    by_block = dc.overlaps(d, i, exact_short=True).collect()
    kept = dc.decontaminated(d, i, exact_short=True).collect()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 10)
    monkeypatch.setattr(dc, "PORTION", 3)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0 if seed == 2 else 1000)
    assert sorted(dc.overlaps(d, i, exact_short=True).collect(), key=repr) == sorted(by_block, key=repr) and by_block
    assert sorted(dc.decontaminated(d, i, exact_short=True).collect(), key=repr) == sorted(kept, key=repr)
    assert dc.overlaps(d.limit(0), i).count() == 0


MEMORY = """
import resource, sys
import pyarrow as pa
from quillspark.llm import decontamination as dc
{code}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("code", [
    "found = [x for r in dc.Block([1], ['the ' * 1000]).search(pa.array(['the ' * 20_000])) for x in zip(*r)]; assert [tuple(map(int, x)) for x in found] == [(0, 0, 0, 20, 20)], found",
    "found = [x for r in dc.Block([1], ['a b c d ' * 3000]).search(pa.array(['b c d a ' * 30_000])) for x in zip(*r)]; assert [tuple(map(int, x)) for x in found] == [(0, 0, 0, 20, 20)], found",
    "items = [' '.join(f'i{i}w{k}' for k in range(25)) for i in range(400)] + [' '.join(f'x{k}' for k in range(50_000))]; found = sorted(int(i) for r in dc.Block(list(range(401)), items).search(pa.array([' '.join(items[3:6]), items[400]])) for i in r[1]); assert found == [3, 4, 5, 400], found",
])
def test_repeated_words_and_long_items_need_little_memory(code):
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", MEMORY.format(code=code)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500, out.stdout


def test_repeated_words_by_the_join(spark, monkeypatch):
    """Few words over and over: rows and windows as the block has them, and few rows meet."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([8, 12, 20, 60])))) for i in range(6)] + [(90, "the " * 300), (91, "a b " * 50)]
    docs = [(d, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 80)))) for d in range(30)] + [(90, "the " * 2000), (91, "b a " * 900), (92, "the " * 7)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    by_block = dc.overlaps(d, i).collect()
    assert {(r["doc_id"], r["item_id"]) for r in by_block} == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 10)
    assert sorted(dc.overlaps(d, i).collect(), key=repr) == sorted(by_block, key=repr)
