import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import toxicity as tx
from quillspark.llm.letters import Table, grams, typed

STEMS, ENDS = ["vexal", "grumor", "spitek"], ["", "a", "en", "ished", "o", "um", "ix", "ant"]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["la", "ne", "ri", "to", "mu", "ka", "so", "be", "di", "po"]
    docs, labels = [], []
    for i in range(n):
        t = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(STEMS) + rng.choice(ENDS)
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 1)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = tx.score(d, tx.fit(d, lab.filter(~tx.held_out())), keep=["doc_id"]).join(lab, "doc_id").filter(tx.held_out()).toPandas()
    assert ((out["score"] >= 0.5) == (out["toxic"] == 1)).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_edges(spark):
    docs, labels = corpus(300, 2)
    d, lab = spark.createDataFrame([*docs, (9001, None), (9002, ""), (9003, "12 !? ..."), (9004, "z" * 100_000), (0, docs[0][1])], "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (7, None), (123456, 1)], "doc_id long, toxic int")
    model = tx.fit(d, lab)
    out = tx.score(d.withColumn("score", F.lit("mine")), model)
    got = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert len(got) == 305 and all(isinstance(s, float) and 0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i in (9001, 9002)}) == 1 and len({s for i, s in got if i == 0}) == 1
    assert tx.score(d.limit(0), model).count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.score(d, tx.fit(d, none)).collect()} == {0.0}
    assert {r["score"] for r in tx.score(d, tx.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).collect()} == {1.0}


def test_equal_classes_say_nothing():
    texts = ["banana bandana cabana", "band banner bandit banana"]
    counts = []
    for t in texts:
        _, _, _, which, letters, o = next(typed(pa.array([t])))
        key, _, kind = grams(letters, o)
        n = np.bincount(which, minlength=len(o) - 1)[kind]
        counts.append(dict(zip(key.tolist(), n.tolist(), strict=True)))
    keys = np.array(sorted(set(counts[0]) | set(counts[1])), np.uint64)
    model = tx.build(keys, tuple(np.array([c.get(int(k), 0) for k in keys]) for c in counts), lambda wanted: {int(x): 1 / 256 for x in wanted.view(np.int64)})
    value, found = model.ngram[6].get(np.array([int.from_bytes(b"banana", "big")], np.uint64))
    assert found[0] and np.isfinite(value[0])
    same = tx.build(keys, (np.ones(len(keys)), np.ones(len(keys))), lambda wanted: {int(x): 1 / 256 for x in wanted.view(np.int64)})
    assert all(np.allclose(t.values, 0) for t in same.ngram.values())  # equal classes say nothing


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    t = Table(keys, np.arange(len(keys)))
    value, found = t.get(keys)
    assert found.all() and (value == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(1, 1 << 62, 1000).astype(np.uint64), keys)
    assert not t.get(other)[1].any()


def test_no_entry_is_dropped():
    """The rarest n-grams of a large sample stay in the model."""
    n = 2_200_000
    keys = np.uint64(1 << 40) + np.arange(n, dtype=np.uint64) * np.uint64(7)
    toxic = np.where(np.arange(n) < 1000, 1, 0)
    model = tx.build(keys, (toxic, np.where(toxic, 0, 2)), lambda wanted: {int(x): 1 / 256 for x in wanted.view(np.int64)})
    value, found = model.ngram[6].get(keys[:1000])
    assert found.all() and (value > 0).all()
    assert model.ngram[6].get(keys[1000::100_000])[1].all()


class Plain:
    """Interpolated Kneser-Ney of one class, n-gram by n-gram, over dictionaries of byte strings."""

    def __init__(self, top, lowest):
        self.lowest, self.levels, upper = lowest, {}, {}
        for k in range(tx.ORDER, tx.SHARED, -1):
            level = {g: n for g, n in top.items() if len(g) == k}
            for g in upper:
                level[g[1:]] = level.get(g[1:], 0) + 1
            ones, twos = (sum(n == x for n in level.values()) for x in (1, 2))
            self.levels[k] = level, ones / (ones + 2 * twos) if ones and twos else 0.75
            upper = level

    def p(self, gram):
        if len(gram) == tx.SHARED:
            return self.lowest(gram)
        level, d = self.levels[len(gram)]
        same = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        low = self.p(gram[1:])
        return low if not same else max(level.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * low


def test_against_plain_kneser_ney():
    texts = ["banana bandana cabana nab", "band banner bandit banana ban"]
    tops = []
    for t in texts:
        top = {}
        for w in set(t.split()):
            b = f" {w} ".encode()
            for i in range(1, len(b)):
                g = b[max(0, i + 1 - tx.ORDER) : i + 1]
                top[g] = top.get(g, 0) + 1
        tops.append(top)
    lowest = lambda g: 1 / 256
    toxic, plain = (Plain(t, lowest) for t in tops)
    grams_ = sorted(set(tops[0]) | set(tops[1]))
    keys = np.array([int.from_bytes(g, "big") for g in grams_], np.uint64)
    order = np.argsort(keys)
    model = tx.build(keys[order], tuple(np.array([t.get(grams_[i], 0) for i in order]) for t in tops), lambda wanted: {int(x): 1 / 256 for x in wanted.view(np.int64)})
    for k in range(tx.SHARED + 1, tx.ORDER + 1):
        union = {g[-k:] for g in grams_ if len(g) >= k and (len(g) == k or len(g[-k:]) == k)}
        for g in union:
            value, found = model.ngram[k].get(np.array([int.from_bytes(g, "big")], np.uint64))
            assert found[0] and np.isclose(value[0], np.log(toxic.p(g)) - np.log(plain.p(g)), atol=1e-4), (g, value)
            for m in (toxic, plain):  # a distribution over the next byte
                assert np.isclose(sum(m.p(g[:-1] + bytes([c])) for c in range(256)), 1)


def test_difference_is_the_mean_of_the_words(spark):
    docs, labels = corpus(400, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = tx.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = docs[0][1]
    rows = spark.createDataFrame([(1, text), (2, text + " " + text), *[(10 + k, w) for k, w in enumerate(text.split())]], "doc_id long, text string")
    got = {r["doc_id"]: r["difference"] for r in tx.score(rows, model).collect()}
    each = [v for k, v in got.items() if k >= 10]
    assert np.isclose(got[1], np.mean(each), atol=1e-4) and np.isclose(got[1], got[2], atol=1e-4)
