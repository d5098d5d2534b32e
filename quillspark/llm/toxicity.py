"""Toxicity by class-conditional Kneser-Ney models.

Both classes have an interpolated Kneser-Ney model of the letters of words (n-grams of up to ORDER bytes, inside one word and
its two borders, so that inflected or rare forms of an expression share its stem). Orders above SHARED are counted
per class, on labelled texts; orders up to SHARED are backoff counts that the classes share, gathered from all texts. A rare form
that neither class has seen therefore falls back to the same probability in both, and says nothing. A text's log-likelihoods,
toxic less ordinary, are normalised by its length: `difference` is that comparison unaided, per word. A logistic curve fitted on labelled
texts that the counts have not seen turns it, and the same comparison of the most toxic window and word, into a score. The models know letters
inside words; of an expression of several words they know its words, and the window that holds them together.

Bounds: SAMPLE labelled texts of each class give class counts, which reach the driver and every task as a table of their distinct n-grams;
a word counts once in a text, so the table grows with the vocabulary of the sample, not with the length of its texts.

Defined results: a null or empty text scores as a text without evidence; labels that contradict each other for one doc_id count as toxic,
null labels or ids are not used; of several texts with one labelled doc_id the least is learned from; without labels of both classes every
score is the share of toxic labels (0 without any) and every difference 0; rows that repeat are scored alike, equal scores stay equal; very long texts
are scored whole; an empty table gives an empty result. Columns named as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import ORDER, Table, below, grams, typed
from .text import bounded_batches, set_aside, written
from .tokens import U

SHARED = 3
WINDOW = 5

#: Labelled texts per class that the class counts and the curve are fitted on, the first ones by hash. All texts give shared counts.
SAMPLE = 100_000


@dataclass
class Model:
    """ngram[k], context[k]: log-likelihood ratios by n-gram of order k, and of backing off by its context."""

    ngram: dict[int, Table] = field(default_factory=dict)
    context: dict[int, Table] = field(default_factory=dict)
    weights: np.ndarray | None = None
    prior: float = 0.0

    def evidence(self, letters: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each type."""
        key, inside, kind = grams(letters, o)
        ratio = np.zeros(len(key), np.float32)
        for k in range(SHARED + 1, ORDER + 1):
            on = np.flatnonzero(inside >= k)
            q = below(key[on], k)
            value, found = self.ngram[k].get(q)
            back, _ = self.context[k].get(q >> U(8))
            ratio[on] = np.where(found, value, ratio[on] + back)
        return np.bincount(kind, ratio, len(o) - 1)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean evidence per word, mean evidence per word of the best window, the best word, log of length."""
        out = np.zeros((len(texts), 4))
        for at, end, offsets, which, letters, o in typed(texts):
            if not len(which):
                continue
            word = self.evidence(letters, o)[which]
            total = np.concatenate([[0.0], np.cumsum(word)])
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            first, last = offsets[:-1][full], offsets[1:][full]
            row = np.repeat(np.arange(len(full)), n[full])
            stop = np.minimum(np.arange(len(word)) + WINDOW, last[row])
            window = (total[stop] - total[:-1]) / WINDOW
            out[at + full, 0] = (total[last] - total[first]) / n[full]
            out[at + full, 1] = np.maximum.reduceat(window, first)
            out[at + full, 2] = np.maximum.reduceat(word, first)
            out[at + full, 3] = np.log1p(n[full])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))


def counts(docs: DataFrame, text: str, toxic: str) -> DataFrame:
    """key, t, o: the highest-order n-grams of the two classes with their counts. A word counts once in a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(toxic))
            for at, end, offsets, which, letters, o in typed(batch.column(text)):
                if not len(which):
                    continue
                row = np.repeat(np.arange(end - at), np.diff(offsets))
                pair = np.unique(row * len(o) + which)
                bad = label[at:end][pair // len(o)] == 1
                by_type = [np.bincount(pair[m] % len(o), minlength=len(o) - 1) for m in (bad, ~bad)]
                key, _, kind = grams(letters, o)
                unique, inverse = np.unique(key, return_inverse=True)
                t, n = (np.bincount(inverse, c[kind], len(unique)).astype(np.int64) for c in by_type)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(t), pa.array(n)], names=["key", "t", "o"])

    return docs.select(text, toxic).mapInArrow(run, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def shared_grams(docs: DataFrame, text: str) -> DataFrame:
    """The distinct n-grams of order SHARED + 1 of all texts (and shorter ones at the start of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, which, letters, o in typed(batch.column(text)):
                if len(which):
                    key, _, _ = grams(letters, o)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(below(key, SHARED + 1)).view(np.int64))], names=["key"])

    return docs.select(text).mapInArrow(run, "key long").distinct()


def shared_probabilities(docs: DataFrame, text: str, wanted: np.ndarray) -> dict[int, float]:
    """P(last byte | the bytes before) for the wanted n-grams of order SHARED, by continuation counts over all texts.

    Counted on the executors; only the wanted n-grams, which the class sample bounds, reach the driver.
    """
    spark, size = docs.sparkSession, 256**SHARED
    tri = written(shared_grams(docs, text).groupBy(F.expr(f"key & {size - 1}").alias("key")).agg(F.count("*").alias("n")), "toxic-shared")
    letter = {int(r["b"]): r["n"] for r in tri.groupBy(F.expr("key & 255").alias("b")).agg(F.count("*").alias("n")).collect()}  # 256 rows at most
    context = tri.groupBy(F.shiftright("key", 8).alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    ask = spark.createDataFrame(pd.DataFrame({"key": wanted.view(np.int64)}), "key long").withColumn("h", F.shiftright("key", 8))
    rows = ask.join(tri, "key", "left").join(context, "h", "left").select("key", "n", "total", "kinds").toPandas().fillna(0)
    low = rows["key"].to_numpy() & 255
    base = np.array([(letter.get(int(b), 0) + 0.5) for b in low]) / (sum(letter.values()) + 128)
    d, total = 0.75, rows["total"].to_numpy()
    p = np.where(total > 0, (np.maximum(rows["n"].to_numpy() - d, 0) + d * rows["kinds"].to_numpy() * base) / np.maximum(total, 1), base)
    return dict(zip(rows["key"].tolist(), p.tolist(), strict=True))


def _lookup(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def build(keys: np.ndarray, by_class: tuple[np.ndarray, np.ndarray], shared) -> Model:
    """The tables of both classes from their highest-order counts. shared: wanted n-grams -> their probabilities."""
    length = (np.floor(np.log2(np.maximum(keys, U(1)).astype(np.float64))) // 8).astype(int) + 1
    levels: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for c in by_class:
        level, upper = {}, None
        for k in range(ORDER, SHARED, -1):
            own = (length == k) & (c > 0)
            level_keys, n = keys[own], c[own].astype(float)
            if upper is not None:
                suffix, kinds = np.unique(below(upper, k), return_counts=True)
                level_keys, n = np.concatenate([level_keys, suffix]), np.concatenate([n, kinds])
            order = np.argsort(level_keys)
            level[k] = upper, _ = level_keys[order], n[order]
        levels.append(level)
    model, lower, union_below = Model(), None, None
    for k in range(SHARED + 1, ORDER + 1):
        union = np.unique(np.concatenate([lv[k][0] for lv in levels]))
        if k == SHARED + 1:
            wanted = np.unique(below(union, SHARED))
            p = shared(wanted)
            low = np.array([p[int(x)] for x in below(union, SHARED).view(np.int64)])
            lower = (low, low)
        else:
            lower = tuple(_lookup(union_below, x, below(union, k - 1)) for x in lower)
        contexts = np.unique(union >> U(8))
        now, back = [], []
        for (level_keys, n), low in zip((lv[k] for lv in levels), lower, strict=True):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            h, which = np.unique(level_keys >> U(8), return_inverse=True)
            total, kinds = np.bincount(which, n, len(h)), np.bincount(which, minlength=len(h))
            gamma = lambda q, h=h, total=total, kinds=kinds, d=d: np.where((t := _lookup(h, total, q)) > 0, d * _lookup(h, kinds, q) / np.maximum(t, 1), 1.0)
            t = _lookup(h, total, union >> U(8))
            now.append(np.maximum(_lookup(level_keys, n, union) - d, 0) / np.maximum(t, 1) + gamma(union >> U(8)) * low)
            back.append(np.log(np.maximum(gamma(contexts), 1e-9)))
        model.ngram[k] = Table(union, np.log(np.maximum(now[0], 1e-12)) - np.log(np.maximum(now[1], 1e-12)))
        model.context[k] = Table(contexts, back[0] - back[1])
        lower, union_below = tuple(now), union
    return model


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, lightly ridged, the classes weighed alike up to a factor of four."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def features(docs: DataFrame, model, text: str, names: list[str]) -> DataFrame:
    """names and x0..x3 of each row. model: a broadcast Model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(v) for v in x.T]], names=[*names, "x0", "x1", "x2", "x3"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], *[f"x{i} double" for i in range(4)]])
    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from labels (key, toxic): three quarters of the sample give class counts, one quarter the curve; all of docs
    give the shared counts. The model holds every n-gram of the sample, which alone bounds it, and is broadcast."""
    bounded_batches(docs.sparkSession)
    one = labels.filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("_r", F.xxhash64(F.lit(6), F.col(key)))
    picked = one.filter("toxic = 1").orderBy("_r", key).limit(sample).unionByName(one.filter("toxic = 0").orderBy("_r", key).limit(sample))
    picked = written(picked.withColumn("curve", F.pmod("_r", F.lit(4)) == 0).drop("_r"), "toxic-sample")
    there = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).join(F.broadcast(picked), key)
    there = written(there.groupBy(key, "toxic", "curve").agg(F.min("_text").alias("_text")), "toxic-texts")
    n = {bool(r["toxic"]): r["count"] for r in there.groupBy("toxic").count().collect()}
    prior = n.get(True, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({k: Table(np.zeros(0, U), np.zeros(0)) for k in range(SHARED + 1, ORDER + 1)}, {k: Table(np.zeros(0, U), np.zeros(0)) for k in range(SHARED + 1, ORDER + 1)}, None, prior)
    got = counts(there.filter("NOT curve"), "_text", "toxic").toPandas()
    model = build(got["key"].to_numpy().view(U), (got["t"].to_numpy(), got["o"].to_numpy()), lambda wanted: shared_probabilities(docs, text, wanted))
    model.prior = prior
    shared = docs.sparkSession.sparkContext.broadcast(model)
    x = features(there.filter("curve"), shared, "_text", ["toxic"]).toPandas()
    if x["toxic"].nunique() == 2:
        model.weights = curve(x[["x0", "x1", "x2", "x3"]].to_numpy(), x["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and difference (log-likelihoods per word, toxic less ordinary)."""
    bounded_batches(docs.sparkSession)
    names = keep or [c for c in docs.columns if c not in ("score", "difference")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(shared.value.scores(x)), pa.array(x[:, 0])], names=[*names, "score", "difference"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_text"))
    return kept.mapInArrow(run, ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], "score double, difference double"]))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the threshold, in the columns of docs, whatever these are called."""
    plain, back = set_aside(docs, text)
    return back(score(plain, model, text).filter(F.col("score") < threshold))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    out = score(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")
