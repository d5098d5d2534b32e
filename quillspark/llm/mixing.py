"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget in words. Whole passes over a source use up what they can; the rest of the budget (less than
one pass) is filled by choosing documents so that their lengths add up to it. For that, documents are only counted by exact
length: each length first gives its proportional share, so that the chosen documents keep the source's mix of lengths,
and a bounded-knapsack dynamic programme over the counts that remain closes the gap, to the word wherever the lengths allow.
Which documents of a length are chosen depends on a seeded hash of their content, not on the order of rows: those below a threshold for their
source and length, which is found on a narrow table of (source, length, hash). Texts are never shuffled while the thresholds can be broadcast.

Bounds: one row per source and length meets in the task of a source (distinct lengths, not documents); the total that a dynamic programme
covers is at most MAX_TOTAL words, above which a source comes as near as the proportional shares and single documents allow.

Defined results: a null text has no words and is never repeated (taken is 0); a null source is a source of its own, sorted last; repeated
rows count one by one, and equal rows are interchangeable; a very long text is a length of its own; an empty table gives an empty mix. Columns of
the input that clash with a result column are replaced by `mix`, which also leaves out those that begin with _mix_; `mixed` hands all through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import numbered, set_aside, word_count, written

#: Parts of (source, length) groups by hash: of a group of n documents about n / BUCKETS are looked at one by one.
BUCKETS = 1024

#: Thresholds (one per source and length, about 60 bytes) that are broadcast; beyond that, documents are shuffled to meet them, in SALTS parts.
BROADCAST_ROWS, SALTS = 500_000, 16

OWN = ("size", "source_size", "target", "taken", "copies")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size -> with target: share of all words by weight, at most `most` times the source's size.

    weights repeat over the sources in code-point order, null last. The excess of sources at their limit is shared again by
    weight until none is above. Only sums leave the executors; the sources themselves stay a DataFrame.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(sources.select("source", "source_size"), F.col("source").asc_nulls_last(), "_place")
    weighed = written(placed.withColumn("weight", F.element_at(pattern, (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place").withColumn("limit", F.col("source_size") * most), "mix-sources")
    budget = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # each turn fixes at least one more source at its limit; a few turns in practice
        at_limit = F.col("limit") <= F.col("weight") * level
        fixed, free, n = weighed.agg(F.sum(F.when(at_limit, F.col("limit"))), F.sum(F.when(~at_limit, F.col("weight"))), F.count(F.when(at_limit, 1))).first()
        if n == full or not free:
            break
        level, full = (budget - (fixed or 0.0)) / free, n
    return weighed.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * level).alias("target"))


#: Totals that one dynamic programme may cover.
MAX_TOTAL = 1 << 22


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (at most counts) to choose for a total nearest to budget; the lower of two.

    lengths: distinct and positive. First every length gives its proportional share, and the programme closes the gap. Where it
    can't, with few documents, the shares are cut back until the programme chooses among all; that last choice is the nearest there is.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    best, gap = None, 0
    for share in (1.0, 0.75, 0.5, 0.0):
        taken = knapsack(lengths, counts, budget, np.array([int(int(c) * budget // total * share) for c in counts.tolist()], np.int64), best is None)
        if taken is None:
            break
        off = abs(int((lengths * taken).sum()) - budget)
        if best is None or off < gap:
            best, gap = taken, off
        if not gap:
            break
    return best


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, taken: np.ndarray, always: bool) -> np.ndarray | None:
    """`taken` and more documents, for a total nearest to budget. None if the gap is above MAX_TOTAL (with always: it is
    first lowered to about the longest document, by rounding single lengths up, the longest first)."""
    taken = taken.copy()
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths)
    slack = 1 << 12
    for k in order if always else ():
        if taken[k] < counts[k] and rest - int(lengths[k]) >= slack:
            taken[k] += 1
            rest -= int(lengths[k])
    left = counts - taken
    usable = [k for k in order if left[k] > 0]
    if not usable:
        return taken
    top = rest + int(min(lengths[k] for k in usable))  # a total above this is never nearer than one below
    if top > MAX_TOTAL and not always:
        return None
    first = np.full(top + 1, -1, np.int64)  # the piece by which a total was first reached
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    for k in usable:
        m, part = min(int(left[k]), top // int(lengths[k])), 1
        while m > 0 and not reached[rest]:  # binary parts of the count
            part_now = min(part, m)
            span = part_now * int(lengths[k])
            if span <= top:
                new = np.zeros(top + 1, bool)
                new[span:] = reached[: top + 1 - span]
                new &= ~reached
                first[new] = len(pieces)
                reached |= new
                pieces.append((k, part_now))
            m -= part_now
            part *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at > 0:
        k, n = pieces[first[at]]
        taken[k] += n
        at -= n * int(lengths[k])
    return taken


def plan(sized: DataFrame, goal: DataFrame, most: int = 3) -> DataFrame:
    """source, size, n -> passes and extra: documents of that length get `passes` copies, `extra` of them one more.

    One group per source, with a row per distinct length, however many documents there are.
    """
    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(target // source_size), most) if source_size else 0
        pdf = pdf.sort_values("size", ignore_index=True)
        extra = np.zeros(len(pdf), np.int64)
        some = (pdf["size"] > 0).to_numpy()
        if source_size and passes < most:
            extra[some] = fit(pdf.loc[some, "size"].to_numpy(np.int64), pdf.loc[some, "n"].to_numpy(np.int64), round(target) - passes * source_size)
        return pdf.assign(passes=np.where(some, passes, 0), extra=extra)[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    kind = goal.schema["source"].dataType.simpleString()
    joined = sized.alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "size", "n", "source_size", "target")
    return joined.groupBy("source").applyInPandas(fitted, f"source {kind}, size long, n long, source_size long, target double, passes long, extra long")


def thresholds(narrow: DataFrame, cells: DataFrame, planned: DataFrame) -> DataFrame:
    """source, size, source_size, target, passes, and which documents get one more copy: those of a bucket below `bucket`, and in it those of a
    hash below `hash`; of the `same` documents of this hash, `some`.

    Only the one bucket per source and length in which the last extra copy falls is looked at by hash, and counts of equal hashes are added up first.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    by = Window.partitionBy("source", "size")
    before = lambda n, order: F.coalesce(F.sum(n).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (F.col("start") < F.col("extra")) & (F.col("extra") <= F.col("start") + F.col("n"))
    placed = cells.withColumn("start", before("n", "bucket")).alias("a").join(planned.select("source", "size", "extra").filter("extra > 0").alias("b"), same("a", "b")).filter(last)
    edge = written(placed.select("a.source", "a.size", "bucket", (F.col("extra") - F.col("start")).alias("extra"), F.col("a.n").alias("n")), "mix-edges")
    inside = narrow.alias("a").join(edge.alias("b"), same("a", "b") & (F.col("a.bucket") == F.col("b.bucket"))).groupBy("a.source", "a.size", "hash").agg(F.count("*").alias("n"), F.first("extra").alias("extra"))
    cut = inside.withColumn("start", before("n", "hash")).filter(last).select("source", "size", "hash", (F.col("extra") - F.col("start")).alias("some"), F.col("n").alias("same"))
    found = planned.alias("a").join(edge.alias("b"), same("a", "b"), "left").join(cut.alias("c"), same("a", "c"), "left")
    return written(found.select("a.source", "a.size", "source_size", "target", "passes", F.coalesce("b.bucket", F.lit(-1)).alias("bucket"), "hash", "some", "same"), "mix-thresholds")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most: int = 3, seed: int = 20, source: str = "source", text: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies (times the mix takes the row, 0 and more) and taken (words it takes)."""
    names = [c for c in docs.columns if c.lower() not in OWN and not c.startswith("_mix_")]
    content = [F.col(f"`{c}`") if kind.startswith(("array", "struct", "binary")) else F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if c in names and "map<" not in kind and "variant" not in kind]
    tagged = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias("_mix_source"), word_count(f"`{text}`").alias("size"), F.xxhash64(F.lit(seed), *content).alias("_mix_hash"))
    narrow = written(tagged.select(F.col("_mix_source").alias("source"), "size", F.pmod("_mix_hash", F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("_mix_hash").alias("hash")), "mix-sizes")
    # counts by exact length and salt: the knapsacks work on these
    cells = written(narrow.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-cells")
    sized = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    found = thresholds(narrow, cells, written(plan(sized, goal, most), "mix-plan"))
    limits = found.select(F.col("source").alias("_mix_s"), F.col("size").alias("_mix_n"), "source_size", "target", *[F.col(c).alias(f"_mix_{c}") for c in ("passes", "some", "same")], F.col("bucket").alias("_mix_edge"), F.col("hash").alias("_mix_cut"))
    on = F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("size") == F.col("_mix_n"))
    if found.count() <= BROADCAST_ROWS:
        joined = tagged.join(F.broadcast(limits), on)
    else:
        salted = limits.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = tagged.withColumn("_mix_part", F.pmod(F.shiftright("_mix_hash", 32), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("_mix_part") == F.col("_mix_salt")))
    bucket = F.pmod("_mix_hash", F.lit(BUCKETS)).cast("int")
    at_edge = (bucket == F.col("_mix_edge")) & (F.col("_mix_hash") == F.col("_mix_cut"))
    more = (bucket < F.col("_mix_edge")) | ((bucket == F.col("_mix_edge")) & (F.col("_mix_hash") <= F.col("_mix_cut")))
    copies = lambda more: (F.col("_mix_passes") + F.when(more, 1).otherwise(0)).cast("long")
    if found.filter("some < same").limit(1).count():  # equal rows of which only some are taken
        torn = F.coalesce(at_edge & (F.col("_mix_some") < F.col("_mix_same")), F.lit(False))
        few = written(joined.filter(torn).withColumn("_mix_at", F.monotonically_increasing_id()), "mix-ties").withColumn("_mix_range", F.shiftright("_mix_at", 33))
        sums = few.groupBy("_mix_source", "size", "_mix_range").agg(F.count("*").alias("_mix_n2"))
        first = sums.select(F.col("_mix_source").alias("_mix_s2"), F.col("size").alias("_mix_size2"), F.col("_mix_range").alias("_mix_r2"), F.coalesce(F.sum("_mix_n2").over(Window.partitionBy("_mix_source", "size").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_mix_before"))
        place = F.row_number().over(Window.partitionBy("_mix_source", "size", "_mix_range").orderBy("_mix_at")) + F.col("_mix_before")
        few = few.join(first, F.col("_mix_source").eqNullSafe(F.col("_mix_s2")) & (F.col("size") == F.col("_mix_size2")) & (F.col("_mix_range") == F.col("_mix_r2")))
        few = few.withColumn("_mix_place", place).withColumn("copies", copies(F.col("_mix_place") <= F.col("_mix_some"))).select(*[F.col(f"`{c}`") for c in joined.columns], "copies")
        joined = joined.filter(~torn).withColumn("copies", copies(more)).unionByName(few)
    else:
        joined = joined.withColumn("copies", copies(more))
    return joined.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, in the columns of docs, whatever these are called. A document without words counts
    nothing towards any budget and comes once."""
    plain, back = set_aside(docs, options.get("source", "source"), options.get("text", "text"))
    out = mix(plain, **options)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    return back(out.select(*plain.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("_mix_copy")))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
