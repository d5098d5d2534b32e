"""Near-duplicates by Order MinHash.

Texts are sequences of five-word shingles; the i-th occurrence of a shingle is labelled i, so that repetitions count. Each of
BANDS * ROWS hash functions picks the two shingles of smallest hash and keeps them in text order: two texts agree with a
probability that falls with their edit distance, not only with their sets. Texts that agree on all functions of a band are candidates;
banded alignment decides: similarity is c / (a + b - c), with a and b the texts' numbers of shingles and c those that
an alignment matches in order. At 0.8 a pair is missed with a chance of (1 - 0.8^(2*ROWS))^BANDS, below 0.1 %.

Exact copies are one node from the start, and of buckets with equal nodes one is looked at. A bucket that a block holds is compared in one task, in
bounded memory. In a larger one, every node that is not yet connected to a leader is compared with it, round by round with other leaders, as long as that
connects many; a bucket whose nodes are all connected is done. What is left (many texts that share much, but not enough) is dealt
by each text's rarest shingles: of n shingles, two similar texts share one of the n - ceil(0.8 n) + 1 rarest of either. So no large bucket is
ever compared all with all, and no candidate is left out.

Defined results: a null text is in a class of its own; texts without words are copies of each other only if they are
equal; a text of 1 to 4 words has one shingle; very long texts are compared whole, in memory that grows with their length; a class is named by its
smallest doc_id (null ids only: null), whatever the order of rows; rows that repeat share their class; an empty table gives an empty result.
Only the key and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .text import bounded_batches, set_aside, written
from .tokens import U, mix64, shingles, word_hashes

BANDS, ROWS, WORDS = 24, 3, 5
SIMILARITY = 0.8

#: Buckets of up to so many nodes are compared pair by pair; those of up to so many nodes, and words, in one block.
SMALL_BUCKET, BLOCK_NODES, BLOCK_WORDS = 6, 2048, 1_500_000

#: In larger buckets leaders take turns until a round leaves more than this share of what it found.
STALLED = 0.8

#: Columns of a product of matrices.
COLUMNS = 4096

#: Pairs of one leader in a task: its text is sent to as many tasks as it has such portions.
PORTION = 1000

#: Up to so many texts (24 bytes each) that share a bucket are broadcast to fetch them; beyond that, all texts are shuffled once.
BROADCAST_NODES = 500_000


def occurrence_labelled(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shingle hashes in which the second, third, ... occurrence within a row differ from the first."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=U), np.diff(offsets))
    with np.errstate(over="ignore"):
        key = s ^ mix64(row + U(1))
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = sorted_key[1:] != sorted_key[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        n = np.empty(len(key), U)
        n[order] = np.arange(len(key), dtype=U) - start.astype(U)
        return np.where(n == 0, s, mix64(s + n * U(0x9E3779B97F4A7C15)))


def sketch(s: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per non-empty row and band; rows without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, bands), U)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    rng = np.random.default_rng(1)
    starts, counts = offsets[full], np.diff(offsets)[full]
    where = np.repeat(np.arange(len(full)), counts)
    last = np.iinfo(U).max
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), b + 1, U)
            for _ in range(rows):
                x, a = rng.integers(0, last, dtype=U), rng.integers(0, last, dtype=U) | U(1)
                v = (s ^ x) * a
                low = np.minimum.reduceat(v, starts)
                p = np.flatnonzero(v == low[where])  # one per row: labelled shingles of a row differ
                if len(p) != len(full):
                    p = p[np.unique(where[p], return_index=True)[1]]
                v[p] = last
                second = np.minimum.reduceat(v, starts)
                q = np.flatnonzero((v == second[where]) & (v != last))
                q = q[np.unique(where[q], return_index=True)[1]] if len(q) else q
                after = np.full(len(full), len(s), np.int64)
                after[where[q]] = q
                early = p < after
                key = mix64(key * U(0x9E3779B97F4A7C15) + np.where(early, low, second))
                key = mix64(key * U(0xC2B2AE3D27D4EB4F) + np.where(early, second, low))
            out[full, b] = key
    return out


def aligned(a: list[int], b: list[int], most: int) -> int:
    """How many symbols of b an alignment matches in order with a, none more than `most` places off its own.

    Bit-parallel: bit p of `row` is 0 where one more symbol is matched at place p of a. Only the 2 * most + 1 bits of the band are kept and
    updated, so memory grows with the length of the texts and not with their edits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, done = len(a), head + tail
    if not n or not b:
        return done
    where, wanted = defaultdict(list), set(b)
    for p, x in enumerate(a):
        if x in wanted:
            where[x].append(p)
    often = max(64, n // 4096)
    masks = {}
    for x, at in where.items():
        if len(at) > often:
            bits = np.zeros(n, np.uint8)
            bits[at] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << (2 * most + 1)) - 1
    row, low = full >> most, 0  # bits of the places low .. low + 2 * most; at first 0 .. most
    for j, x in enumerate(b):
        if j > most:  # the band moves on: its lowest place is settled
            if low < n:
                done += ~row & 1
            row >>= 1
            low += 1
        top = j + most - low
        row |= 1 << top
        if x in masks:
            hit = (masks[x] >> low) & ((2 << top) - 1)
        elif x in where:
            hit = 0
            for p in where[x]:
                if low <= p <= j + most:
                    hit |= 1 << (p - low)
        else:
            continue
        both = row & hit
        row = ((row + both) | (row - both)) & ((2 << top) - 1)
    width = min(n - low, len(b) - 1 + most - low + 1)
    return done + (width - (row & ((1 << width) - 1)).bit_count() if width > 0 else 0)


def similarity(sa: np.ndarray, sb: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned similarity of two sequences of shingles, or 0.0 where it is certainly below `least`."""
    n, m = len(sa), len(sb)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    ratio = lambda c: c / (n + m - c)
    ua, ca = np.unique(sa, return_counts=True)
    ub, cb = np.unique(sb, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    if ratio(common) < least:
        return 0.0  # no alignment matches more than what is common
    most = n + m - 2 * int(np.ceil(least * (n + m) / (1 + least) - 1e-9))  # insertions and deletions at most, so the width of the band
    return ratio(aligned(sa.tolist(), sb.tolist(), most))


def fingerprint(text: str) -> F.Column:
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """docs (doc_id, fp, text) -> doc_id, fp, n_words and bands (null where there is no word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, words, offsets in word_hashes(batch.column(text)):
                s, o = shingles(words, offsets, WORDS)
                keys = sketch(occurrence_labelled(s, o), o).view(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()), mask=pa.array(np.diff(o) == 0))
                rest = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("fp"), pa.array(np.diff(offsets)), keys], names=["doc_id", "fp", "n_words", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary, n_words long, bands array<bigint>")


def shingles_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles of each text, plain and labelled by occurrence."""
    for _, _, words, offsets in word_hashes(texts):
        s, o = shingles(words, offsets, WORDS)
        labelled = occurrence_labelled(s, o)
        for r in range(len(offsets) - 1):
            yield s[o[r] : o[r + 1]], labelled[o[r] : o[r + 1]]


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (x, y) whose texts (node, text) are similar enough. An x of many pairs is dealt out in portions of its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = [[s for s, _ in shingles_of(part.column(name))] for name in ("tx", "ty")]
                good = [similarity(a, b, least) >= least for a, b in zip(*sides, strict=True)]
                yield part.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    portions = pairs.groupBy("x").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    x = portions.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").select("x", "tx", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    y = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    dealt = pairs.join(portions, "x").withColumn("portion", F.pmod(F.xxhash64("y"), F.col("portions")).cast("int"))
    return dealt.join(x, ["x", "portion"]).join(y, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x binary, y binary")


def block_links(rows: list[tuple], least: float) -> Iterator[tuple]:
    """rows: (node, shingles, labelled shingles, side, component) -> links that connect all components that a similar pair of two different sides
    (of any two rows, if all sides are alike) connects.

    Counts what each two rows have in common by matrix products over the shingles that occur twice, so that only pairs that can be
    similar are aligned, and of these only pairs that nothing has connected yet.
    """
    n = np.array([len(r[2]) for r in rows])
    _, which = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), n)
    twice = np.bincount(which)[which] > 1
    row, which = row[twice], np.unique(which[twice], return_inverse=True)[1]
    common = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    for at in range(0, int(which.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(which, [at, at + COLUMNS])
        part = np.zeros((len(rows), COLUMNS), np.float32)
        part[row[lo:hi], which[lo:hi] - at] = 1
        common += part @ part.T
    side = np.array([r[3] for r in rows])
    root = np.unique(np.array([r[4] for r in rows]), return_inverse=True)[1]
    cross = np.triu(root[:, None] != root[None, :], 1)
    if not (side == side[0]).all():
        cross &= side[:, None] != side[None, :]
    share = np.where(cross, common / np.maximum(n[:, None] + n[None, :] - common, 1), 0)
    x, y = np.nonzero(share >= least - 1e-6)
    near = np.argsort(-share[x, y], kind="stable")
    for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
        if root[i] != root[j] and similarity(rows[i][1], rows[j][1], least) >= least:
            root[root == root[i]] = root[j]
            yield rows[i][0], rows[j][0]


def several(state: DataFrame) -> DataFrame:
    """state (key, node, comp) of the buckets that hold several components."""
    mixed = state.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
    return state.join(mixed, "key", "left_semi").select("key", "node", "n_words", "comp")


def of_component(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (key, node, n_words) of the buckets that hold several components, with comp."""
    return several(members.join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))


def led(state: DataFrame, turn: int) -> DataFrame:
    """state (key, node, n_words, comp) -> pairs (x: a leader, y): each node with the leader of one of its buckets, another in every turn."""
    first = state.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("r"), F.col("node").alias("x"), F.col("comp").alias("of"))).alias("leader"))
    met = state.join(first, "key").filter(F.col("comp") != F.col("leader.of"))
    one = met.groupBy("node").agg(F.max(F.struct("n", F.xxhash64(F.lit(turn), "key").alias("r"), F.col("leader.x").alias("x"))).alias("m"))
    return one.select(F.col("m.x").alias("x"), F.col("node").alias("y"))


def by_rarest(state: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """state (key, node, n_words, comp) dealt anew, whatever the bucket: by each of the node's rarest labelled shingles, so many that two similar
    texts share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, (_, labelled) in zip(batch.column("node").to_pylist(), shingles_of(batch.column("text")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(labelled), pa.binary()), pa.array(labelled.view(np.int64)), pa.array(np.full(len(labelled), len(labelled)))], names=["node", "s", "n"])

    nodes = state.select("node", "n_words", "comp").distinct()
    rows = written(texts.select("node", "text").join(nodes, "node", "left_semi").mapInArrow(run, "node binary, s long, n long"), "near-shingles")
    often = rows.groupBy("s").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "s"))
    rare = rows.join(often.filter("often > 1"), "s", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("place", place)
    rare = rare.filter((F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("often") > 1))
    return several(rare.select(F.col("s").alias("key"), "node").join(nodes, "node"))


def buckets(members: DataFrame) -> DataFrame:
    """members (key, node, n_words, ...) of the buckets of two nodes or more, and of buckets with equal nodes only of one; with the bucket's
    nodes n and words w."""
    own = lambda seed: F.xxhash64(F.lit(seed), "node")
    sums = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"), F.bit_xor(own(1)).alias("a"), F.bit_xor(own(2)).alias("b")).filter("n > 1")
    return members.join(sums.groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.first("w").alias("w")).select("key", "n", "w"), "key")


def links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """members (key, node, n_words, n, w, comp) of buckets -> links that connect all components that similar pairs of a bucket connect.

    The nodes of a small bucket are compared pair by pair, a pair of several buckets once. A larger bucket is dealt into blocks of about BLOCK_NODES
    nodes or BLOCK_WORDS words, and each two blocks meet in one task.
    """
    small = members.filter(F.col("n") <= SMALL_BUCKET).select("key", "node", "comp")
    a, b = (small.select("key", F.col("node").alias(name), F.col("comp").alias(f"of_{name}")) for name in "xy")
    pairs = written(a.join(b, "key").filter("x < y AND of_x <> of_y").select("x", "y").distinct(), "near-pairs")

    parts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int")
    dealt = members.filter(F.col("n") > SMALL_BUCKET).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = dealt.select("key", "node", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.select("key", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        sides, found = table.column("own").to_pylist(), []
        if table.column("i")[0] == table.column("j")[0] or len(set(sides)) > 1:  # else the other block is empty
            each = zip(table.column("node").to_pylist(), shingles_of(table.column("text").combine_chunks()), sides, table.column("comp").to_pylist(), strict=True)
            found = list(block_links([(node, s, labelled, side, comp) for node, (s, labelled), side, comp in each], least))
        return pa.table({"x": pa.array([f[0] for f in found], pa.binary()), "y": pa.array([f[1] for f in found], pa.binary())})

    met = placed.join(texts.select("node", "text"), "node").select("key", "i", "j", "own", "node", "comp", "text").groupBy("key", "i", "j").applyInArrow(run, "x binary, y binary")
    return verified(pairs, texts, least).unionByName(met)


def connected(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """members (key, node, n_words, n, w) of buckets, texts (node, text) -> node, root for every node that similar pairs of buckets connect with
    another."""
    fits = (F.col("n") <= BLOCK_NODES) & (F.col("w") <= BLOCK_WORDS)
    roots = components(links(members.filter(fits).withColumn("comp", F.col("node")), texts, least))
    over, before = members.filter(~fits), None
    while True:
        state = written(of_component(over, roots), "near-mixed")
        left = state.count()
        if not left:
            return roots
        if before is not None and left > STALLED * before:
            break
        new = verified(written(led(state, left), "near-led"), texts, least)
        roots, before = components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(new)), left
    new = links(written(buckets(by_rarest(state, texts, least)), "near-rarest"), texts, least)
    return components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(new))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """key, fp and class_id for every row of docs, as a written table."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), fingerprint(text).alias("fp"), F.col(f"`{text}`").alias("text"))
    sketched = written(sketches(source, "text"), "near-sketches")
    nodes = sketched.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    nodes = written(nodes, "near-nodes")
    rows = nodes.filter("bands IS NOT NULL").select(F.explode("bands").alias("key"), F.col("fp").alias("node"), "n_words")
    members = written(buckets(rows), "near-buckets")
    wanted = written(members.select("node").distinct().join(nodes.select(F.col("fp").alias("node"), "first"), "node"), "near-wanted")
    own = source.select(F.col("fp").alias("node"), F.col("doc_id").alias("first"), "text")
    on = (own["node"] == wanted["node"]) & own["first"].eqNullSafe(wanted["first"])
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = written(own.join(few, on).select(own["node"], "text").dropDuplicates(["node"]), "near-texts")
    roots = connected(members, texts, least)
    named = nodes.select(F.col("fp").alias("node"), "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("first").alias("class_id"))
    label = named.join(best, "root").select(F.col("node").alias("fp"), "class_id")
    out = sketched.select("doc_id", "fp").join(label, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """docs without all but one row of each class: that with the smallest key, of rows that repeat one."""
    label = written(classes(docs, text, key, least), "near-classes")
    gone = label.filter("NOT doc_id <=> class_id").select("doc_id", "fp").distinct()
    docs, back = set_aside(docs, key, text)
    tagged = docs.withColumn("_fp", fingerprint(text))
    on = (tagged["_fp"] == gone["fp"]) & tagged[key].eqNullSafe(gone["doc_id"])
    out = tagged.join(gone, on, "left_anti")
    twice = label.filter("fp IS NOT NULL AND doc_id <=> class_id").groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1")
    if twice.limit(1).count():  # rows that repeat whole, or one id with several texts of a class
        label_fp = label.filter("fp IS NOT NULL AND doc_id <=> class_id").groupBy("class_id").agg(F.min("fp").alias("fp"))
        out = out.join(label_fp, (out["_fp"] == label_fp["fp"]) & out[key].eqNullSafe(label_fp["class_id"]), "left_semi").dropDuplicates(["_fp"]).unionByName(out.filter("_fp IS NULL"))
    return back(out)


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    out = classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", F.expr("doc_id <=> class_id").alias("representative"))
