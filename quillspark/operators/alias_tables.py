"""Alias groups as tables: thousands of documents may name aliases, and all questions are looked through for all of them at once.

A common word is in very many groups, and most questions hold some: pairs of questions and groups, or of questions and n-grams, are many more than both,
so they are never rows. Questions are dealt over the cores, groups stand in front of them in each task as numbers, and what a question holds and meets is
found where it is. Nothing is collected, and no expression grows with the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.frames import bounded_batches, computed, kept, small_side
from quillspark.functions.text import let, strip
from quillspark.functions.vocabulary import ALIASES

from .understanding import normal, strings

#: Characters of the n-grams by which members are found.
GRAM = 3
#: Distinct variants of a question that count.
LIMIT = 4
#: Groups that a task holds at once; more are dealt in slabs, and what a question meets in each is put together.
SLAB = 4_000_000
#: Places of members that are remembered from question to question, and subjects that are told at once.
HELD, TOLD = 1 << 22, 1 << 18
#: Bytes from which a word is looked for by a part of it, bytes of text that are looked through at once, bits of the table that says which words may be there.
SHORT, PIECE, BITS = 16, 1 << 18, 22
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK, MIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(0xD6E8FEB86659FD93)
FOUND = pa.list_(pa.struct([("hit", pa.string()), ("members", pa.list_(pa.string()))]))


def groups_table(documents: DataFrame, key: str, aliases: str = "aliases", base: list[list[str]] = ALIASES) -> DataFrame:
    """place, members: the fixed groups and those of documents (an array column), in lower case, of two distinct members or more; of groups with
    equal members the first. place orders them: the fixed ones as they come, then documents by key."""
    spark = documents.sparkSession
    fixed = spark.createDataFrame([(i, g) for i, g in enumerate(base)], "at int, g array<string>").select(F.struct(F.col("at").alias("fixed"), F.lit(None).cast(documents.schema[key].dataType).alias("key")).alias("place"), "g")
    own = documents.select(F.struct(F.lit(len(base)).alias("fixed"), F.col(key).alias("key")).alias("place"), F.col(aliases).alias("g"))
    members = F.array_distinct(F.filter(F.transform("g", normal), lambda a: a != ""))
    rows = fixed.unionByName(own).select("place", members.alias("members")).filter(F.size("members") >= 2)
    return rows.groupBy(F.sort_array("members").alias("_same")).agg(F.min_by("members", "place").alias("members"), F.min("place").alias("place")).select("place", "members")


def grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def rarest_grams(texts: DataFrame, key: str, text: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, gram: the n-grams of members (alias) that each text has; alias, gram: that n-gram of each member which the fewest texts have)."""
    parts = kept(members.select("alias").distinct().select("alias", F.explode(grams(F.col("alias"), F.least(F.lit(GRAM), F.length("alias")))).alias("gram")), "member-grams")
    none = F.array().cast("array<string>")
    own = F.flatten(F.array(*[F.when(F.length(text) >= k, grams(F.col(text), k)).otherwise(none) for k in range(1, GRAM + 1)]))
    there = kept(texts.select(key, F.explode(own).alias("gram")).join(small_side(parts.select("gram").distinct()), "gram", "left_semi"), "text-grams")
    counts = there.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(small_side(counts), "gram", "left").groupBy("alias").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return there, rarest


def windows(data: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n bytes, the same for the same bytes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * np.cumprod(np.full(len(data), BASE), dtype=np.uint64), dtype=np.uint64)])
    return (sums[n:] - sums[:-n]) * np.cumprod(np.full(len(data) - n + 1, BACK), dtype=np.uint64) * MIX


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts, from 0."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


class Words:
    """Words that are looked for in many texts at once: by a number for their first bytes (all of a word below SHORT bytes, else the largest power of two
    of them), then by the bytes themselves."""

    def __init__(self, words: pa.Array):
        self.offsets, self.data = bytes_of(words)
        sizes = np.diff(self.offsets)
        heads = np.where(sizes < SHORT, sizes, 1 << np.maximum(0, np.frexp(sizes.astype(np.float64))[1] - 1))
        self.seen, self.by = np.zeros(1 << BITS, bool), {}
        for n in np.unique(heads).tolist():
            own = np.flatnonzero(heads == n)
            codes = np.concatenate([windows(self.data[at : at + n], n) for at in self.offsets[own]]) if n >= SHORT else self.codes(own, n)
            order = np.argsort(codes, kind="stable")
            self.by[n] = codes[order], own[order]
            self.seen[codes >> np.uint64(64 - BITS)] = True

    def codes(self, own: np.ndarray, n: int) -> np.ndarray:
        powers = np.cumprod(np.full(n, BASE), dtype=np.uint64)
        return (self.data[self.offsets[own][:, None] + np.arange(n)] * powers).sum(axis=1, dtype=np.uint64) * BACK * MIX

    def inside(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, word), by text and word: each word that a text has, once."""
        offsets, data = bytes_of(texts)
        pairs = [np.empty(0, np.int64)]
        for begin in range(0, len(data), PIECE):
            for n, (codes, own) in self.by.items():
                piece = data[begin : begin + PIECE + n - 1]
                if len(piece) < n:
                    continue
                at = windows(piece, n)
                spots = np.flatnonzero(self.seen[at >> np.uint64(64 - BITS)])
                first = np.searchsorted(codes, at[spots])
                many = np.searchsorted(codes, at[spots], side="right") - first
                spots = np.repeat(spots + begin, many)
                word = own[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
                text = np.searchsorted(offsets, spots, side="right") - 1
                fits = spots + self.offsets[word + 1] - self.offsets[word] <= offsets[text + 1]
                spots, word, text = spots[fits], word[fits], text[fits]
                if n < SHORT:
                    same = np.ones(len(spots), bool)
                    for i in range(n):
                        same &= data[spots + i] == self.data[self.offsets[word] + i]
                else:
                    same = np.array([np.array_equal(data[x : x + e - b], self.data[b:e]) for x, b, e in zip(spots, self.offsets[word], self.offsets[word + 1], strict=True)], bool)
                pairs.append(text[same] * (len(self.offsets) - 1) + word[same])
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.offsets) - 1))


class Met:
    """Groups in their order, as numbers: members are numbered, and of each member it is known in which groups it is."""

    def __init__(self, parts: list[pa.ListArray]):
        named = pa.chunked_array([p.flatten().dictionary_encode() for p in parts]).unify_dictionaries().chunks if parts else []
        self.words = named[0].dictionary if named else pa.array([], pa.string())
        self.looked = Words(self.words)
        self.ids = np.concatenate([np.empty(0, np.int32), *[c.indices.to_numpy() for c in named]])
        sizes = np.concatenate([np.empty(0, np.int64), *[pc.list_value_length(p).to_numpy() for p in parts]])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.argsort(self.ids, kind="stable")
        self.groups = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]  # of each member, in order
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(self.words)))])
        self.first, self.near, self.held = np.empty(len(self.words), np.int64), {}, 0

    def of(self, member: int) -> np.ndarray:
        return self.groups[self.bounds[member] : self.bounds[member + 1]]

    def firsts(self, at: np.ndarray) -> np.ndarray:
        """Of places (in order) those whose member is at none before."""
        ids, n = self.ids[at], np.arange(len(at))
        self.first[ids[::-1]] = n[::-1]
        return at[self.first[ids] == n]

    def around(self, member: int) -> np.ndarray:
        """The first place of each member of this member's groups."""
        if (at := self.near.get(member)) is None:
            groups = self.of(member)
            sizes = self.starts[groups + 1] - self.starts[groups]
            at = np.repeat(self.starts[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            if self.held > HELD:
                self.near, self.held = {}, 0
            at = self.near[member] = self.firsts(at).astype(np.int32)
            self.held += len(at)
        return at

    def subjects(self, members: np.ndarray) -> np.ndarray:
        """All members of the groups that have one of these, in order, each once."""
        return self.ids[self.firsts(np.sort(np.concatenate([self.around(m) for m in members])))] if len(members) else self.ids[:0]

    def hits(self, text: str, members: np.ndarray) -> list[dict]:
        """What makes the first LIMIT distinct variants of a text: the first member of a group that the text has, and another one in its place. Groups are
        looked at in order, no more than are needed."""
        of, own, k = [self.of(m) for m in members], set(members.tolist()), LIMIT
        while True:
            whole = all(len(g) <= k for g in of)
            groups = np.unique(np.concatenate([g[:k] for g in of])) if of else []  # its first k are the first k of all
            made: dict[str, dict] = {}
            for g in groups if whole else groups[:k]:
                group = self.ids[self.starts[g] : self.starts[g + 1]].tolist()
                first = next(m for m in group if m in own)
                hit = self.words[first].as_py()
                for a in (self.words[m].as_py() for m in group if m != first):
                    made.setdefault(text.replace(hit, a, 1), {"hit": hit, "members": [a]})
            if whole or len(made) >= LIMIT:
                return list(made.values())[:LIMIT]
            k *= 4

    def answers(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch's rows with alias_subjects and _found, in parts of bounded size."""
        at, members = self.looked.inside(batch.column("_text"))
        ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
        texts, rest = batch.column("_text").to_pylist(), batch.drop_columns(["_text", "_members"])
        begun, size, subjects, found = 0, 0, [], []
        for i, text in enumerate(texts):
            own = members[ends[i] : ends[i + 1]]
            subjects.append(self.subjects(own))
            found.append(self.hits(text, own))
            size += len(subjects[-1])
            if size >= TOLD or i == len(texts) - 1:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in subjects])]), pa.int32())
                told = pa.ListArray.from_arrays(offsets, self.words.take(pa.array(np.concatenate(subjects))))
                part = rest.slice(begun, i + 1 - begun)
                yield pa.RecordBatch.from_arrays([*part.columns, told, pa.array(found, FOUND)], names=[*part.schema.names, "alias_subjects", "_found"])
                begun, size, subjects, found = i + 1, 0, [], []


def met(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """rows (with _text) with alias_subjects and _found in its place. Rows are dealt over the cores by key, and the groups
    stand in front of them in each task, in order; only groups and rows are shuffled. With a column slab groups are dealt by it as well, and a row comes
    back once from each slab, with _slab."""
    cores, slab = rows.sparkSession.sparkContext.defaultParallelism, F.col("slab") if "slab" in groups.columns else F.lit(0)
    slabs = groups.agg(F.max(slab)).first()[0] + 1 if "slab" in groups.columns else 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = groups.select(F.col("place").alias("_place"), F.col("members").alias("_members"), slab.alias("_slab"), each(cores).alias("_core"))
    own = rows.withColumn("_core", F.pmod(F.xxhash64(key), F.lit(cores)).cast("int")).withColumn("_slab", each(slabs))
    dealt = heads.unionByName(own, allowMissingColumns=True).repartitionById(cores * slabs, F.col("_slab") * cores + F.col("_core")).sortWithinPartitions(F.col("_place").asc_nulls_last())
    names = [c for c in own.columns if c not in ("_text", "_core")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, index = [], None
        for b in batches:
            n = b.num_rows - b.column("_members").null_count
            if n:
                parts.append(b.column("_members").slice(0, n))
            if n < b.num_rows:
                index = index or Met(parts)
                yield from index.answers(b.slice(n))

    bounded_batches(rows.sparkSession)
    strings_type = T.ArrayType(T.StringType())
    schema = dealt.select(*[F.col(f"`{c}`") for c in names]).schema.add("alias_subjects", strings_type).add("_found", T.ArrayType(T.StructType().add("hit", "string").add("members", strings_type)))
    return dealt.select(*[F.col(f"`{c}`") for c in names], "_text", "_members").mapInArrow(run, schema)


def variants_from(text: Column, found: Column, limit: int = LIMIT) -> Column:
    """The text with a matched member replaced, once, by each other member of its group, group by group; distinct ones, `limit` at most. Those after
    the last that counts are not made."""
    pairs = F.flatten(F.transform(found, lambda m: F.transform(F.filter(m["members"], lambda a: a != m["hit"]), lambda a: F.struct(m["hit"].alias("hit"), a.alias("a")))))

    def of(t: Column) -> Column:
        cut = lambda p: F.concat(F.substring(t, F.lit(1), F.instr(t, p["hit"]) - 1), p["a"], F.substring(t, F.instr(t, p["hit"]) + F.length(p["hit"]), F.length(t)))
        new = lambda made, v: F.when((v == t) | (strip(v) == "") | F.exists(made, lambda x: F.lower(x) == F.lower(strip(v))), made).otherwise(F.concat(made, F.array(strip(v))))
        return F.aggregate(pairs, strings([]), lambda made, p: F.when(F.size(made) >= limit, made).otherwise(let(cut(p), lambda v: new(made, v))))

    return let(normal(text), of)


def expanded(questions: DataFrame, key: str, text: str, groups: DataFrame) -> DataFrame:
    """questions with alias_variants and alias_subjects (all members of the groups with a member in the text, in order, each once)."""
    groups = kept(groups, "alias-groups")
    names = [F.col(f"`{c}`") for c in questions.columns]
    rows = questions.withColumn("_text", normal(F.col(text)))
    slabs = -(-groups.count() // SLAB)
    if slabs <= 1:
        out = met(rows, key, groups)
    else:
        rows = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "asked")
        dealt = kept(groups.repartitionByRange(slabs, "place").withColumn("slab", F.spark_partition_id()), "slabs")
        parts = met(rows.select("_row", "_text"), "_row", dealt).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_slab", "alias_subjects", "_found"))).alias("_parts"))
        out = rows.join(parts, "_row").withColumns({"alias_subjects": F.array_distinct(F.flatten("_parts.alias_subjects")), "_found": F.flatten("_parts._found")})
    return computed(out, {"alias_variants": variants_from(F.col(text), F.col("_found"))}).select(*names, "alias_variants", "alias_subjects")
