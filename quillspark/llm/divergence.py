"""How the sources of each language differ in their words: distances between sources, and the terms that a source has more of.

Each task counts the terms of its texts in a radix trie over bytes (`Trie`), whose leaves hold how many texts have the term and how often
each source does. A trie's serial form is its traversal in UTF-8 order, and tries merge by prefix range: a range shuffle by (lang, term)
brings the same stretch of all traversals together, sorted, where neighbouring equal terms add their leaves (`merged`), in memory that
doesn't grow with the stretch. A second traversal, of the terms that are kept, streams through each range (`traversed`): it adds up the
distances of all pairs of sources, and the best terms of each source come out in tie order, because terms arrive in the order of ties.

Arithmetic is exact: shares are integers, from long division in steps that fit 64 bits for totals up to 9 * 10^15.

Defined results: null text, lang and source are empty strings; a group whose texts have no terms still has its pairs; repeated rows count
as often as they come; other columns of the input, whatever their names, are not read; an empty table gives an empty table; of a text of any
length only its distinct terms stay. Equal values rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import bounded_batches, read_table, text_of, written

#: A term is kept if so many texts of its language have it.
LEAST = 30
#: Added to every count, and what shares add up to (but for rounding).
PRIOR, SCALE = 5, 10**9
#: Terms listed for each group.
TOP = 50
#: Counters (term and source) of a task at which its trie is sent off and a new one begun.
BUFFER = 1_500_000
#: Parts in which a group's candidates are cut down.
SALTS = 64
#: Bytes of a text that are cut into terms at once.
CUT = 1 << 20
#: Rows of a batch that leaves Python.
ROWS = 20_000
#: Sources whose distances to all others one task adds up; shares (terms times sources) held at once.
STRIP, SHARES = 512, 1 << 20

#: Capitals of ASCII in lower case, other bytes that aren't in terms as blanks.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node:
    __slots__ = ("edges", "leaf")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.leaf = -1


def shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common at the start."""
    n = min(len(a), len(b))
    return n - (((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) >> 3)


class Trie:
    """A radix trie over bytes: an edge holds the bytes that all terms below share, and a leaf the number of its term, in the order in which they came."""

    def __init__(self) -> None:
        self.root, self.size = Node(), 0

    def number(self, term: bytes) -> int:
        """The number of a term; a new one is added."""
        node, at, length = self.root, 0, len(term)
        while at < length:
            edges, first = node.edges, term[at]
            if edges is None or first not in edges:
                end = Node()
                if edges is None:
                    node.edges = {first: (term[at:], end)}
                else:
                    edges[first] = (term[at:], end)
                node = end
                break
            label, below = edges[first]
            if not term.startswith(label, at):
                k = shared(label, term[at : at + len(label)])
                fork = Node()
                fork.edges = {label[k]: (label[k:], below)}
                label = label[:k]
                edges[first] = (label, fork)
                below = fork
            node, at = below, at + len(label)
        if node.leaf < 0:
            node.leaf = self.size
            self.size += 1
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and numbers by the terms' bytes."""
        todo = [(b"", self.root)]
        while todo:
            term, node = todo.pop()
            if node.leaf >= 0:
                yield term, node.leaf
            if node.edges:
                for first in sorted(node.edges, reverse=True):
                    label, below = node.edges[first]
                    todo.append((term + label, below))


class Counts:
    """The counters of a language's trie, by leaf: texts that have the term, and its occurrences by source, as cells (leaf, source, n)."""

    def __init__(self, texts: dict[bytes, int] | None = None, by_source: dict[str, dict[bytes, int]] | None = None) -> None:
        """texts: of each term; by_source: of each source, occurrences of terms that are in texts."""
        self.trie, self.sources = Trie(), list(by_source or {})
        leaves = {term: self.trie.number(term) for term in texts or ()}  # a term descends once, for all sources
        self.texts = np.fromiter((texts or {}).values(), np.int64, len(leaves))
        parts = [np.zeros((3, 0), np.int64)]
        for k, own in enumerate((by_source or {}).values()):
            parts.append(np.stack([np.fromiter(map(leaves.__getitem__, own), np.int64, len(own)), np.full(len(own), k), np.fromiter(own.values(), np.int64, len(own))]))
        self.cells = np.concatenate(parts, axis=1)

    def merge(self, other: Counts) -> None:
        """Adds the counters of another trie to the leaves of the same terms."""
        leaf = np.zeros(other.trie.size, np.int64)
        for term, k in other.trie.walk():
            leaf[k] = self.trie.number(term)
        texts = np.zeros(self.trie.size, np.int64)
        texts[: len(self.texts)] = self.texts
        np.add.at(texts, leaf, other.texts)
        self.texts = texts
        names = {s: i for i, s in enumerate(self.sources)}
        source = np.array([names.setdefault(s, len(names)) for s in other.sources], np.int64)
        self.sources = list(names)
        cells = np.concatenate([self.cells, np.stack([leaf[other.cells[0]], source[other.cells[1]] if len(source) else other.cells[1], other.cells[2]])], axis=1)
        where, inverse = np.unique(cells[0] * max(1, len(names)) + cells[1], return_inverse=True)
        n = np.zeros(len(where), np.int64)
        np.add.at(n, inverse, cells[2])
        self.cells = np.stack([where // max(1, len(names)), where % max(1, len(names)), n])

    def serial(self, lang: str, most: int) -> Iterator[pa.RecordBatch]:
        """The traversal, leaves with their counters, in batches of `most` terms."""
        walked = list(self.trie.walk())
        words, leaf = [t for t, _ in walked], np.fromiter((k for _, k in walked), np.int64, len(walked))
        place = np.zeros(len(leaf), np.int64)
        place[leaf] = np.arange(len(leaf))
        at = place[self.cells[0]]
        order = np.argsort(at, kind="stable")
        source, n = self.cells[1][order], self.cells[2][order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(leaf)))])
        names = pa.array(self.sources, pa.string())
        for a in range(0, len(words), most):
            b = min(len(words), a + most)
            cut = slice(int(ends[a]), int(ends[b]))
            yield batch_of([lang] * (b - a), words[a:b], self.texts[leaf[a:b]], np.diff(ends[a : b + 1]), names.take(pa.array(source[cut])), n[cut])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Runs of letters and of characters outside of ASCII, capitals of ASCII in lower case; those of a long text in lots."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + CUT)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


LEAVES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
MERGED = "lang string, term string, texts long, leaves array<struct<source: string, n: long>>"


def batch_of(langs: list[str], words: list[bytes], texts, sizes, sources, counts) -> pa.RecordBatch:
    leaves = pa.StructArray.from_arrays([pa.array(sources, pa.string()), pa.array(counts, pa.int64())], ["source", "n"])
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(texts, pa.int64()), pa.ListArray.from_arrays(ends, leaves)], names=["lang", "term", "texts", "leaves"])


def sent(counts: dict[str, dict[str, Counter]], texts: dict[str, Counter], most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """What was counted, by language and source, as traversals of tries; the counters are empty afterwards."""
    gc.disable()  # nothing here is garbage, and the collector would look at every new node again and again
    for lang in sorted(texts):
        yield from Counts(texts.pop(lang), counts.pop(lang)).serial(lang, most)
    gc.enable()


def counted(docs: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """lang, term, texts, leaves of docs (lang, source, text): every task's tries, each by language in the order of its terms."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        texts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
                seen, of_source = set(), counts[lang][source]
                for own in terms(text.as_py()):
                    of_source.update(own)
                    seen.update(own)
                texts[lang].update(seen)
            if sum(len(own) for by in counts.values() for own in by.values()) >= buffer:
                yield from sent(counts, texts)
        yield from sent(counts, texts)

    return docs.select("lang", "source", "text").mapInArrow(run, MERGED)


def summed(batch: pa.Table, least: int, ends: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table | None]:
    """Rows of (lang, term, texts, leaves), sorted, with equal neighbours added up; those of fewer texts than `least` go. Unless `ends`, the last
    term may go on: it comes back, added up, as a table of one row."""
    lang, term = batch.column(0).combine_chunks(), batch.column(1).combine_chunks()
    n = len(batch)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = ~pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    texts = np.add.reduceat(batch.column(2).to_numpy(), first)
    good = texts >= least
    if not ends:
        good[-1] = True
    rows = np.flatnonzero(np.repeat(good, np.diff(np.append(first, n))))
    leaves = batch.column(3).combine_chunks().take(pa.array(rows))
    size = leaves.value_lengths().to_numpy()
    group = np.repeat((np.cumsum(new) - 1)[rows], size)
    source = leaves.flatten().field("source").dictionary_encode()
    k = max(1, len(source.dictionary))
    pair, where = np.unique(group * k + source.indices.to_numpy(), return_inverse=True)
    count = np.zeros(len(pair), np.int64)
    np.add.at(count, where, leaves.flatten().field("n").to_numpy())
    names = np.array(source.dictionary.to_pylist(), object)[pair % k] if len(pair) else []
    kept = np.flatnonzero(good)
    sizes = np.bincount(np.searchsorted(kept, pair // k), minlength=len(kept))
    at = pa.array(first[kept])
    whole = pa.Table.from_batches([batch_of(lang.take(at).to_pylist(), term.take(at).cast(pa.binary()).to_pylist(), texts[kept].tolist(), sizes.tolist(), list(names), count.tolist())])
    if ends:
        return iter(whole.to_batches()), None
    return iter(whole.slice(0, len(whole) - 1).to_batches()), whole.slice(len(whole) - 1)


def merged(tries: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, texts, leaves, range: the tries of all tasks as one, without the terms of fewer texts than `least`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                done, rest = summed(pa.concat_tables([rest, table.cast(rest.schema)]) if rest else table, least, False)
                yield from done
        if rest is not None:
            yield from summed(rest, least, True)[0]

    ranges = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ranges.mapInArrow(run, MERGED).withColumn("range", F.spark_partition_id())


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / whole), SCALE = 1000^3, by long division: no step is above 1000 * whole."""
    out, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


class Traversal:
    """Of one language and strip of sources: distances and best terms, over the kept terms as they come."""

    def __init__(self, sources: list[str], totals: np.ndarray, kept: int, a: int, b: int, top: int) -> None:
        self.sources, self.index, self.top = sources, {s: i for i, s in enumerate(sources)}, top
        self.whole = totals + PRIOR * kept
        self.all = int(totals.sum()) + PRIOR * kept
        self.a, self.b = a, min(len(sources), b)  # the sources whose distances to all are added up
        self.distance = np.zeros((self.b - self.a, len(sources)), np.int64)
        self.best_source, self.best_value, self.best_term = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, words: list[str], row: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        """Terms in UTF-8 order, and the counters of their leaves: count of source in words[row]."""
        shares = np.repeat(share(np.full(len(self.sources), PRIOR), self.whole)[None], len(words), axis=0)
        shares[row, source] = share(count + PRIOR, self.whole[source])
        for a in range(self.a, self.b):
            self.distance[a - self.a] += np.abs(shares - shares[:, a : a + 1]).sum(0)
        both = np.zeros(len(words), np.int64)
        np.add.at(both, row, count)
        more = shares[row, source] - share(both + PRIOR, self.all)[row]
        good = (more > 0) & (source >= self.a) & (source < self.b)
        order = np.argsort(row[good], kind="stable")
        s, v = np.concatenate([self.best_source, source[good][order]]), np.concatenate([self.best_value, more[good][order]])
        t = np.concatenate([self.best_term, np.array(words, object)[row[good][order]]])
        order = np.lexsort((-v, s))  # stable: of equal values that term stays in front which came first
        s, v, t = s[order], v[order], t[order]
        ahead = np.arange(len(s)) - np.searchsorted(s, s)
        self.best_source, self.best_value, self.best_term = s[ahead < self.top], v[ahead < self.top], t[ahead < self.top]

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        columns = ["lang", "source", "part", "item", "value"]
        make = lambda source, part, item, value: pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(value), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=columns)
        for a in range(self.a, self.b):
            others = [i for i in range(len(self.sources)) if i != a]
            if others:
                yield make([self.sources[a]] * len(others), "pair", [self.sources[i] for i in others], self.distance[a - self.a][others])
        if len(self.best_term):
            yield make([self.sources[i] for i in self.best_source], "term", list(self.best_term), self.best_value)


def traversed(kept: DataFrame, groups: DataFrame, top: int = TOP, strip: int = STRIP, shares: int = SHARES) -> DataFrame:
    """lang, source, part, item, value: of each range of kept terms its share of the distances, and its candidates.

    groups (lang, source, total, terms) goes to every range as rows in front of the terms of its language, and to no driver."""
    strips = groups.groupBy("lang").agg(F.explode(F.sequence(F.lit(0), F.floor((F.count("*") - 1) / strip))).alias("strip"))
    strips = checked(strips)
    ranges = kept.select("range", "lang").distinct()
    places = ranges.unionByName(groups.select(F.lit(0).cast("int").alias("range"), "lang")).distinct().join(strips, "lang")
    none = F.array().cast("array<struct<source: string, n: long>>")
    heads = places.join(checked(groups), "lang").select("range", "strip", "lang", F.lit(0).alias("kind"), F.col("source").alias("item"), "total", "terms", none.alias("leaves"))
    words = kept.join(strips, "lang").select("range", "strip", "lang", F.lit(1).alias("kind"), F.col("term").alias("item"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"), "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, heads_of, now = None, [], None
        for batch in batches:
            for part in cut(batch):
                head, kind = tuple(part.column(k)[0].as_py() for k in range(3)), part.column(3)[0].as_py()
                if head != place:
                    yield from over(place, heads_of, now, strip, top)
                    place, heads_of, now = head, [], None
                if kind == 0:
                    heads_of += zip(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)
                    continue
                now = now or begun(place, heads_of, strip, top)
                step = max(1, shares // len(now.sources))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    leaves = some.column(7)
                    row = np.repeat(np.arange(some.num_rows), leaves.value_lengths().to_numpy())
                    flat = leaves.flatten()
                    source = np.fromiter(map(now.index.__getitem__, flat.field("source").to_pylist()), np.int64, len(flat))
                    now.add(some.column(4).to_pylist(), row, source, flat.field("n").to_numpy())
        yield from over(place, heads_of, now, strip, top)

    rows = heads.unionByName(words).repartition("range", "strip").sortWithinPartitions("range", "strip", "lang", "kind", "item")
    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


def checked(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch where range, strip, lang or kind change."""
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in range(4)])
    first = [*np.flatnonzero(new).tolist(), n]
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield batch.slice(a, b - a)


def begun(place: tuple, heads: list[tuple[str, int, int]], strip: int, top: int) -> Traversal:
    return Traversal([s for s, _, _ in heads], np.array([n for _, n, _ in heads], np.int64), heads[0][2], place[1] * strip, (place[1] + 1) * strip, top)


def over(place: tuple | None, heads: list, now: Traversal | None, strip: int, top: int) -> Iterator[pa.RecordBatch]:
    if place:
        yield from (now or begun(place, heads, strip, top)).rows(place[2])


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, buffer: int = BUFFER, strip: int = STRIP, shares: int = SHARES) -> DataFrame:
    """lang, source, part, item, value, rank. part pair: the distance of each group to each other source of its language; part term: the terms
    of which the group has a greater share than its language, up to `top`."""
    rows = docs.select(text_of(f"`{lang}`").alias("lang"), text_of(f"`{source}`").alias("source"), text_of(f"`{text}`").alias("text"))
    kept = written(merged(written(counted(rows, buffer), "tries"), least), "trie")
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    total = kept.select("lang", F.explode("leaves").alias("leaf")).groupBy("lang", F.col("leaf.source").alias("source")).agg(F.sum("leaf.n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "trie-groups")
    found = written(traversed(kept, groups, top, strip, shares), "trie-parts")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # a term stands in one range; the candidates of all ranges are cut down in parts first, so that no task gets those of a group from every range
    of = lambda *more: Window.partitionBy("lang", "source", "part", *more).orderBy(F.desc("value"), "item")
    some = found.filter("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(of("salt"))).filter(F.col("rank") <= top).drop("salt", "rank")
    return pairs.unionByName(some).withColumn("rank", F.row_number().over(of())).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances of sources and their terms, over all documents."""
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
x AS (SELECT id, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM x JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v))::HUGEINT AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
