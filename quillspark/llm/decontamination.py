"""Benchmark decontamination by spaced-seed hashing.

A mask says which of a few consecutive words are hashed; a substituted word at an ignored place changes nothing. The seeds
of the benchmark, under every mask, are joined with those of the documents by hash; around each hit, item and document are
compared word by word on the hit's diagonal. An overlap counts if in some window of WINDOW words (or the whole item, if shorter) at
least LEAST of the words agree. The masks of an item's length together leave no pattern of that many substitutions without a hit.

Words are compared without case and punctuation; in scripts that are written without blanks every character is a word. A benchmark of
at most BLOCK_BYTES goes to the tasks as one block, and each document is searched whole, where it lies, without a shuffle. A larger one is
joined: its seeds are a table, the documents' seeds that a bit filter of bounded size lets through are another, both with the words around
them, so that a joined row is verified by itself; it takes one pass over the documents whatever the benchmark's size. Results are the same.

Defined results: items of fewer than SHORTEST words match nothing, or with `exact_short` (the query and the pipeline) where a text holds all their
words in order and unchanged; items without words and null texts match nothing; an item and
a document give one row, with their best overlap (of equal ones, the first in the document); rows that repeat give a row each; very long texts are
searched whole; an empty table on either side gives an empty result. Of both tables only key and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, set_aside, written
from .tokens import U, mix64, word_hashes

MASKS = ("11111", "111011", "110111")
WINDOW, LEAST, SHORTEST = 20, 0.8, 8

#: Besides MASKS, for items of fewer than DENSE words: two words changed out of ten or eleven can leave no longer run.
FEW, DENSE = "1111", 12

#: Scripts that are written without blanks between words.
_UNSPACED = ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Balinese")

#: Benchmark texts of up to so many bytes are broadcast (a task holds about 50 times as much); larger ones are joined.
BLOCK_BYTES = 4 << 20

#: Texts found by the join that are broadcast to leave them out; beyond that, documents are shuffled once.
BROADCAST_ROWS = 500_000

#: Words around a seed that its row carries: all windows that hold the seed's first word.
_BEFORE, _AROUND = WINDOW - 1, 2 * WINDOW + 4

#: Hits that are verified at once.
LOT = 20_000

#: Rows of one seed in a task of the join; a more frequent seed is dealt out, and meets its items in every part.
PORTION = 50_000

_FILTER_BITS, _MOST_BITS = 22, 28


def spaced(texts: pa.Array) -> pa.Array:
    """texts in lower case with blanks for what is no letter, mark or digit, and around characters of unspaced scripts; ASCII texts as they are."""
    foreign = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    some = pc.utf8_lower(texts.filter(foreign))
    if not len(some):
        return texts
    some = pc.replace_substring_regex(some, r"[^\x00-\x7F\p{L}\p{N}\p{M}]+", " ")
    some = pc.replace_substring_regex(some, "([" + "".join(rf"\p{{{x}}}" for x in _UNSPACED) + "])", r" \1 ")
    return pc.replace_with_mask(texts, foreign, some)


def masks_of(n: int, exact_short: bool = False) -> tuple[str, ...]:
    """The masks for an item of n words."""
    if n < SHORTEST:
        return ("1" * n,) if exact_short and n else ()
    return (*MASKS, FEW) if n < DENSE else MASKS


def seeds(words: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask at every place where it lies inside a row, and these places."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(words) - span + 1
    total = np.full(n, int(mask, 2), U)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                total += words[j : j + n] * mix64(np.array([j + 1], U))
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.flatnonzero(np.arange(n) + span <= ends)
    return mix64(total[inside]), inside


def context_of(words: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The _AROUND words of which the one at `at` has number _BEFORE; `none` where the row has no word."""
    there = at[:, None] + np.arange(-_BEFORE, _AROUND - _BEFORE)
    ok = (there >= offsets[row][:, None]) & (there < offsets[row + 1][:, None])
    return np.ascontiguousarray(np.where(ok, words[np.where(ok, there, 0)], U(none)))


def distinct_places(words: np.ndarray, offsets: np.ndarray, row: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places of seeds to keep: of those with one seed, in one row, with the same words around them, the first. A word that
    repeats a thousand times is then looked at as often as its surroundings differ, not a thousand times."""
    lot = 1 << 16
    odd = mix64(np.arange(1, _AROUND + 1).astype(U))
    with np.errstate(over="ignore"):
        around_it = [(context_of(words, offsets, row[k : k + lot], at[k : k + lot], 1) * odd).sum(axis=1, dtype=U) for k in range(0, len(at), lot)]
        same = mix64(np.concatenate(around_it) if around_it else np.zeros(0, U)) ^ mix64(key + row.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.lexsort((at, same))
    first = np.ones(len(order), bool)
    first[1:] = same[order[1:]] != same[order[:-1]]
    return np.sort(order[first])


def judge(a: np.ndarray, b: np.ndarray, n: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which overlap, start of the best window in the context, window, equal words) of hits with the contexts a of documents and b of items;
    n: the items' words, item_at: the hit's place in the item."""
    total = np.concatenate([np.zeros((len(n), 1), np.int64), np.cumsum(a == b, axis=1)], axis=1)
    window = np.minimum(n, WINDOW)
    out = []
    for w in np.unique(window):
        rows = np.flatnonzero(window == w)
        equal = total[rows, w:] - total[rows, :-w]
        first = item_at[rows][:, None] - _BEFORE + np.arange(equal.shape[1])  # of the window, in the item
        equal = np.where((first >= 0) & (first + w <= n[rows][:, None]), equal, -1)
        best = equal.argmax(axis=1)
        equal = equal[np.arange(len(rows)), best]
        yes = equal >= (LEAST * w - 1e-9 if w >= SHORTEST else w)
        out.append(np.stack([rows, best, np.full(len(rows), w), equal])[:, yes])
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 4


class Block:
    """Part of the benchmark: its words, and its seeds in order of hash."""

    def __init__(self, ids: list, texts: list[str | None], exact_short: bool = False):
        self.ids = pa.array(ids)
        parts = [(w, np.diff(o)) for _, _, w, o in word_hashes(spaced(pa.array(texts, pa.string())), plain=True)]
        self.words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, U)
        n = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(n)])
        item = np.repeat(np.arange(len(n)), n)
        lengths = {int(x): masks_of(int(x), exact_short) for x in np.unique(n)}
        self.masks = list(dict.fromkeys(m for own in lengths.values() for m in own))
        keys, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for mask in self.masks:
            k, p = seeds(self.words, self.offsets, mask)
            meant = np.isin(n[item[p]], [x for x, own in lengths.items() if mask in own])
            keys.append(k[meant])
            places.append(p[meant])
        key, place = np.concatenate(keys), np.concatenate(places)
        some = distinct_places(self.words, self.offsets, item[place], key, place)
        key, place = key[some], place[some]
        order = np.argsort(key, kind="stable")
        self.keys, self.places, self.item = key[order], place[order], item
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> U(64 - _FILTER_BITS)] = True

    def search(self, texts: pa.Array) -> Iterator[tuple]:
        """(row, item, first word, window, equal words) as arrays, for each piece of texts; one entry per row and item."""
        if not self.masks:
            return
        n_words = np.diff(self.offsets)
        for at, _, words, offsets in word_hashes(spaced(texts), plain=True):
            found = [np.zeros((5, 0), np.int64)]
            for mask in self.masks:
                k, p = seeds(words, offsets, mask)
                near = np.flatnonzero(self.filter[k >> U(64 - _FILTER_BITS)])
                k, p = k[near], p[near]
                lo, hi = np.searchsorted(self.keys, k), np.searchsorted(self.keys, k, side="right")
                some = np.flatnonzero(hi > lo)
                row = np.searchsorted(offsets, p[some], side="right") - 1
                kept = distinct_places(words, offsets, row, k[some], p[some])
                row, some = row[kept], some[kept]
                n = hi[some] - lo[some]
                ends = np.cumsum(n)
                begin = 0
                while begin < len(some):  # as many hits at once as LOT, one place's at least
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LOT, side="right")))
                    found.append(self._overlapping(words, offsets, row[begin:end], p[some[begin:end]], lo[some[begin:end]], n[begin:end], n_words))
                    if len(found) > 64:
                        found = [best_of(np.concatenate(found, axis=1))]
                    begin = end
            row, item, first, window, equal = best_of(np.concatenate(found, axis=1))
            if len(row):
                yield at + row, item, first, window, equal

    def _overlapping(self, words, offsets, row, place, lo, n, n_words) -> np.ndarray:
        """row, item, first word, window, equal words: of the hits of places with the n seeds from lo on the best of each row and item."""
        out = [np.zeros((5, 0), np.int64)]
        total = int(n.sum())
        which = np.repeat(np.arange(len(n)), n)
        own = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        for a in range(0, total, LOT):  # one place may have more seeds than a lot
            d, there = which[a : a + LOT], self.places[own[a : a + LOT]]
            item = self.item[there]
            left = context_of(words, offsets, row[d], place[d], 1)
            right = context_of(self.words, self.offsets, item, there, 0)
            hit, best, window, equal = judge(left, right, n_words[item], there - self.offsets[item])
            d = d[hit]
            out.append(best_of(np.stack([row[d], item[hit], place[d] - _BEFORE + best - offsets[row[d]], window, equal])))
        return np.concatenate(out, axis=1)


def best_of(rows: np.ndarray) -> np.ndarray:
    """Of (row, item, first word, window, equal words) the best of each row and item, of equal ones the first in the row."""
    row, item, first, _, equal = rows
    order = np.lexsort((first, -equal, item, row))  # a row's windows with one item are of one length
    one = np.ones(len(order), bool)
    one[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
    return rows[:, order[one]]


def fits_block(items: DataFrame, text: str) -> bool:
    return (items.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0) <= BLOCK_BYTES


def block_of(items: DataFrame, key: str, text: str, exact_short: bool) -> Block:
    """The whole benchmark, of at most BLOCK_BYTES."""
    rows = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").toPandas()
    return Block(rows["id"].tolist(), rows["text"].tolist(), exact_short)


def fingerprint(text: str) -> F.Column:
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def around(words: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray, none: int) -> pa.Array:
    """context_of as a column."""
    context = context_of(words, offsets, row, at, none)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_AROUND * 8), len(at), [None, pa.py_buffer(context)]).cast(pa.binary())


def item_seeds(items: DataFrame, text: str, exact_short: bool) -> DataFrame:
    """item (fingerprint), n (its words), mask, h, at (word), context: the seeds of all items, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Block(list(range(batch.num_rows)), batch.column("text").to_pylist(), exact_short)
            n = np.diff(b.offsets)
            for lo in range(0, len(b.keys), 10_000):
                at = b.places[lo : lo + 10_000]
                item = b.item[at]
                yield pa.RecordBatch.from_arrays([batch.column("fp").take(pa.array(item)), pa.array(n[item]), pa.array(b.keys[lo : lo + 10_000].view(np.int64)), pa.array(at - b.offsets[item]), around(b.words, b.offsets, item, at, 0)], names=["item", "n", "h", "item_at", "item_context"])

    texts = items.select(fingerprint(text).alias("fp"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").dropDuplicates(["fp"])
    return texts.mapInArrow(run, "item binary, n long, h long, item_at long, item_context binary")


def seed_filter(seeds_of_items: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words): bit i is set if some seed begins with the bits of i. Of bounded size: 2^_MOST_BITS bits, made by a grouped aggregation."""
    bits = min(_MOST_BITS, max(_FILTER_BITS, seeds_of_items.count().bit_length() + 4))
    slot = F.shiftrightunsigned("h", 64 - bits)
    got = seeds_of_items.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), U)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(U)
    return bits, out


def joined_overlaps(docs: DataFrame, items: DataFrame, text: str, item_text: str, exact_short: bool) -> DataFrame:
    """doc, item (fingerprints of texts), first_word, window, equal_words of all that overlap: seed tables joined by hash, one pass over docs."""
    wanted = written(item_seeds(items, item_text, exact_short), "seeds-items")
    filter_of = docs.sparkSession.sparkContext.broadcast(seed_filter(wanted))
    masks = list(dict.fromkeys((*MASKS, FEW, *("1" * n for n in range(1, SHORTEST) if exact_short))))
    used = docs.sparkSession.sparkContext.broadcast(masks)

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = filter_of.value
        for batch in batches:
            for row0, _, words, offsets in word_hashes(spaced(batch.column("text")), plain=True):
                for mask in used.value:
                    k, p = seeds(words, offsets, mask)
                    slot = k >> U(64 - bits)
                    near = np.flatnonzero(table[slot >> U(6)] >> (slot & U(63)) & U(1))
                    near = near[distinct_places(words, offsets, np.searchsorted(offsets, p[near], side="right") - 1, k[near], p[near])]
                    for lo in range(0, len(near), 10_000):
                        at = p[near[lo : lo + 10_000]]
                        row = np.searchsorted(offsets, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays([batch.column("fp").take(pa.array(row0 + row)), pa.array(k[near[lo : lo + 10_000]].view(np.int64)), pa.array(at - offsets[row]), around(words, offsets, row, at, 1)], names=["doc", "h", "doc_at", "doc_context"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), U).reshape(-1, _AROUND) for c in ("doc_context", "item_context"))
                n, item_at, doc_at = (np.asarray(part.column(c)) for c in ("n", "item_at", "doc_at"))
                hit, best, window, equal = judge(a, b, n, item_at)
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(at), part.column("item").take(at), pa.array(doc_at[hit] - _BEFORE + best), pa.array(window), pa.array(equal)], names=["doc", "item", "first_word", "window", "equal_words"])

    texts = docs.select(fingerprint(text).alias("fp"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    met = written(texts.mapInArrow(seeds_of, "doc binary, h long, doc_at long, doc_context binary"), "seeds-docs").dropDuplicates(["doc", "h", "doc_at"])
    portions = wanted.select("h").distinct().join(met.groupBy("h").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions")), "h")
    dealt = met.join(portions, "h").withColumn("portion", F.pmod(F.xxhash64("doc"), F.col("portions")).cast("int"))
    spread_out = wanted.join(portions, "h").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    hits = dealt.join(spread_out, ["h", "portion"]).select("doc", "item", "n", "item_at", "doc_at", "item_context", "doc_context").mapInArrow(judged, "doc binary, item binary, first_word long, window long, equal_words long")
    best = hits.groupBy("doc", "item").agg(F.max(F.struct("equal_words", (-F.col("first_word")).alias("f"), "window")).alias("b"))
    return written(best.select("doc", "item", (-F.col("b.f")).alias("first_word"), "b.window", "b.equal_words"), "seeds-overlaps")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", exact_short: bool = False) -> DataFrame:
    """doc_id, item_id, first_word (of the best window, counted from 0), window, equal_words: one row for each pair that overlaps."""
    bounded_batches(docs.sparkSession)
    if not fits_block(items, item_text):
        found = joined_overlaps(docs, items, text, item_text, exact_short)
        named = found.join(items.select(F.col(f"`{item_key}`").alias("item_id"), fingerprint(item_text).alias("item")), "item")
        rows = docs.select(F.col(f"`{key}`").alias("doc_id"), fingerprint(text).alias("doc"))
        return rows.join(named, "doc").select("doc_id", "item_id", "first_word", "window", "equal_words")
    kinds = (docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString())
    shared = docs.sparkSession.sparkContext.broadcast(block_of(items, item_key, item_text, exact_short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for row, item, first, window, equal in b.search(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), b.ids.take(pa.array(item)), pa.array(first), pa.array(window), pa.array(equal)], names=["doc_id", "item_id", "first_word", "window", "equal_words"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, window long, equal_words long")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", exact_short: bool = False) -> DataFrame:
    """docs without the rows that overlap with an item."""
    bounded_batches(docs.sparkSession)
    plain, back = set_aside(docs, text)
    if not fits_block(items, item_text):
        gone = written(joined_overlaps(docs, items, text, item_text, exact_short).select(F.col("doc").alias("_seed_fp")).distinct(), "seeds-gone")
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return back(plain.join(gone, fingerprint(text) == F.col("_seed_fp"), "left_anti"))
    shared = docs.sparkSession.sparkContext.broadcast(block_of(items, item_key, item_text, exact_short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for row, *_ in shared.value.search(batch.column(text)):
                clean[row] = False
            yield batch.filter(pa.array(clean))

    return back(plain.mapInArrow(run, plain.schema))


def op7_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    return overlaps(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), exact_short=True)
