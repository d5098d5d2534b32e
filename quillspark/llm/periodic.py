"""Periodic runs of words: stretches in which words repeat with a smallest period q, at least four times over.

A run of period q and length L is a stretch of L - q places where the word equals the one q further on. Such a stretch is at least
as long as the spacing of that period's grid, max(6, 4q) - q, so it covers a grid point. `runs_of` lays out the grids of all periods of
all texts of a batch (n words have about n/3 ln(n/4) points: a harmonic sum), keeps the points whose two words agree, and finds how far the
agreement reaches to both sides for all of them simultaneously, by binary search over prefix hashes in NumPy. What the hashes say is
then verified word by word, and multiples of a period, which reach exactly as far, are dropped.

Defined results: a null or empty text has no words and no runs; repeated rows each get their result; a column of the input named like a
result is replaced; an empty table gives an empty table; a text of any length is one row's work, of memory linear in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, read_table, text_of, words_array
from .tokens import U, mix64

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Grid points worked on at once, and words of short texts taken together.
POINTS, TOGETHER = 1 << 20, 1 << 17
#: Bytes of a text cut into words at once.
CUT = 1 << 20
BLANKS = b" \t\n\v\f\r"

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """_BASE^0 .. ^n modulo 2^64."""
    global _powers
    if len(_powers) <= n:
        many = np.full(max(n + 1, 2 * len(_powers)), _BASE, U)
        many[0] = 1
        _powers = np.multiply.accumulate(many)
    return _powers


def word_ids(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers of `ids`, which grows by new words. Only distinct words are kept as objects."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CUT)
        while end < len(text) and text[end] not in BLANKS:  # to the end of a word
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def grids(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place in the text) of all grid points of texts of n words, about POINTS at a time."""
    most = np.where(n >= LEAST, n // TIMES, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    space = np.maximum(LEAST, TIMES * period) - period
    points = -(-(n[text] - period) // space)
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, side="right")))
        k = points[at:end]
        place = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * np.repeat(space[at:end], k)
        yield np.repeat(text[at:end], k), np.repeat(period[at:end], k), place
        at = end


def reach(equal, most: np.ndarray) -> np.ndarray:
    """For each element the greatest length up to `most` for which equal(lengths, which) holds: a binary search of all at once."""
    low, high = np.zeros_like(most), most.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        good = equal(middle, open_)
        low[open_[good]] = middle[good]
        high[open_[~good]] = middle[~good] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def exact_reach(ids: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """Start and end of the run of a period around a place of one text, word by word."""
    differ = np.flatnonzero(ids[:-period] != ids[period:])
    k = np.searchsorted(differ, place)
    return int(differ[k - 1] + 1) if k else 0, int(differ[k] if k < len(differ) else len(ids) - period) + period


def runs_of(ids: np.ndarray, offsets: np.ndarray, hashed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. ids: equal numbers are equal words. hashed: a 64-bit hash of each
    word (made from ids; tests give worse ones)."""
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        base = powers(len(ids))
        sums = np.zeros(len(ids) + 1, U)
        np.cumsum((mix64(ids.astype(U) + U(_BASE)) if hashed is None else hashed) * base[: len(ids)], out=sums[1:])
        found = []
        for text, period, place in grids(n):
            x = offsets[text] + place
            hit = ids[x] == ids[x + period]
            text, period, x = text[hit], period[hit], x[hit]
            shift = base[period]
            first, last = offsets[text], offsets[text + 1]

            def ahead(length, k):
                a, p = x[k], period[k]
                return (sums[a + length] - sums[a]) * shift[k] == sums[a + p + length] - sums[a + p]

            def back(length, k):
                a, p = x[k], period[k]
                return (sums[a] - sums[a - length]) * shift[k] == sums[a + p] - sums[a + p - length]

            end = x + reach(ahead, last - x - period) + period
            start = x - reach(back, x - first)
            long = end - start >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack([text[long], start[long], end[long], period[long], x[long]]))
    text, start, end, period, x = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    text, start, end, period, x = deduplicated(text, start, end, period, x)
    wrong = {int(text[k]) for k in range(len(text)) if not np.array_equal(ids[start[k] : end[k] - period[k]], ids[start[k] + period[k] : end[k]])}
    if wrong:  # a hash said that different words were equal: these texts again, by words
        clean = ~np.isin(text, sorted(wrong))
        parts = [np.stack([text, start, end, period, x])[:, clean]]
        for k in sorted(wrong):
            parts.append(exact_runs(ids, offsets, k))
        text, start, end, period, x = deduplicated(*np.concatenate(parts, axis=1))
    return text, start - offsets[text], end - start, period


def exact_runs(ids: np.ndarray, offsets: np.ndarray, text: int) -> np.ndarray:
    """The rows of text, start, end, period, place for one text, without hashes."""
    own, out = ids[offsets[text] : offsets[text + 1]], []
    for _, period, place in grids(np.array([len(own)])):
        for p, k in zip(period.tolist(), place.tolist(), strict=True):
            if own[k] == own[k + p]:
                start, end = exact_reach(own, k, p)
                if end - start >= max(LEAST, TIMES * p):
                    out.append((text, offsets[text] + start, offsets[text] + end, p, offsets[text] + k))
    return np.array(out, np.int64).reshape(-1, 5).T


def deduplicated(text, start, end, period, x):
    """Of the periods of one stretch the smallest; by text, start and period."""
    order = np.lexsort((period, end, start))
    text, start, end, period, x = text[order], start[order], end[order], period[order], x[order]
    new = np.ones(len(text), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, period, x = text[new], start[new], end[new], period[new], x[new]
    order = np.lexsort((period, start))
    return text[order], start[order], end[order], period[order], x[order]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of a text's n words a run has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def of_texts(texts: list[bytes]) -> Iterator[tuple[list[dict], bytes, int]]:
    """Runs, collapsed text and number of words of each text; short texts are worked on together."""
    at = 0
    while at < len(texts):
        ids: dict[bytes, int] = {}
        own, n = [], 0
        while at + len(own) < len(texts) and (not own or n < TOGETHER):
            own.append(word_ids(texts[at + len(own)], ids))
            n += len(own[-1])
        at += len(own)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        text, start, length, period = runs_of(np.concatenate(own), offsets)
        words = list(ids)
        cut = np.searchsorted(text, np.arange(len(own) + 1))
        for k, x in enumerate(own):
            a, b = cut[k], cut[k + 1]
            if b > a:
                x = x[~dropped(len(x), start[a:b], length[a:b], period[a:b])]
            runs = [{"start": s, "length": m, "period": p} for s, m, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)]
            yield runs, b" ".join(map(words.__getitem__, x.tolist())), len(own[k])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs (start, length, period; words numbered from 0, by start and period) and collapsed: the words outside of all runs'
    repetitions, parted by single blanks. A word is dropped if any run has it after that run's first period."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(of_texts([x or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]))
            made = [pa.array([r for r, _, _ in got], pa.list_(RUN)), pa.array([c for _, c, _ in got], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "runs", "collapsed"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], text_of(f"`{text}`").alias("_text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], "runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    return rows.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length; of several the first, and of these that with the smallest period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def repeating(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a tail that repeats in a tenth of them: with h = crc32(key in decimal), g = h div 10 and n words, where 10 divides h, each word
    from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those of null keys, stay."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_array(text_of(text))

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.transform(w, lambda _, i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))

    made = F.array_join(F.transform(F.array(words), tail)[0], " ")
    return docs.withColumn(text, F.when((F.pmod(h, F.lit(10)) == 0) & text_of(text).rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col(text)))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, a tenth of which gets a repeating tail."""
    found = periodic_runs(repeating(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.col("best")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
