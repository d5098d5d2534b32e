"""Which texts hold which passages whole, for many texts and many passages.

Texts and passages meet by rolling hashes of WIDTH bytes: of every WINDOW neighbouring ones the least is a fingerprint of the text (`fingerprints`),
so whatever text holds a passage of WIDTH + WINDOW - 1 bytes or more has all of the passage's fingerprints among its own. Each passage is looked for by its rarest
one, and only where that occurs the passage itself is compared with the text. Shorter passages are looked for by their rarest n-gram.
Only keys and fingerprints are shuffled; texts are fetched for pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.frames import kept, small_side, spread

from .alias_tables import rarest_grams

#: Bytes of a rolling hash, and neighbouring hashes of which the least is kept (a power of two).
WIDTH, WINDOW = 16, 16
SHORTEST = WIDTH + WINDOW - 1
#: Bytes of text that are hashed at once, whole texts at least.
LOT = 1 << 20

U = np.uint64
BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def least_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of texts that lie one after the other in data, each pair once. Texts under SHORTEST bytes have none."""
    n = len(data) - SHORTEST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=sums[1:])
        least = mixed((sums[WIDTH:] - sums[:-WIDTH]) * powers(BACK, len(sums) - WIDTH))
    step = 1
    while step < WINDOW:  # the least of 2, 4, 8, ... neighbours
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    inside = np.arange(n) + SHORTEST <= offsets[text + 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:n] != least[: n - 1]) | (text[1:] != text[:-1])
    some = inside & new
    pairs = np.unique(np.stack([text[some].astype(U), least[:n][some]]), axis=1) if some.any() else np.zeros((2, 0), U)
    return pairs[0].astype(np.int64), pairs[1].view(np.int64)


def fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp: the fingerprints of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data or b"", np.uint8)
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + LOT, side="right")) - 1)
                row, fp = least_hashes(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(fp)], names=[key, "fp"])
                at = end

    rows = texts.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, fp long")


def containment(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """item, key: every passage that isn't null or empty, with every text that holds it."""
    docs, listed = docs.select(key, text), items.select(item, passage).filter(F.col(passage) != "")
    long = listed.filter(F.octet_length(passage) >= SHORTEST)
    marks = kept(fingerprints(long, item, passage).distinct(), "passage-marks")
    wanted = small_side(marks.select("fp").distinct())
    there = kept(fingerprints(spread(docs), key, text).join(wanted, "fp", "left_semi"), "text-marks")
    counts = there.groupBy("fp").agg(F.count("*").alias("n"))
    rarest = marks.join(small_side(counts), "fp", "left").groupBy(item).agg(F.min_by("fp", F.struct(F.coalesce("n", F.lit(0)), "fp")).alias("fp"))
    pairs = there.join(small_side(rarest), "fp").select(item, key)
    short = listed.filter(F.octet_length(passage) < SHORTEST)
    if short.limit(1).count():
        few = short.groupBy(passage).agg(F.collect_set(item).alias("_items"))
        there, grams = rarest_grams(docs, key, text, few.select(F.col(passage).alias("alias")))
        pairs = pairs.unionByName(there.join(small_side(grams), "gram").select(key, "alias").join(small_side(few), F.col("alias") == F.col(passage)).select(F.explode("_items").alias(item), key))
    held = docs.join(small_side(pairs.distinct()), key).join(small_side(listed), item)
    return held.filter(F.col(text).contains(F.col(passage))).select(item, key).distinct()
