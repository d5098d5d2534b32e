"""Letter n-grams of words, as packed bytes, and a lookup table for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tokens import NO_LETTER, U, hashes, lower, mix64, pieces, spans

ORDER = 6


class Table:
    """An open-addressing hash table of numbers by 64-bit key, looked up by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(10, int(len(keys) * 1.5).bit_length())
        self.keys, self.values, self.mask = np.zeros(size, U), np.zeros(size, np.float32), U(size - 1)
        keys, values = keys.astype(U), values.astype(np.float32)
        at = mix64(keys) & self.mask
        while len(keys):
            free = self.keys[at] == 0
            _, one = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[one]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + U(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys were found."""
        value, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        live, at = np.arange(len(keys)), mix64(keys) & self.mask
        while len(live):
            there = self.keys[at]
            hit = there == keys[live]
            value[live[hit]], found[live[hit]] = self.values[at[hit]], True
            on = ~hit & (there != 0)
            live, at = live[on], (at[on] + U(1)) & self.mask
        return value, found


def typed(texts: pa.Array) -> Iterator[tuple]:
    """Piece by piece: first and last row, row offsets into words, each word's type, and the types' letters: bytes with a
    space on both sides, and offsets into them."""
    for at, end, data, offsets in pieces(texts):
        data = lower(data)
        starts, ends = spans(data, offsets, NO_LETTER)
        _, one, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        starts_of, size = starts[one], ends[one] - starts[one]
        o = np.concatenate([[0], np.cumsum(size + 2)])
        letters = np.full(int(o[-1]), 32, np.uint8)
        if len(one):
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            letters[np.repeat(o[:-1] + 1, size) + within] = data[np.repeat(starts_of, size) + within]
        yield at, end, np.searchsorted(starts, offsets), which, letters, o


def grams(letters: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter but the leading spaces: the last ORDER bytes up to it as a number, how many of them lie inside its
    word, and its type."""
    kind = np.repeat(np.arange(len(o) - 1), np.diff(o))
    place = np.arange(len(letters)) - o[:-1][kind]
    key = np.zeros(len(letters), U)
    for m in range(min(ORDER, len(letters))):
        key[m:] |= letters[: len(letters) - m].astype(U) << U(8 * m)
    inside = np.minimum(place + 1, ORDER)
    key &= (U(1) << (U(8) * inside.astype(U))) - U(1)
    keep = place > 0
    return key[keep], inside[keep], kind[keep]


def below(key: np.ndarray, order: int) -> np.ndarray:
    return key & ((U(1) << U(8 * order)) - U(1))
