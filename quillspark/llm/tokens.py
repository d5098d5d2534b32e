"""Words of Arrow text batches as NumPy arrays of 64-bit hashes.

Equal words have equal hashes; two different words of one corpus share a hash with a chance of about
(distinct words)^2 / 2^65, which the operators built on this accept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once; a longer single text is one piece.
PIECE = 1 << 20
LONG_WORD = 48

U = np.uint64

#: For words without case and punctuation: what separates them, and lower case.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) of about PIECE bytes each; a null counts as empty."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 in lower case."""
    data = _LOWER[data]
    if len(data) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][accent] += 32
    return data


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses from one row into the next."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    begins[cut] = True
    ends[cut] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a over the bytes of each word, finalised; words over LONG_WORD bytes by XXH64."""
    out = np.full(len(starts), 0xCBF29CE484222325, U)
    length = ends - starts
    live = np.arange(len(starts))
    with np.errstate(over="ignore"):
        for t in range(min(LONG_WORD, int(length.max(initial=0)))):
            live = live[length[live] > t]
            out[live] = (out[live] ^ data[starts[live] + t].astype(U)) * U(0x100000001B3)
        for k in np.flatnonzero(length > LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
        return mix64(out)


def word_hashes(texts: pa.Array, plain: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, row offsets into them) piece by piece. plain: words without case and punctuation."""
    for at, end, data, offsets in pieces(texts):
        if plain:
            data = lower(data)
        starts, ends = spans(data, offsets, NO_LETTER if plain else _BLANK)
        yield at, end, hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and row offsets into them. A row of 1 to k - 1 words has one shingle, of all its words."""
    n = np.diff(offsets)
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), U)
        for j in range(min(k, len(words))):
            total[: len(words) - j] += words[j:] * odd[j % 5] ** U(j // 5 + 1)
        whole = np.ones(len(words), bool)
        for row in np.flatnonzero((n > 0) & (n < k)):
            a, b = offsets[row], offsets[row + 1]
            total[a] = sum((int(words[a + j]) * int(odd[j % 5] ** U(j // 5 + 1)) for j in range(b - a)), int(b - a)) % (1 << 64)
            whole[a + 1 : b] = False
        last = offsets[1:][n >= k]
        for j in range(1, k):
            whole[last - j] = False
        count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
        return mix64(total[whole]), np.concatenate([[0], np.cumsum(count)])
