"""The best rows of each query within a task, so that only those are shuffled, whatever a table holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are ranked to so many digits, and then by key.
SCORE_DIGITS = 8
#: Cells of a matrix (queries by rows) that are worked on at once, and candidates that are held before they are cut down.
CELLS = 1 << 20


class Best:
    """The k best (query, key, value) of n queries, by score (a rising function of value) to SCORE_DIGITS digits, then key. least: smaller
    values don't count. margin: values that differ by more have different scores."""

    def __init__(self, k: int, n: int, score: Callable[[np.ndarray], np.ndarray] = lambda x: x, margin: float = 2e-8, least: float = -np.inf):
        self.k, self.score, self.margin, self.edge = k, score, margin, np.full(n, least, np.float64)
        self.most, self.held, self.parts = max(CELLS, 4 * k * n), 0, []

    def add(self, values: np.ndarray, keys: pa.Array, queries: np.ndarray | None = None) -> None:
        """values: a row for each query (those of `queries`, or all), a column for each key."""
        edge = self.edge if queries is None else self.edge[queries]
        if values.shape[1] > self.k and np.count_nonzero(values >= edge[:, None]) > 4 * self.k * len(edge):
            edge = np.maximum(edge, np.partition(values, -self.k, axis=1)[:, -self.k] - self.margin)
        q, at = np.nonzero(values >= edge[:, None])
        if len(q):
            self.parts.append((q if queries is None else queries[q], keys.take(pa.array(at)), values[q, at]))
            self.held += len(q)
        if self.held > self.most:
            self.settled()

    def settled(self) -> pa.Table:
        """q, k, value: what is best so far; from now on only what may be better is taken in."""
        if not self.parts:
            return pa.table({"q": pa.array([], pa.int64()), "k": pa.array([], pa.null()), "value": pa.array([], pa.float64())})
        q, value = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        keys = pa.chunked_array([p[1] for p in self.parts])
        rows = pa.table({"q": q, "s": np.round(self.score(value), SCORE_DIGITS), "k": keys})
        order = pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("s", "descending"), ("k", "ascending")]).to_numpy()
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, last = order[place < self.k], order[place == self.k - 1]
        rows = pa.table({"q": rows["q"], "k": keys, "value": value})
        full = rows["q"].to_numpy()[last]
        self.edge[full] = np.maximum(self.edge[full], value[last] - self.margin)
        rows = rows.take(pa.array(order)).combine_chunks()
        self.parts, self.held = [(rows["q"].to_numpy(), rows["k"].combine_chunks(), rows["value"].to_numpy())], rows.num_rows
        return rows

    def batches(self, ids: list, value: str, told: Callable[[np.ndarray], np.ndarray] = lambda x: x):
        """The settled rows as one batch: q (its id), k, and the told value."""
        rows = self.settled()
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(rows["q"].combine_chunks()), rows["k"].combine_chunks(), pa.array(told(rows["value"].to_numpy()))], names=["q", "k", value])
