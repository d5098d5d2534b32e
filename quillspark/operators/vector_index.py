"""An inverted file over vectors: every vector belongs to the list of its nearest centroid, and a search reads the lists nearest to each query.

Centroids come from a bounded sample (`SAMPLE` vectors, the lowest hashes of their keys) by spherical k-means at the driver; every vector is
then assigned, in one pass without a shuffle, and the index is laid out by list. A search sends queries with their lists to the tasks,
in blocks, and each task multiplies its rows of a list with that list's queries alone. `probes` trades recall for work; with as many probes
as lists the result is exact. `semantic.knn_cosine` is the exact way without an index. Vectors of length 0 are at distance 1 from all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.frames import bounded_batches

from .best import CELLS
from .lexical import QUERY_BLOCK, ranked
from .semantic import nearest_of

#: Vectors that centroids are fitted to, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def stacked(rows: list) -> np.ndarray:
    """Unit rows of equally long lists."""
    return unit(np.array(rows, np.float64)) if rows else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's column of equally long lists as a matrix of unit rows."""
    return unit(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def nearest(rows: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first; of equally near ones the first."""
    near = rows @ centroids.T
    return near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


def fitted(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: the first is the first row, each further one the row farthest from all so far; then rounds of means. A list that
    loses all its rows takes the row that is farthest from its own centroid."""
    if not len(rows):
        return np.zeros((0, 0))
    picked, gap = [0], 1 - rows @ rows[0]
    while len(picked) < min(lists, len(rows)) and gap.max() > 1e-9:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, 1 - rows @ rows[picked[-1]])
    centroids = rows[picked].copy()
    for _ in range(rounds):
        near = rows @ centroids.T
        own = near.argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, rows)
        empty = np.bincount(own, minlength=len(centroids)) == 0
        if empty.any():
            far = np.argsort(near[np.arange(len(rows)), own], kind="stable")[: empty.sum()]
            total[empty] = rows[far]
        new = unit(total)
        if np.abs(new - centroids).max() < 1e-9:
            break
        centroids = new
    return centroids


def centroids_of(vectors: DataFrame, key: str, lists: int, vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centroids of at most `lists` lists, from the `sample` vectors whose keys have the lowest hashes."""
    low = vectors.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("h", "k").limit(sample)
    return fitted(stacked(low.select("v").toPandas()["v"].tolist()), lists)


def assigned(vectors: DataFrame, centroids: np.ndarray, key: str, vector: str = "embedding") -> DataFrame:
    """key, vector, list: every vector that isn't null with its list. Rows that come later are assigned with the same centroids and appended."""
    bounded_batches(vectors.sparkSession)
    shared, lot = vectors.sparkSession.sparkContext.broadcast(centroids), max(1, CELLS // max(1, len(centroids)))
    kinds = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in (key, vector)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.concatenate([nearest(matrix(batch.column(1).slice(a, lot)), shared.value)[:, 0] for a in range(0, batch.num_rows, lot)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[key, vector, "list"])

    return vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{', '.join(kinds)}, list int")


def laid_out(index: DataFrame, key: str) -> DataFrame:
    """The index by list, ready to be written: a list's rows lie together, so that a search skips files and row groups of other lists; those of a
    long list go on in the next file."""
    return index.repartitionByRange("list", key).sortWithinPartitions("list", key)


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, key: str, query_id: str, k: int, probes: int, vector: str = "embedding") -> DataFrame:
    """query_id, key, rank, distance, semantic_score: the k nearest rows among the `probes` nearest lists of each query."""
    return ranked(nearest_rows(index, centroids, queries, key, query_id, k, probes, vector), query_id, key, k, "semantic_score")


def nearest_rows(index: DataFrame, centroids: np.ndarray, queries: DataFrame, key: str, query_id: str, k: int, probes: int, vector: str = "embedding") -> DataFrame:
    """query_id, key, distance, semantic_score: of each task's rows in those lists the k nearest of each query, by matrices of CELLS cells."""
    bounded_batches(index.sparkSession)
    kinds = (index.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString())
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    best = None
    for b in range(blocks):
        rows = (asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()
        ids, own = [r["q"] for r in rows], stacked([r["v"] for r in rows])
        near = nearest(own, centroids, probes) if len(rows) and len(centroids) else np.zeros((0, 0), int)
        of_list = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = index.sparkSession.sparkContext.broadcast((ids, own, of_list))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, own, of_list = shared.value
            best = nearest_of(k, len(ids))
            for batch in batches:
                lists = batch.column("list").to_numpy()
                order = np.argsort(lists, kind="stable")
                cuts = np.flatnonzero(np.diff(lists[order])) + 1
                for at in np.split(order, cuts) if len(order) else []:
                    asking = of_list.get(int(lists[at[0]]))
                    lot = max(1, CELLS // max(1, len(asking))) if asking is not None else 1
                    for a in range(0, len(at) if asking is not None else 0, lot):
                        some = pa.array(at[a : a + lot])
                        best.add(own[asking] @ matrix(batch.column("v").take(some)).T, batch.column("k").take(some), asking)
            yield from best.batches(ids, "distance", lambda c: 1 - c)

        lists = index.filter(F.col("list").isin([int(c) for c in of_list])) if len(of_list) < len(centroids) else index
        part = lists.select(F.col(key).alias("k"), F.col(vector).alias("v"), "list").mapInArrow(run, f"q {kinds[1]}, k {kinds[0]}, distance double")
        best = part if best is None else best.unionByName(part)
    return best.select(F.col("q").alias(query_id), F.col("k").alias(key), "distance", (1 / (1 + F.greatest(F.lit(0.0), F.col("distance")))).alias("semantic_score"))


def recall(found: DataFrame, exact: DataFrame, query_id: str, key: str, k: int, margin: float = 1e-6) -> DataFrame:
    """query_id, wanted, hit: of the exact neighbours of each query those found. A row as near as the last exact one counts as well."""
    edge = exact.groupBy(query_id).agg(F.max("distance").alias("edge"), F.count("*").alias("wanted"))
    got = found.join(edge, query_id).filter(F.col("distance") <= F.col("edge") + margin).groupBy(query_id).agg(F.least(F.lit(k), F.count("*")).alias("hit"))
    return edge.join(got, query_id, "left").select(query_id, "wanted", F.coalesce("hit", F.lit(0)).alias("hit"))
