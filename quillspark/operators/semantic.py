"""Semantic retrieval: hash embeddings, exact cosine neighbours, index inspection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.frames import bounded_batches

from .best import CELLS, Best
from .lexical import QUERY_BLOCK, ranked


def hash_embedding(text: Column) -> Column:
    """32 numbers in [-1, 1], the bytes of the text's SHA-256."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)


def nearest_of(k: int, n: int) -> Best:
    """The k best cosines of n queries, by semantic score; its slope is a ninth at least."""
    return Best(k, n, lambda c: 1 / (1 + np.maximum(0.0, 1 - c)), 1e-7)


def knn_cosine(vectors: DataFrame, queries: DataFrame, key: str, query_id: str, k: int, vector: str = "embedding") -> DataFrame:
    """query_id, key, rank, distance (1 - cosine), semantic_score: the k nearest rows of each query, exactly."""
    return ranked(nearest_rows(vectors, queries, key, query_id, k, vector), query_id, key, k, "semantic_score")


def nearest_rows(vectors: DataFrame, queries: DataFrame, key: str, query_id: str, k: int, vector: str = "embedding") -> DataFrame:
    """query_id, key, distance, semantic_score: of each task's rows the k nearest of each query.

    Each task keeps its k best per query by matrix products of CELLS cells; only those are shuffled. Queries go out in blocks of
    QUERY_BLOCK. Vectors of length 0 are at distance 1 from all.
    """
    bounded_batches(vectors.sparkSession)
    kinds = (vectors.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString())
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    blocks = -(-asked.count() // QUERY_BLOCK)
    best = None
    for b in range(max(1, blocks)):
        rows = (asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()
        ids = [r["q"] for r in rows]
        matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            best = nearest_of(k, len(ids))
            lot = max(1, CELLS // max(1, len(ids)))
            for batch in batches:
                for at in range(0, batch.num_rows if ids else 0, lot):
                    some = batch.slice(at, lot)
                    own = np.asarray(some.column("v").flatten(), np.float64).reshape(some.num_rows, -1)
                    best.add(unit @ (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T, some.column("k"))
            yield from best.batches(ids, "distance", lambda c: 1 - c)

        part = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(run, f"q {kinds[1]}, k {kinds[0]}, distance double")
        best = part if best is None else best.unionByName(part)
    return best.select(F.col("q").alias(query_id), F.col("k").alias(key), "distance", (1 / (1 + F.greatest(F.lit(0.0), F.col("distance")))).alias("semantic_score"))


def metadata_sizes(sizes: DataFrame, size: str = "size") -> DataFrame:
    """n, average, largest, and the value at place floor(0.95 n) of the sorted sizes."""
    from pyspark.sql import Window

    total = sizes.agg(F.count(size)).first()[0]
    placed = sizes.filter(F.col(size).isNotNull()).groupBy(size).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(size)))
    return placed.agg(F.sum("n").alias("n"), F.round(F.sum(F.col(size) * F.col("n")) / F.sum("n"), 2).alias("average"), F.max(size).alias("largest"), F.min(F.when(F.col("upto") > int(total * 0.95), F.col(size))).alias("p95"))


def projected(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """A copy of an index with fewer columns: those of `keep` that exist."""
    return vectors.select(*[c for c in keep if c in vectors.columns])


def embedded(rows: DataFrame, text: str, key: str, factory) -> DataFrame:
    """key, embedding by a model. factory() is called once in each worker and gives a function from a list of texts to a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for batch in batches:
            matrix = np.asarray(encode(batch.column("t").to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(list(matrix), pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
