"""Changes between two states of a corpus, and what an incremental run has to do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ["file_hash", "mtime_ns", "size", "file_path"]


def diff(previous: DataFrame, current: DataFrame, key: str = "document_id", attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """key, status (added, modified, unchanged, removed), and both sides as structs. Nulls are equal to each other."""
    p = previous.select(key, F.struct(*attributes).alias("previous"))
    c = current.select(key, F.struct(*attributes).alias("current"))
    status = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(F.col("previous").eqNullSafe(F.col("current")), "unchanged").otherwise("modified")
    return p.join(c, key, "full_outer").select(key, status.alias("status"), "previous", "current")


def in_order(changes: DataFrame, key: str = "document_id") -> DataFrame:
    """The current ones by key, then the removed ones by key."""
    return changes.orderBy(F.col("status") == "removed", key)


def plan(changes: DataFrame, key: str = "document_id") -> DataFrame:
    """key, add, delete: modified documents are deleted and added again; unchanged ones are left out."""
    return changes.filter("status <> 'unchanged'").select(key, F.col("status").isin("added", "modified").alias("add"), F.col("status").isin("modified", "removed").alias("delete"))


def applied(index: DataFrame, fresh: DataFrame, todo: DataFrame, key: str = "document_id") -> DataFrame:
    """The index after a plan: rows of deleted documents out, fresh rows of added ones in."""
    kept = index.join(todo.filter("delete").select(key), key, "left_anti")
    return kept.unionByName(fresh.join(todo.filter("add").select(key), key, "left_semi"))


def stats(documents: DataFrame, chunks: DataFrame, updated: str = "updated_at", sources: int = 0) -> DataFrame:
    """document_count, chunk_count, last_indexed_at over both tables, and the number of configured sources."""
    d = documents.agg(F.count("*").alias("document_count"), F.max(updated).alias("d"))
    c = chunks.agg(F.count("*").alias("chunk_count"), F.max(updated).alias("c"))
    one = d.withColumn("_one", F.lit(1)).join(c.withColumn("_one", F.lit(1)), "_one")
    return one.select("document_count", "chunk_count", F.greatest("d", "c").alias("last_indexed_at"), F.lit(sources).cast("long").alias("source_count"))
