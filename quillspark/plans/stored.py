"""Queries over stored indexes: an inverted index that has been changed and merged, and lists of vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import kept, scratch, table
from quillspark.operators import semantic, vector_index
from quillspark.sources.segments import SegmentIndex
from quillspark.sources.store import Store

from .registry import query
from .retrieval import FIELDS, SQL_BM25, SQL_KNN, TOKENS, K, asked, corpus


def changed_index(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """An index that ends with all documents as they are, after changes: some come late, some have another text or source at first, some go and come back."""
    docs = corpus(spark, sf_dir)
    index = SegmentIndex(spark, scratch(spark, "index"), "doc_id", docs.schema["doc_id"].dataType.simpleString(), FIELDS)
    late, other, back = F.col("doc_id") % 7 == 3, F.col("doc_id") % 5 == 1, F.col("doc_id") % 11 == 2
    first = docs.filter(~late).withColumns({"content": F.when(other, F.concat_ws(" ", "title", "content", F.lit("draft"))).otherwise(F.col("content")), "title": F.when(other, F.lit(None)).otherwise(F.col("title"))})
    index.apply(first)
    index.apply(docs.filter(late & ~other), docs.filter(back))
    index.apply(docs.filter(other))
    index.apply(docs.filter(back & ~other))
    return index


SQL_POSTINGS = f"""
d AS (SELECT doc_id, source, text, {TOKENS.format('source')} AS tt, {TOKENS.format('text')} AS ct FROM documents),
tok AS (SELECT doc_id, unnest(tt) AS term, 2.5 AS w FROM d UNION ALL SELECT doc_id, unnest(ct), 1.5 FROM d),
pd AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM tok GROUP BY ALL)"""


@query(f"WITH {SQL_POSTINGS} SELECT term, count(*) AS n_docs, count(*) AS n_postings, round(sum(f), 4) AS weight, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM pd GROUP BY term")
def index_delta_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of an index after four changes and a merge: the documents that its kept differences count, and its postings."""
    index = changed_index(spark, sf_dir)
    index.compact(merge=2)
    p = index.postings().groupBy("term").agg(F.count("*").alias("n_postings"), F.round(F.sum("f"), 4).alias("weight"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return index.term_counts().join(p, "term", "full")


@query(f"WITH {SQL_BM25} SELECT request, doc_id, rank, round(score, 6) AS score, round(1.0 / rank, 6) AS lexical_score FROM lex")
def stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of bm25_topk on the index after its changes, blocks below the k-th score left out."""
    hits = changed_index(spark, sf_dir).search(asked(spark, sf_dir), "request", "query", K)
    return hits.select("request", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical_score"))


#: The part of all lists that a search reads, and neighbours. There are about as many lists as the square root of the vectors.
PROBES, NEAR = 0.6, 10


def vector_hits(spark: SparkSession, sf_dir: str, part: float) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    lists = max(1, round(v.count() ** 0.5))
    centroids = vector_index.centroids_of(v, "vec_id", lists)
    index = kept(vector_index.laid_out(vector_index.assigned(v, centroids, "vec_id"), "vec_id"), "vectors")
    return vector_index.search(index, centroids, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", NEAR, math.ceil(part * lists))


@query()
def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours: every vector is indexed, a search reads a part of all lists."""
    return vector_hits(spark, sf_dir, PROBES).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"WITH {SQL_KNN} SELECT q AS query_id, vec_id, rank, round(distance, 6) AS distance, round(semantic_score, 6) AS semantic_score FROM sem")
def knn_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index with all lists read: exact."""
    return vector_hits(spark, sf_dir, 1.0).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"), F.round("semantic_score", 6).alias("semantic_score"))


@query("SELECT count(*) AS queries, least(10, (SELECT count(*) FROM embeddings)) * count(*) AS wanted, TRUE AS nine_in_ten FROM embeddings WHERE vec_id % 50 = 0")
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of knn_lists against exact neighbours."""
    v = table(spark, sf_dir, "embeddings")
    exact = semantic.knn_cosine(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", NEAR)
    r = vector_index.recall(vector_hits(spark, sf_dir, PROBES), exact, "query_id", "vec_id", NEAR)
    return r.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hit") >= 0.9 * F.sum("wanted")).alias("nine_in_ten"))


DOCUMENTS = "doc_id bigint, lang string, source string, n_chars bigint"
TOTALS = "source string, n_documents bigint, n_chars bigint"


@query("SELECT source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def drift_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all documents whose tables lack columns by now: both are rebuilt together, then read by the new schema."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    store = Store(spark, scratch(spark, "store"))
    old = {"documents": docs.select("doc_id", "source"), "totals": docs.groupBy("source").agg(F.count("*").alias("n_documents"))}
    store.write(old)
    totals = docs.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    store.ensured({"documents": DOCUMENTS, "totals": TOTALS}, lambda: {"documents": docs, "totals": totals})
    langs = store.read("documents").groupBy("source").agg(F.count_distinct("lang").alias("langs"))
    return store.read("totals").join(langs, "source")
