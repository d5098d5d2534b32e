"""Retrieval queries: the benchmark's passages are requests, the documents are chunks with their source as title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import bounded_side, kept, spread, table
from quillspark.functions.text import tokens
from quillspark.operators import lexical, ranking, semantic

from .registry import query

FIELDS = {"title": 2.5, "content": 1.5}
K = 20

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
SQL_BM25 = f"""
q AS (SELECT item_id AS request, text AS query, list_distinct({TOKENS.format('text')}) AS qt FROM benchmark),
qx AS (SELECT request, unnest(qt) AS term FROM q),
d AS (SELECT doc_id, source, text, {TOKENS.format('source')} AS tt, {TOKENS.format('text')} AS ct FROM documents),
n AS (SELECT count(*) AS total, avg(len(tt) + len(ct)) AS mean FROM d),
tok AS (SELECT doc_id, unnest(tt) AS term, 2.5 AS w FROM d UNION ALL SELECT doc_id, unnest(ct), 1.5 FROM d),
pd AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM tok WHERE term IN (SELECT term FROM qx) GROUP BY ALL),
pt AS (SELECT term, count(*) AS c FROM pd GROUP BY term),
sc AS (SELECT request, doc_id, sum((CASE WHEN ln((total - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - c + 0.5) / (c + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(tt) + len(ct)) / mean))) AS score
       FROM qx JOIN pd USING (term) JOIN pt USING (term) JOIN d USING (doc_id), n GROUP BY request, doc_id),
lex AS (SELECT * FROM (SELECT request, doc_id, score, row_number() OVER (PARTITION BY request ORDER BY round(score, 8) DESC, doc_id) AS rank FROM sc) WHERE rank <= {K})"""
SQL_KNN = """
qv AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
kn AS (SELECT q, vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], qv.v) AS distance FROM qv, embeddings e),
sem AS (SELECT * FROM (SELECT q, vec_id, distance, 1 / (1 + greatest(0, distance)) AS semantic_score, row_number() OVER (PARTITION BY q ORDER BY round(1 / (1 + greatest(0, distance)), 8) DESC, vec_id) AS rank FROM kn) WHERE rank <= 10)"""
SQL_EMBEDDING = "list_transform(range(32), lambda i: ('0x' || substr(sha256({0}), (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1)"
SQL_RRF = f"""
de AS (SELECT doc_id, {SQL_EMBEDDING.format('text')} AS e FROM documents),
qe AS (SELECT item_id AS request, {SQL_EMBEDDING.format('text')} AS e FROM benchmark),
ds AS (SELECT request, doc_id, 1 / (1 + greatest(0, 1 - list_cosine_similarity(de.e, qe.e))) AS score FROM qe, de),
sl AS (SELECT request, doc_id, score, row_number() OVER (PARTITION BY request ORDER BY round(score, 8) DESC, doc_id) AS rank FROM ds),
lists AS (SELECT request, doc_id, rank, 'lexical' AS source, 1.0 / rank AS source_score FROM lex UNION ALL SELECT request, doc_id, rank, 'semantic', score FROM sl WHERE rank <= {K}),
fused AS (SELECT request, doc_id, sum((CASE source WHEN 'lexical' THEN 1.2 ELSE 0.8 END) / (60 + rank)) AS rrf_score, max(CASE WHEN source = 'lexical' THEN source_score END) AS lexical_score, max(CASE WHEN source = 'semantic' THEN source_score END) AS semantic_score FROM lists GROUP BY ALL),
rf AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(rrf_score, 8) DESC, round(coalesce(lexical_score, semantic_score), 8) DESC, doc_id) AS place FROM fused)"""
SQL_RERANK = f"""
rr AS (SELECT rf.*, q.query, d.text, d.source, list_distinct({TOKENS.format('query')}) AS a, list_distinct(d.ct) AS b FROM rf JOIN q USING (request) JOIN d USING (doc_id) WHERE place <= 24),
rs AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN rrf_score * 0.1 ELSE 0.5 * len(list_intersect(a, b)) / greatest(1, len(a)) + 0.2 * len(list_intersect(a, b)) / greatest(1, len(b)) + 0.2 * least(1.0, rrf_score * 10) + 0.1 * least(1.0, greatest(coalesce(lexical_score, 0), coalesce(semantic_score, 0))) END AS score FROM rr),
rk AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(score, 8) DESC, doc_id) AS rplace FROM rs)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.col("text").alias("query"))


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(corpus(spark, sf_dir), asked(spark, sf_dir), "doc_id", "request", "query", K, FIELDS)


def semantic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents of each passage by hash embedding."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", semantic.hash_embedding(F.col("text")).alias("embedding"))
    return semantic.knn_cosine(docs, asked(spark, sf_dir).select("request", semantic.hash_embedding(F.col("query")).alias("embedding")), "doc_id", "request", K)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexical_hits(spark, sf_dir).select("request", F.col("doc_id").alias("chunk_id"), "rank", F.lit("lexical").alias("source"), F.col("lexical_score").alias("source_score"))
    sem = semantic_hits(spark, sf_dir).select("request", F.col("doc_id").alias("chunk_id"), "rank", F.lit("semantic").alias("source"), F.col("semantic_score").alias("source_score"))
    return ranking.rrf(lex.unionByName(sem).withColumn("query_no", F.lit(0)), {"lexical": 1.2, "semantic": 0.8})


def with_texts(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document"))
    requests = asked(spark, sf_dir)
    n = requests.count()  # a request has two lists of K hits at most
    out = docs.join(bounded_side(hits, 2 * K * n), "chunk_id").join(bounded_side(requests, n), "request")
    return out.withColumns({"file_path": F.concat("document", F.lit("/"), F.col("chunk_id").cast("string"), F.lit(".md")), "title_path": F.array("document")})


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, for most steps read them more than once."""
    return kept(ranking.rerank_overlap(with_texts(kept(ranking.limit_candidates(fused(spark, sf_dir)), "fused"), spark, sf_dir)), "reranked")


def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even requests ask for two of the sources."""
    c = asked(spark, sf_dir).filter("request % 2 = 0").select("request", F.lit("category").alias("kind"), F.array(F.concat(F.lit("src"), (F.col("request") % 20).cast("string")), F.lit("src0")).alias("tokens"))
    return ranking.constraint_filter(reranked(spark, sf_dir).withColumn("_terms", F.array(F.lower("document"))), c, {"category": "_terms"})


SQL_CONSTRAINED = """
cc AS (SELECT *, list_intersect(['src' || (request % 20), 'src0'], [lower(source)]) AS m FROM rk),
cp AS (SELECT *, request % 2 = 0 AS asked, round(len(m) / len(list_distinct(['src' || (request % 20), 'src0'])), 4) AS cov0, round(len(m) / 2.0, 4) AS coverage FROM cc WHERE request % 2 = 1 OR len(m) > 0),
cs AS (SELECT *, CASE WHEN asked THEN greatest(score, least(0.55, 0.22 + 0.12 * coverage + 0.25 * coalesce(lexical_score, 0) + 0.03 * greatest((CASE WHEN lexical_score IS NULL THEN 0 ELSE 1 END + CASE WHEN semantic_score IS NULL THEN 0 ELSE 1 END) - 1, 0))) ELSE score END AS score2 FROM cp),
ck AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN NOT asked THEN rplace END NULLS LAST, coverage DESC, round(score2, 8) DESC, doc_id) AS cplace FROM cs)"""


@query(f"WITH {SQL_BM25} SELECT request, doc_id, rank, round(score, 6) AS score, round(1.0 / rank, 6) AS lexical_score FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).select("request", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical_score"))


@query(f"SELECT doc_id, term, count(*) FILTER (f = 't') AS tf_title, count(*) FILTER (f = 'c') AS tf_content FROM (SELECT doc_id, unnest({TOKENS.format('source')}) AS term, 't' AS f FROM documents UNION ALL SELECT doc_id, unnest({TOKENS.format('text')}), 'c' FROM documents) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(corpus(spark, sf_dir), "doc_id", FIELDS)


@query(f"SELECT term, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TOKENS.format('source')}) AS term FROM documents UNION ALL SELECT doc_id, unnest({TOKENS.format('text')}) FROM documents) GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(corpus(spark, sf_dir), "doc_id", FIELDS))


@query(f"SELECT doc_id, (len({TOKENS.format('source')}) + len({TOKENS.format('text')}))::BIGINT AS n_tokens FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_stats(corpus(spark, sf_dir), "doc_id", FIELDS)


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({TOKENS.format('text')})), ' ') AS terms FROM benchmark")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return q.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))


@query("SELECT doc_id, array_to_string(list_transform(range(32), lambda i: printf('%.6f', ('0x' || substr(sha256(text), (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1)), ' ') AS embedding FROM documents")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(semantic.hash_embedding(F.col("text")), lambda x: F.format_string("%.6f", x)), " ").alias("embedding"))


@query(f"WITH {SQL_KNN} SELECT q AS query_id, vec_id, rank, round(distance, 6) AS distance, round(semantic_score, 6) AS semantic_score FROM sem")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    near = semantic.knn_cosine(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", 10)
    return near.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"), F.round("semantic_score", 6).alias("semantic_score"))


@query("WITH s AS (SELECT length(props) AS size FROM events) SELECT count(*) AS n, round(avg(size), 2) AS average, max(size) AS largest, (SELECT list_sort(list(size))[floor(count(*) * 0.95)::BIGINT + 1] FROM s) AS p95 FROM s")
def metadata_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic.metadata_sizes(table(spark, sf_dir, "events").select(F.length("props").cast("long").alias("size")))
    return out.select("n", "average", "largest", "p95")


@query(f"WITH {SQL_BM25}, {SQL_RRF} SELECT request, doc_id, place, round(rrf_score, 6) AS rrf_score, round(lexical_score, 6) AS lexical_score, round(semantic_score, 6) AS semantic_score FROM rf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), *[F.round(c, 6).alias(c) for c in ("rrf_score", "lexical_score", "semantic_score")])


@query(f"WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK} SELECT request, doc_id, rplace AS place, place AS rerank_rank, round(score, 6) AS score FROM rk")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.col("rerank_rank").cast("long").alias("rerank_rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK},
m AS (SELECT request // 2 AS request, request % 2 AS query_no, doc_id, score FROM rk),
b AS (SELECT *, row_number() OVER (PARTITION BY request, doc_id ORDER BY round(score, 8) DESC, query_no) AS k FROM m)
SELECT request, doc_id, query_no, round(score, 6) AS score, row_number() OVER (PARTITION BY request ORDER BY round(score, 8) DESC, doc_id) AS place FROM b WHERE k = 1""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passages are two queries of one request."""
    two = reranked(spark, sf_dir).withColumn("query_no", F.col("request") % 2).withColumn("request", F.floor(F.col("request") / 2))
    return ranking.merge_queries(two).select("request", F.col("chunk_id").alias("doc_id"), "query_no", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK}, {SQL_CONSTRAINED} SELECT request, doc_id, cplace AS place, CASE WHEN asked THEN coverage END AS coverage, round(score2, 6) AS score FROM ck")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained(spark, sf_dir).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.col("constraint_coverage").alias("coverage"), F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK}, {SQL_CONSTRAINED},
dsup AS (SELECT *, count(*) FILTER (asked) OVER (PARTITION BY request) AS n, count(DISTINCT CASE WHEN asked THEN source END) OVER (PARTITION BY request) AS docs FROM ck),
dt AS (SELECT *, n >= 2 AND docs >= 2 AS onn FROM dsup),
du AS (SELECT *, count(*) FILTER (asked) OVER (PARTITION BY request, source) AS support, round(max(CASE WHEN asked THEN coalesce(lexical_score, 0) END) OVER (PARTITION BY request, source), 4) AS best FROM dt WHERE NOT onn OR asked)
SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN NOT onn THEN cplace END NULLS LAST, coverage DESC, support DESC, best DESC, round(score2, 8) DESC, doc_id) AS place, support FROM du""")
def doc_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.document_support(constrained(spark, sf_dir)).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.col("support_count").alias("support"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK},
t AS (SELECT *, row_number() OVER (PARTITION BY request, source ORDER BY rplace) AS turn, min(rplace) OVER (PARTITION BY request, source) AS first, first_value(source) OVER (PARTITION BY request ORDER BY rplace) AS leader FROM rk)
SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN rplace = 1 THEN 0 WHEN source = leader THEN turn - 1 ELSE turn END, first, doc_id) AS place FROM t""")
def doc_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.diversify(reranked(spark, sf_dir)).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK},
s AS (SELECT *, ['src' || (request % 20)] AS subj FROM rk),
a AS (SELECT *, CASE WHEN request % 3 <> 0 THEN 0 WHEN lower(source) = subj[1] THEN 3 WHEN lower(doc_id::VARCHAR) = subj[1] THEN 2 WHEN contains(lower(source), subj[1]) OR contains(doc_id::VARCHAR, subj[1]) THEN 1 ELSE 0 END AS affinity FROM s),
w AS (SELECT *, max(affinity) OVER (PARTITION BY request, source) AS da, count(*) OVER (PARTITION BY request, source) AS dc, max(affinity) OVER (PARTITION BY request) AS anyone FROM a)
SELECT request, doc_id, affinity, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN anyone = 0 THEN rplace END NULLS LAST, da DESC, affinity DESC, dc DESC, round(score, 8) DESC, doc_id) AS place FROM w""")
def definition_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third request is a definition whose subject is a source."""
    s = asked(spark, sf_dir).select("request", F.when(F.col("request") % 3 == 0, "definition").otherwise("lookup").alias("query_type"), F.array(F.concat(F.lit("src"), (F.col("request") % 20).cast("string"))).alias("subject_terms"))
    return ranking.definition_subject(reranked(spark, sf_dir), s).select("request", F.col("chunk_id").alias("doc_id"), "affinity", F.col("place").cast("long").alias("place"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK},
l AS (SELECT *, list_distinct({TOKENS.format('query')}) AS terms, list_distinct(list_concat(ct0, {TOKENS.format('source')}, [doc_id::VARCHAR, 'md'])) AS own FROM (SELECT rk.*, d.ct AS ct0 FROM rk JOIN d USING (doc_id))),
c AS (SELECT *, CASE WHEN request % 2 = 0 THEN len(list_intersect(terms, own)) END AS m FROM l),
v AS (SELECT *, round(m / len(terms), 4) AS cov FROM c)
SELECT request, doc_id, cov AS coverage, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN m IS NULL THEN rplace END NULLS LAST, cov DESC, m DESC, round(score, 8) DESC, doc_id) AS place FROM v""")
def lookup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even requests look up their own words."""
    i = asked(spark, sf_dir).select("request", F.when(F.col("request") % 2 == 0, F.array_distinct(tokens(F.col("query")))).alias("lookup_terms"))
    return ranking.lookup_priority(reranked(spark, sf_dir), i).select("request", F.col("chunk_id").alias("doc_id"), F.col("lookup_coverage").alias("coverage"), F.col("place").cast("long").alias("place"))


@query(f"WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK} SELECT * FROM (SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY rplace) AS place, round(score, 6) AS score FROM rk WHERE score >= 0.1) WHERE place <= 6")
def score_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(ranking.score_filter(reranked(spark, sf_dir)), 6).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(f"WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK} SELECT * FROM (SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY rplace) AS place, round(score, 6) AS score FROM rk WHERE score >= 0.1) WHERE place <= 6")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default steps in their order, as one plan; no request looks anything up or has a constraint."""
    none = asked(spark, sf_dir).select("request", F.lit(None).cast("array<string>").alias("lookup_terms"))
    empty = none.select("request", F.lit("").alias("kind"), F.col("lookup_terms").alias("tokens")).filter("false")
    subjects = none.select("request", F.lit("lookup").alias("query_type"), F.col("lookup_terms").alias("subject_terms"))
    steps = {
        "rerank_candidate_limit": ranking.limit_candidates,
        "metadata_constraint_prefilter": lambda h: ranking.constraint_filter(h.withColumn("_t", F.array().cast("array<string>")), empty, {"category": "_t"}).drop("constraint_coverage", "constraint_passed"),
        "rerank": lambda h: kept(ranking.rerank_overlap(with_texts(h, spark, sf_dir)), "reranked"),
        "metadata_constraint_postfilter": lambda h: ranking.constraint_filter(h, empty, {"category": "_t"}),
        "lookup_prioritization": lambda h: ranking.lookup_priority(h, none),
        "metadata_document_support": ranking.document_support,
        "definition_subject_prioritization": lambda h: ranking.definition_subject(h, subjects),
        "lookup_diversification": lambda h: ranking.diversify(h, F.col("lookup_terms").isNotNull()),
        "score_filter": ranking.score_filter,
        "top_k_limit": lambda h: ranking.top_k(h, 6),
    }
    return ranking.run_steps(kept(fused(spark, sf_dir), "fused"), steps).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_BM25}, {SQL_RRF}, {SQL_RERANK}, {SQL_CONSTRAINED},
g1 AS (SELECT ck.*, request % 3 = 1 AS looks, list_distinct({TOKENS.format('query')}) AS terms, list_distinct(list_concat(d.ct, {TOKENS.format('ck.source')}, [doc_id::VARCHAR, 'md'])) AS own FROM ck JOIN d USING (doc_id)),
g2 AS (SELECT *, CASE WHEN looks THEN len(list_intersect(terms, own)) END AS words, CASE WHEN looks THEN round(len(list_intersect(terms, own)) / len(terms), 4) END AS cov FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN NOT looks THEN cplace END NULLS LAST, cov DESC, words DESC, round(score2, 8) DESC, doc_id) AS p3, count(*) FILTER (asked) OVER (PARTITION BY request) AS n, count(DISTINCT CASE WHEN asked THEN source END) OVER (PARTITION BY request) AS docs FROM g2),
g4 AS (SELECT *, n >= 2 AND docs >= 2 AS onn FROM g3),
g5 AS (SELECT *, count(*) FILTER (asked) OVER (PARTITION BY request, source) AS support, round(max(CASE WHEN asked THEN coalesce(lexical_score, 0) END) OVER (PARTITION BY request, source), 4) AS best FROM g4 WHERE NOT onn OR asked),
g6 AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN NOT onn THEN p3 END NULLS LAST, coverage DESC, support DESC, best DESC, round(score2, 8) DESC, doc_id) AS p4, CASE WHEN request % 3 <> 0 THEN 0 WHEN lower(source) = 'src' || (request % 20) THEN 3 WHEN contains(lower(source), 'src' || (request % 20)) THEN 1 ELSE 0 END AS affinity FROM g5),
g7 AS (SELECT *, max(affinity) OVER (PARTITION BY request, source) AS da, count(*) OVER (PARTITION BY request, source) AS dc, max(affinity) OVER (PARTITION BY request) AS anyone FROM g6),
g8 AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN anyone = 0 THEN p4 END NULLS LAST, da DESC, affinity DESC, dc DESC, round(score2, 8) DESC, doc_id) AS p5 FROM g7),
g9 AS (SELECT *, row_number() OVER (PARTITION BY request, source ORDER BY p5) AS turn, min(p5) OVER (PARTITION BY request, source) AS first, first_value(source) OVER (PARTITION BY request ORDER BY p5) AS leader FROM g8),
g10 AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN NOT looks THEN p5 END NULLS LAST, CASE WHEN p5 = 1 THEN 0 WHEN source = leader THEN turn - 1 ELSE turn END, first, doc_id) AS p6 FROM g9)
SELECT * FROM (SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY p6) AS place, round(score2, 6) AS score, support FROM g10 WHERE score2 >= 0.1) WHERE place <= 6""")
def guided_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine steps with something to do (the constraints' pre-filter is in `ask_documents`): even requests ask for two sources, of three one looks its words up, and another defines a source."""
    requests = asked(spark, sf_dir)
    category = requests.filter("request % 2 = 0").select("request", F.lit("category").alias("kind"), F.array(F.concat(F.lit("src"), (F.col("request") % 20).cast("string")), F.lit("src0")).alias("tokens"))
    looks = requests.select("request", F.when(F.col("request") % 3 == 1, F.array_distinct(tokens(F.col("query")))).alias("lookup_terms"))
    subjects = requests.select("request", F.when(F.col("request") % 3 == 0, "definition").otherwise("lookup").alias("query_type"), F.array(F.concat(F.lit("src"), (F.col("request") % 20).cast("string"))).alias("subject_terms"))
    steps = {
        "rerank_candidate_limit": ranking.limit_candidates,
        "rerank": lambda h: kept(ranking.rerank_overlap(with_texts(h, spark, sf_dir)), "reranked"),
        "metadata_constraint_postfilter": lambda h: ranking.constraint_filter(h.withColumn("_terms", F.array(F.lower("document"))), category, {"category": "_terms"}),
        "lookup_prioritization": lambda h: ranking.lookup_priority(h, looks),
        "metadata_document_support": ranking.document_support,
        "definition_subject_prioritization": lambda h: ranking.definition_subject(h, subjects),
        "lookup_diversification": lambda h: ranking.diversify(h, F.col("lookup_terms").isNotNull()),
        "score_filter": ranking.score_filter,
        "top_k_limit": lambda h: ranking.top_k(h, 6),
    }
    return ranking.run_steps(kept(fused(spark, sf_dir), "fused"), steps).select("request", F.col("chunk_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"), F.col("support_count").alias("support"))


@query("SELECT item_id AS request, item_id % 5 AS kind, CASE item_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END AS lexical_weight, CASE item_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS semantic_weight FROM benchmark")
def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), (F.col("item_id") % 5).alias("kind")).withColumn("query_type", F.col("kind").cast("string"))
    return ranking.fusion_weights(q, {"0": {"lexical": 1.5}, "1": {"lexical": 0.5, "semantic": 2.0}}).select("request", "kind", "lexical_weight", "semantic_weight")


