"""The whole way from questions to prompts: spellings, search by each of them, ranking, decision, context, prompt, and the texts that citations are checked on.

Every request is understood first; each of its variants is a query of its own, searched for by words and by vectors, fused and reranked by itself,
and then the queries of a request are merged and go through the ranking steps together, with the constraints, lookups and subjects that its
questions were found to have. Evidence is what is left, each chunk with its neighbours.

Requests: request (a string), question, queries (array). Chunks: chunk_id (a string), document, document_id, file_path, title_path (array), section_index,
chunk_index, content, start_line, end_line, embedding (array).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.functions.frames import bounded_side, kept
from quillspark.functions.text import tokens
from quillspark.functions.vocabulary import Vocabulary

from . import answering, guardrail, lexical, ranking, semantic, understanding

#: Fields that words are looked for in, and what a source's lists weigh in fusion.
FIELDS = {"titles": 2.5, "content": 1.5}
WEIGHTS = {"lexical": 1.2, "semantic": 0.8}
#: The most that a list of one query holds, whatever a route asks for.
MOST = 24


@dataclass
class Asked:
    profiles: DataFrame
    queries: DataFrame
    hits: DataFrame
    evidence: DataFrame
    decisions: DataFrame
    prompts: DataFrame
    #: Rows that each step has made, as observed while it was written.
    counts: dict[str, int] = field(default_factory=dict)

    def checked(self, answers: DataFrame) -> DataFrame:
        """answers: request, answer -> request, unverified, coverage, matched_ids: citations against the texts that the prompts showed, neighbours included."""
        used = self.evidence.groupBy("request").agg(F.array_sort(F.collect_list("chunk_id")).alias("used"))
        texts = self.evidence.select("request", "chunk_id", F.col("content").alias("text"))
        return answering.verify(answers.join(used, "request", "left"), texts)[0]


def observed(df: DataFrame, name: str, counts: dict[str, int]) -> DataFrame:
    """df as a written table; its rows are counted on the way."""
    seen = Observation(name)
    out = kept(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    counts[name] = int(seen.get["rows"])
    return out


def searched(queries: DataFrame, chunks: DataFrame, embed, counts: dict[str, int]) -> DataFrame:
    """Fused hits of each query (request is the query's own id, q)."""
    words = chunks.select("chunk_id", F.array_join("title_path", " ").alias("titles"), "content")
    lex = lexical.bm25_topk(words, queries, "chunk_id", "q", "query", MOST, FIELDS).select("q", "chunk_id", "rank", F.lit("lexical").alias("source"), F.col("lexical_score").alias("source_score"))
    near = semantic.knn_cosine(chunks.select("chunk_id", "embedding"), queries.select("q", embed(F.col("query")).alias("embedding")), "chunk_id", "q", MOST)
    sem = near.select("q", "chunk_id", "rank", F.lit("semantic").alias("source"), F.col("semantic_score").alias("source_score"))
    lists = observed(lex.unionByName(sem), "lists", counts).join(queries.select("q", "query_no", "recall_k"), "q").filter(F.col("rank") <= F.col("recall_k"))
    return ranking.rrf(lists.withColumnRenamed("q", "request"), WEIGHTS)


def ask(requests: DataFrame, chunks: DataFrame, embed=semantic.hash_embedding, recall_k: int = 20, rerank_k: int = 6, v: Vocabulary = Vocabulary(),
        t: guardrail.Thresholds = guardrail.Thresholds(), wording: answering.Wording = answering.Wording(), context: int = 3) -> Asked:
    counts: dict[str, int] = {}
    profiles = observed(understanding.routed(understanding.variants(understanding.profile(requests, v=v), v=v), recall_k, rerank_k), "profiles", counts)
    queries = profiles.select("request", "recall_k", F.posexplode("variants").alias("query_no", "query")).withColumn("q", F.concat_ws("#", "request", "query_no"))
    queries = observed(queries, "queries", counts)
    constraints = understanding.constraints(requests, v)
    of_query = constraints.join(queries.select("request", "q"), "request").select(F.col("q").alias("request"), "kind", "tokens")
    looks = understanding.lookup_intents(requests, v)
    subjects = profiles.select("request", "query_type", "subject_terms")
    where = F.array_distinct(tokens(F.concat_ws(" ", "document", "file_path", F.array_join("title_path", " "))))
    about = chunks.select("chunk_id", "document", "file_path", "title_path", "start_line", "end_line", "content", where.alias("_where"))
    n = counts["queries"]

    def reranked(h: DataFrame) -> DataFrame:
        one = ranking.rerank_overlap(h.join(bounded_side(queries.select(F.col("q").alias("request"), "query"), n), "request"))
        back = queries.select(F.col("q").alias("_q"), F.col("request").alias("_request"), "query_no")
        one = one.withColumnRenamed("request", "_q").drop("query_no").join(bounded_side(back, n), "_q").withColumnRenamed("_request", "request").drop("_q", "query")
        return observed(ranking.merge_queries(one), "reranked", counts)

    filtered = lambda c: lambda h: ranking.constraint_filter(h, c, {"category": "_where", "context": "_where"})
    plain = lambda f: lambda h: f(h.drop("constraint_coverage", "constraint_passed"))
    steps = {
        "rerank_candidate_limit": ranking.limit_candidates,
        "metadata_constraint_prefilter": lambda h: plain(lambda x: x)(filtered(of_query)(about.join(bounded_side(h, ranking.CANDIDATES * n), "chunk_id"))),
        "rerank": reranked,
        "metadata_constraint_postfilter": filtered(constraints),
        "lookup_prioritization": lambda h: ranking.lookup_priority(h, looks),
        "metadata_document_support": ranking.document_support,
        "definition_subject_prioritization": lambda h: ranking.definition_subject(h, subjects),
        "lookup_diversification": lambda h: ranking.diversify(h, F.size("lookup_terms") > 0),
        "score_filter": ranking.score_filter,
        "top_k_limit": lambda h: ranking.top_k(h, None).join(profiles.select("request", "rerank_k"), "request").filter(F.col("place") <= F.col("rerank_k")).drop("rerank_k"),
    }
    fused = observed(searched(queries, chunks, embed, counts), "fused", counts)
    hits = observed(ranking.run_steps(fused, steps), "hits", counts)
    told = hits.withColumn("support_values", F.array_append(F.coalesce("title_path", F.array().cast("array<string>")), F.col("file_path")))
    asked = profiles.select("request", F.col("variants").alias("queries"))
    decisions = observed(guardrail.decide(asked, profiles, told, [F.col("content"), F.array_join("title_path", " ")], v, t), "decisions", counts)
    around = answering.parent_context(hits.select("request", "chunk_id"), chunks, context)
    evidence = observed(hits.drop("content", "start_line", "end_line", "_where").join(around, ["request", "chunk_id"]), "evidence", counts)
    prompts = answering.prompts(requests.select("request", "question"), evidence, decisions, wording=wording)
    return Asked(profiles, queries, hits, evidence, decisions, prompts, counts)
