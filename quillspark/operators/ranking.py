"""Fusion and the ranking steps. Each step is hits -> hits over a set of requests; `place` is a hit's rank within its request.

A hit has request, chunk_id, document (what groups chunks), score, and what earlier steps have added.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import file_stem, occurrences, path_parts, tokens

from .lexical import SCORE_DIGITS

RRF_K, MIN_SCORE, CANDIDATES = 60, 0.1, 24


def placed(hits: DataFrame, *order: Column) -> DataFrame:
    """hits with place, from 1, by the given order and then chunk_id."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*order, F.col("chunk_id").asc())))


def by_score() -> Column:
    return F.round("score", SCORE_DIGITS).desc()


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """lists: request, source ("lexical" or "semantic"), query_no, chunk_id, rank, source_score -> fused hits.

    score is the weighted sum of 1 / (k + rank) over all lists; a source's score is that of the last query that found the chunk;
    ties go by the score of the first list that has the chunk, lexical lists coming first.
    """
    weights = {"lexical": 1.0, "semantic": 1.0} | (weights or {})
    weight = reduce(lambda c, kv: c.when(F.col("source") == kv[0], F.lit(float(kv[1]))), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    last = lambda s: F.max_by(F.when(F.col("source") == s, F.col("source_score")), F.when(F.col("source") == s, F.col("query_no")))
    fused = lists.groupBy("request", "chunk_id").agg(
        F.sum(weight / (k + F.col("rank"))).alias("rrf_score"), last("lexical").alias("lexical_score"), last("semantic").alias("semantic_score"),
        F.min_by("source_score", F.struct("source", "query_no")).alias("first_score"),
        F.array_sort(F.collect_list(F.concat_ws(":", "source", F.col("query_no").cast("string")))).alias("source_hits"))
    return placed(fused.withColumn("score", F.col("rrf_score")), by_score(), F.round("first_score", SCORE_DIGITS).desc())


def fusion_weights(query_types: DataFrame, table: dict[str, dict[str, float]]) -> DataFrame:
    """request, query_type -> with the weights of both sources; 1 where the table is silent."""
    pick = lambda source: reduce(lambda c, kv: c.when(F.col("query_type") == kv[0], F.lit(float(kv[1].get(source, 1.0) or 1.0))), table.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    return query_types.withColumns({"lexical_weight": pick("lexical"), "semantic_weight": pick("semantic")})


def limit_candidates(hits: DataFrame, n: int = CANDIDATES) -> DataFrame:
    return hits if n <= 0 else hits.filter(F.col("place") <= n)


def rerank_overlap(hits: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    """A deterministic rerank: half coverage of the query's tokens, a fifth precision, the rest from fusion; token sets, not bags.
    rerank_rank is the place before."""
    q, c = F.array_distinct(tokens(F.col(query))), F.array_distinct(tokens(F.col(content)))
    both = F.size(F.array_intersect("_q", "_c"))
    hint = F.greatest(F.coalesce("lexical_score", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0)))
    full = 0.5 * both / F.greatest(F.lit(1), F.size("_q")) + 2 * both / 10 / F.greatest(F.lit(1), F.size("_c")) + 0.2 * F.least(F.lit(1.0), F.col("rrf_score") * 10) + 0.1 * F.least(F.lit(1.0), hint)
    score = F.when((F.size("_q") == 0) | (F.size("_c") == 0), F.coalesce("score", F.lit(0.0)) * 0.1).otherwise(full)
    out = hits.withColumn("_q", q).withColumn("_c", c).withColumn("score", score).withColumn("rerank_score", F.col("score")).withColumn("rerank_rank", F.col("place"))
    return placed(out.drop("_q", "_c"), by_score())


def rerank_model(hits: DataFrame, factory, query: str = "query", content: str = "content") -> DataFrame:
    """A rerank by a cross-encoder: all pairs of all requests in one pass. factory() is called once in each worker and gives a function from
    a list of (query, content) to raw scores, which are clamped to 20 and put through a sigmoid; missing ones repeat the last."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        score = factory()
        for batch in batches:
            raw = list(score(list(zip(batch.column("q").to_pylist(), batch.column("c").to_pylist(), strict=True))))
            raw += raw[-1:] * (batch.num_rows - len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("request"), batch.column("chunk_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -20, 20))))], names=["request", "chunk_id", "rerank_score"])

    kind = {c: hits.schema[c].dataType.simpleString() for c in ("request", "chunk_id")}
    pairs = hits.select("request", "chunk_id", F.coalesce(query, F.lit("")).alias("q"), F.coalesce(content, F.lit("")).alias("c"))
    scored = pairs.mapInArrow(run, f"request {kind['request']}, chunk_id {kind['chunk_id']}, rerank_score double")
    out = hits.drop("rerank_score").join(scored, ["request", "chunk_id"]).withColumn("rerank_rank", F.col("place")).withColumn("score", F.col("rerank_score"))
    return placed(out, by_score())


def merge_queries(reranked: DataFrame) -> DataFrame:
    """Hits of several queries (query_no) -> one per chunk: the best score, of equal ones the first query's."""
    best = Window.partitionBy("request", "chunk_id").orderBy(by_score(), F.col("query_no").asc())
    return placed(reranked.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n"), by_score())


def constraint_filter(hits: DataFrame, constraints: DataFrame, terms: dict[str, str]) -> DataFrame:
    """constraints: request, kind, tokens (array). terms: kind -> the column of hits with its token array.

    Requests without a constraint pass as they are; of the others only hits that meet every constraint by at least one token,
    by mean coverage and then score, which is raised to what the metadata supports.
    """
    own = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.col(kv[1])), terms.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    numbered = constraints.withColumn("_no", F.xxhash64("kind", "tokens")).dropDuplicates(["request", "_no"])
    met = hits.join(numbered, "request").withColumn("_m", F.size(F.array_intersect("tokens", own)))
    judged = met.groupBy("request", "chunk_id").agg(F.min("_m").alias("_least"), F.round(F.avg(F.col("_m") / F.greatest(F.lit(1), F.size("tokens"))), 4).alias("constraint_coverage"))
    asked = constraints.select("request").distinct().withColumn("_asked", F.lit(True))
    out = hits.join(asked, "request", "left").join(judged, ["request", "chunk_id"], "left").filter(F.col("_asked").isNull() | (F.col("_least") > 0))
    hits_of = F.coalesce(F.size("source_hits"), F.lit(0))
    support = F.least(F.lit(0.55), 0.22 + 0.12 * F.col("constraint_coverage") + 0.25 * F.coalesce("lexical_score", F.lit(0.0)) + 0.03 * F.greatest(hits_of - 1, F.lit(0)))
    out = out.withColumn("constraint_passed", F.col("_asked").isNotNull()).withColumn("score", F.when(F.col("_asked").isNotNull(), F.greatest(F.coalesce("score", F.lit(0.0)), support)).otherwise(F.col("score")))
    first = F.when(F.col("_asked").isNull(), F.col("place"))
    return placed(out, first.asc_nulls_last(), F.col("constraint_coverage").desc(), by_score()).drop("_asked", "_least")


# Words of a path that say nothing about its subject.
GENERIC_STEMS = ["基础知识", "常用命令详解", "命令详解", "常用命令", "详解", "基础", "入门"]
# What a table row begins with after normalisation.
TABLE_ROW = "表格行:"


def lookup_priority(hits: DataFrame, intents: DataFrame) -> DataFrame:
    """intents: request, lookup_terms (null or empty: no lookup). Coverage of the terms, then table rows, then how specific the path is."""
    own = F.array_distinct(tokens(F.concat_ws(" ", "content", F.array_join("title_path", " "), file_stem(F.col("file_path")), F.array_join(path_parts(F.col("file_path"), 4), " "))))
    matched = F.size(F.array_intersect("lookup_terms", own))
    on = F.coalesce(F.size("lookup_terms") > 0, F.lit(False))
    out = hits.join(intents, "request", "left").withColumn("lookup_matched", F.when(on, matched)).withColumn("lookup_coverage", F.when(on, F.round(matched / F.size("lookup_terms"), 4))).withColumn("lookup_rows", F.when(on, occurrences(F.col("content"), TABLE_ROW)))
    stem = file_stem(F.col("file_path"))
    out = out.withColumn("lookup_specific", F.when(on, F.when((stem == "") | stem.isin(GENERIC_STEMS), 0.0).otherwise(1.0)))
    return placed(out, F.when(~on, F.col("place")).asc_nulls_last(), F.col("lookup_coverage").desc(), F.col("lookup_rows").desc(), F.col("lookup_matched").desc(), F.col("lookup_specific").desc(), by_score())


def document_support(hits: DataFrame) -> DataFrame:
    """With two constrained hits in two documents or more: only those, by coverage, support of their document and its best lexical score."""
    r, d = Window.partitionBy("request"), Window.partitionBy("request", "document")
    passed = F.col("constraint_passed")
    out = hits.withColumn("_n", F.count(F.when(passed, 1)).over(r)).withColumn("_docs", F.size(F.collect_set(F.when(passed, F.col("document"))).over(r)))
    on = (F.col("_n") >= 2) & (F.col("_docs") >= 2)
    out = out.filter(~on | passed).withColumn("support_count", F.count(F.when(passed, 1)).over(d)).withColumn("support_lexical", F.round(F.max(F.when(passed, F.coalesce("lexical_score", F.lit(0.0)))).over(d), 4))
    return placed(out, F.when(~on, F.col("place")).asc_nulls_last(), F.col("constraint_coverage").desc(), F.col("support_count").desc(), F.col("support_lexical").desc(), by_score()).drop("_n", "_docs")


def definition_subject(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """subjects: request, query_type, subject_terms (lower case). Hits whose titles or file name are the subject come first, with their document."""
    titles = F.filter(F.transform("title_path", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    stem = F.lower(F.trim(file_stem(F.col("file_path"))))
    any_of = lambda test: F.exists("subject_terms", test)
    affinity = (F.when(any_of(lambda s: s == F.get("_titles", F.lit(0))), 3)
                .when(any_of(lambda s: F.array_contains(F.slice("_titles", F.lit(2), F.greatest(F.size("_titles"), F.lit(1))), s)) | any_of(lambda s: s == stem), 2)
                .when(any_of(lambda s: F.exists("_titles", lambda t: t.contains(s))) | any_of(lambda s: stem.contains(s)), 1).otherwise(0))
    r, d = Window.partitionBy("request"), Window.partitionBy("request", "document")
    out = hits.join(subjects, "request", "left").withColumn("_titles", titles)
    asked = (F.col("query_type") == "definition") & F.coalesce(F.size("subject_terms") > 0, F.lit(False))
    out = out.withColumn("affinity", F.when(asked, affinity).otherwise(0)).withColumn("_doc", F.max("affinity").over(d)).withColumn("_count", F.count("*").over(d)).withColumn("_any", F.max("affinity").over(r))
    return placed(out, F.when(F.col("_any") == 0, F.col("place")).asc_nulls_last(), F.col("_doc").desc(), F.col("affinity").desc(), F.col("_count").desc(), by_score()).drop("_titles", "_doc", "_count", "_any")


def diversify(hits: DataFrame, only: Column | None = None) -> DataFrame:
    """The leader stays; then documents take turns, in the order of their first hits. only: requests for which this holds."""
    r = Window.partitionBy("request")
    doc = Window.partitionBy("request", "document").orderBy("place")
    out = hits.withColumn("_turn", F.row_number().over(doc)).withColumn("_first", F.min("place").over(Window.partitionBy("request", "document")))
    out = out.withColumn("_leader", F.first("document").over(r.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turn = F.when(F.col("place") == 1, F.lit(0)).when(F.col("document") == F.col("_leader"), F.col("_turn") - 1).otherwise(F.col("_turn"))
    on = F.coalesce(only, F.lit(False)) if only is not None else F.lit(True)
    return placed(out, F.when(~on, F.col("place")).asc_nulls_last(), turn.asc(), F.col("_first").asc()).drop("_turn", "_first", "_leader")


def score_filter(hits: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return hits if least <= 0 else hits.filter(F.coalesce("score", F.lit(0.0)) >= least)


def top_k(hits: DataFrame, k: int | None) -> DataFrame:
    """The first k by place; None: all; 0 or less: none. Places are numbered anew."""
    renumbered = placed(hits, F.col("place").asc())
    return renumbered if k is None else renumbered.filter(F.col("place") <= max(0, k))


#: The default order of the steps.
STEPS = ("rerank_candidate_limit", "metadata_constraint_prefilter", "rerank", "metadata_constraint_postfilter", "lookup_prioritization", "metadata_document_support", "definition_subject_prioritization", "lookup_diversification", "score_filter", "top_k_limit")


def validated(steps: tuple[str, ...], known: tuple[str, ...] = STEPS) -> tuple[str, ...]:
    """steps, if they are known, unique, rerank once with the candidate limit before and the post-filter after it, and end with the top-k limit."""
    if unknown := [s for s in steps if s not in known]:
        raise ValueError(f"unknown ranking steps: {unknown}")
    if len(set(steps)) != len(steps):
        raise ValueError("a ranking step occurs twice")
    if "rerank" not in steps:
        raise ValueError("the ranking steps must contain rerank")
    at = {s: i for i, s in enumerate(steps)}
    if at.get("rerank_candidate_limit", -1) > at["rerank"]:
        raise ValueError("the candidate limit comes before rerank")
    if at.get("metadata_constraint_postfilter", len(steps)) < at["rerank"]:
        raise ValueError("the constraint post-filter comes after rerank")
    if "top_k_limit" in at and at["top_k_limit"] != len(steps) - 1:
        raise ValueError("the top-k limit comes last")
    return steps


def run_steps(hits: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps, one after the other, as one plan."""
    validated(tuple(steps))
    return reduce(lambda df, f: f(df), steps.values(), hits)


def location(path: Column, start: Column, end: Column) -> Column:
    """name:a-b, name:a, or name."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(start.isNull() | (start <= 0), name).when(end.isNull() | (end <= start), F.concat_ws(":", name, start.cast("string"))).otherwise(F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
