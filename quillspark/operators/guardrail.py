"""Whether the evidence of a request is enough to answer: aggregates per request and an ordered cascade of reasons.

Evidence: request, place, chunk_id, document, content, score, and, where metadata constraints were at work, constraint_passed,
constraint_coverage, source_hits (array) and support_values (array: path, titles and metadata of the chunk).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip, tokens
from quillspark.functions.vocabulary import Vocabulary

from .understanding import signal_terms, strings

SUBSTANTIVE = 8


@dataclass(frozen=True)
class Thresholds:
    top1: float = 0.20
    top3: float = 0.30
    hits: int = 2
    chars: int = 150
    terms: int = 2
    coverage: float = 0.60


OPTIONAL = {"constraint_passed": "boolean", "constraint_coverage": "double", "source_hits": "array<string>", "support_values": "array<string>"}


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Per request: top1, top3, hit_count, total_chars, confidence, and what the relaxations ask for. Blank chunks don't count."""
    for name, kind in OPTIONAL.items():
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, F.lit(None).cast(kind))
    chars = F.length(strip(F.coalesce("content", F.lit(""))))
    passed = F.coalesce("constraint_passed", F.lit(False))
    rows = evidence.withColumn("_chars", chars).filter("_chars > 0").withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))).withColumn("_passed", passed)
    r = Window.partitionBy("request")
    rows = rows.withColumn("_rank", F.row_number().over(r.orderBy(F.col("_score").desc(), "place"))).withColumn("_in_doc", F.count(F.when(F.col("_passed"), 1)).over(Window.partitionBy("request", "document")))
    rows = rows.withColumn("_passed_no", F.when(F.col("_passed"), F.row_number().over(r.orderBy(~F.col("_passed"), "place"))))
    both = F.exists("source_hits", lambda s: s.startswith("lexical:")) & F.exists("source_hits", lambda s: s.startswith("semantic:")) & (F.size("source_hits") >= 2)
    values = lambda only: F.aggregate(F.array_distinct(F.flatten(F.collect_list(F.when(only, F.filter(F.transform("support_values", strip), lambda x: x != ""))))), F.lit(0), lambda a, x: a + F.length(x))
    return rows.groupBy("request").agg(
        F.max("_score").alias("top1"), F.avg(F.when(F.col("_rank") <= 3, F.col("_score"))).alias("top3"), F.count("*").alias("chunks"),
        F.count(F.when((F.col("_chars") >= SUBSTANTIVE) | (F.col("_passed") & (F.col("_in_doc") >= 2)), 1)).alias("hit_count"), F.sum("_chars").alias("total_chars"),
        F.count(F.when(F.col("_passed"), 1)).alias("passed"), F.count_distinct(F.when(F.col("_passed"), F.col("document"))).alias("passed_docs"),
        F.avg(F.when(F.col("_passed_no") <= 3, F.coalesce("constraint_coverage", F.lit(0.0)))).alias("passed_coverage"),
        F.coalesce(F.bool_or(F.col("_passed") & both), F.lit(False)).alias("dual_source"),
        F.coalesce(values(F.lit(True)), F.lit(0)).alias("support_chars"), F.coalesce(values(F.col("_passed")), F.lit(0)).alias("passed_support_chars"),
    ).withColumn("confidence", F.round((F.col("top1") + F.col("top3")) / 2, 4))


def abstain(requests: DataFrame, summary: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """request -> abstained, reason, confidence, top1, top3, hit_count, total_chars. A request without evidence has zeros."""
    s = requests.select("request").join(summary, "request", "left").fillna(0)
    s = s.withColumn("dual_source", F.coalesce("dual_source", F.lit(False)))
    covered = F.col("passed_coverage") >= 0.8
    top3 = F.col("top3") >= t.top3
    strong = F.col("top1") >= max(t.top1, 0.35)
    single = (F.col("chunks") == 1) & strong & top3 & (F.col("passed") == 1) & covered & F.col("dual_source") & (F.col("total_chars") + F.col("support_chars") >= t.chars)
    hits = F.when((F.col("hit_count") < t.hits) & single, t.hits).otherwise(F.col("hit_count"))
    enough = hits >= t.hits
    cluster = enough & strong & top3 & (F.col("passed") >= max(t.hits, 3)) & (F.col("passed_docs") == 1) & covered & F.col("dual_source") & (F.col("total_chars") + F.col("passed_support_chars") >= max(100, int(t.chars * 0.75)))
    several = enough & (F.col("top1") >= max(t.top1, 0.3)) & top3 & (F.col("passed") >= t.hits) & covered & (F.col("total_chars") + F.col("passed_support_chars") >= t.chars)
    reason = (F.when(F.col("top1") < t.top1, "top1_score_below_threshold").when(~top3, "top3_avg_score_below_threshold").when(~enough, "recall_hits_below_threshold")
              .when((F.col("total_chars") < t.chars) & ~(single | cluster | several), "evidence_chars_below_threshold"))
    return s.withColumn("reason", reason).select("request", F.col("reason").isNotNull().alias("abstained"), "reason", "confidence", "top1", "top3", hits.cast("long").alias("hit_count"), F.col("total_chars").cast("long").alias("total_chars"))


def evidence_terms(evidence: DataFrame, texts: list[Column]) -> DataFrame:
    """request, document, terms (set), hits: what a document's chunks talk about."""
    own = F.concat_ws(" ", *texts)
    rows = evidence.select("request", "document", "place", F.explode_outer(F.array_distinct(tokens(own))).alias("t"))
    docs = rows.groupBy("request", "document").agg(F.collect_set("t").alias("terms"), F.count_distinct("place").alias("hits"), F.min("place").alias("first_place"))
    return docs.filter(F.size("terms") > 0)


def query_term_sets(requests: DataFrame, v: Vocabulary = Vocabulary(), least: int = 2) -> DataFrame:
    """request, queries -> request, terms: the distinct signal-term sets of at least `least` terms."""
    return requests.select("request", F.explode(F.transform("queries", lambda q: signal_terms(q, v.coverage_low_signal))).alias("terms")).filter(F.size("terms") >= least).distinct()


def term_coverage(requests: DataFrame, docs: DataFrame, v: Vocabulary = Vocabulary(), least: int = 2) -> DataFrame:
    """request -> matched, total, coverage: the best of one term set in one document, or of all variants' terms, weighed by how many
    variants have them, in one document with two hits. Never stitched together across documents."""
    sets = query_term_sets(requests, v, least)
    n = F.size(F.array_intersect(sets["terms"], docs["terms"]))
    plain = sets.join(docs, "request").select("request", F.struct((n / F.size(sets["terms"])).alias("coverage"), n.alias("matched"), F.size(sets["terms"]).alias("total"), F.lit(1).alias("plain")).alias("s"))
    terms = requests.select("request", F.explode(F.transform("queries", lambda q: signal_terms(q, v.coverage_low_signal))).alias("q")).filter(F.size("q") > 0)
    weights = terms.select("request", F.explode("q").alias("term")).groupBy("request", "term").agg(F.count("*").alias("w"))
    totals = weights.groupBy("request").agg(F.sum("w").cast("int").alias("all"), F.count("*").alias("n_terms")).join(terms.groupBy("request").agg(F.count("*").alias("n_queries")), "request").filter("n_terms >= 2 AND n_queries >= 2")
    found = weights.join(docs.filter("hits >= 2").select("request", "document", F.explode("terms").alias("term")), ["request", "term"]).groupBy("request", "document").agg(F.sum("w").cast("int").alias("m"))
    weighed = found.join(totals, "request").select("request", F.struct((F.col("m") / F.col("all")).alias("coverage"), F.col("m").alias("matched"), F.col("all").alias("total"), F.lit(0).alias("plain")).alias("s"))
    best = plain.unionByName(weighed).groupBy("request").agg(F.max("s").alias("s"))
    out = requests.select("request").distinct().join(best, "request", "left")
    return out.select("request", F.coalesce("s.matched", F.lit(0)).alias("matched"), F.coalesce("s.total", F.lit(0)).alias("total"), F.coalesce("s.coverage", F.lit(0.0)).alias("coverage"))


def strong_existence(requests: DataFrame, docs: DataFrame, v: Vocabulary = Vocabulary(), t: Thresholds = Thresholds()) -> DataFrame:
    """request -> strong: a term set covered well in the top document, or wholly in another."""
    sets = query_term_sets(requests, v, max(2, t.terms))
    n = F.size(F.array_intersect(sets["terms"], docs["terms"]))
    top = F.col("first_place") == F.min("first_place").over(Window.partitionBy("request"))
    rows = sets.join(docs.withColumn("_top", top), "request").withColumn("_n", n).withColumn("_c", n / F.size(sets["terms"]))
    good = (F.col("_n") >= 1) & (F.col("_c") >= max(0.6, t.coverage)) & (F.col("_top") | (F.col("_c") >= 1))
    return rows.groupBy("request").agg(F.bool_or(good).alias("strong"))


def comparison_complete(profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """request -> complete: one document with two comparison terms, or two documents with two between them. Null where it isn't asked."""
    asked = profiles.filter((F.col("query_type") == "comparison") & (F.size("comparison_terms") >= 2)).select("request", "comparison_terms")
    own = asked.join(docs, "request", "left").withColumn("_m", F.array_intersect("comparison_terms", F.coalesce("terms", strings([]))))
    judged = own.groupBy("request").agg(F.max(F.size("_m")).alias("most"), F.size(F.array_distinct(F.flatten(F.collect_list("_m")))).alias("covered"), F.count(F.when(F.size("_m") > 0, 1)).alias("docs"))
    return judged.select("request", ((F.col("most") >= 2) | ((F.col("covered") >= 2) & (F.col("docs") >= 2))).alias("complete"))


RELAXED = ["top1_score_below_threshold", "recall_hits_below_threshold", "evidence_chars_below_threshold"]


def decide(requests: DataFrame, profiles: DataFrame, evidence: DataFrame, texts: list[Column], v: Vocabulary = Vocabulary(), t: Thresholds = Thresholds()) -> DataFrame:
    """The final decision: the cascade, relaxed for strong existence evidence, then term coverage, then completeness of a comparison."""
    first = abstain(requests, evidence_summary(evidence), t)
    docs = evidence_terms(evidence, texts)
    parts = [term_coverage(requests, docs, v, t.terms).select("request", "coverage"), strong_existence(requests, docs, v, t), comparison_complete(profiles, docs), profiles.select("request", "query_type")]
    all_of = reduce(lambda a, b: a.join(b, "request", "left"), parts, first)
    relaxed = F.col("abstained") & (F.col("query_type") == "existence") & F.col("reason").isin(RELAXED) & F.coalesce("strong", F.lit(False))
    open_ = ~F.col("abstained") | relaxed
    reason = F.when(~open_, F.col("reason")).when(F.coalesce("coverage", F.lit(0.0)) < t.coverage, "query_term_coverage_below_threshold").when(~F.coalesce("complete", F.lit(True)), "comparison_evidence_incomplete")
    confidence = F.when(relaxed, F.greatest("confidence", F.lit(0.35))).otherwise(F.col("confidence"))
    return all_of.select("request", reason.isNotNull().alias("abstained"), reason.alias("reason"), confidence.alias("confidence"), "hit_count", "total_chars")
