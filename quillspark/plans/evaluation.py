"""Evaluation queries. Truth: a document is relevant to a passage if its text holds it; a passage that no document holds should be
abstained from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import kept, table
from quillspark.operators import evaluation as ev
from quillspark.operators.containment import containment
from quillspark.operators.lexical import bm25_topk

from .registry import query
from .retrieval import FIELDS, SQL_BM25, asked, corpus

SQL_CASES = f"""{SQL_BM25},
top5 AS (SELECT request AS case_id, doc_id, rank FROM lex WHERE rank <= 5),
rel AS (SELECT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
res AS (SELECT b.item_id AS case_id, b.item_id % 3 AS kind, (SELECT min(rank) FROM top5 t JOIN rel r USING (case_id, doc_id) WHERE case_id = b.item_id) AS rank, NOT EXISTS (SELECT 1 FROM rel WHERE case_id = b.item_id) AS should_abstain,
        coalesce((SELECT max(score) FROM lex WHERE request = b.item_id), 0) < 60 AS abstained FROM benchmark b),
cr AS (SELECT *, round(coalesce(1.0 / rank, 0), 4) AS mrr, rank IS NOT NULL AS search_hit FROM res)"""
SQL_BLOCK = """count(*) AS total_cases, count(*) FILTER (NOT should_abstain) AS answered_cases, count(*) FILTER (should_abstain) AS abstain_cases,
round(coalesce(count(*) FILTER (NOT should_abstain AND search_hit) / nullif(count(*) FILTER (NOT should_abstain), 0), 0), 4) AS recall_at_k, round(coalesce(sum(mrr) FILTER (NOT should_abstain) / nullif(count(*) FILTER (NOT should_abstain), 0), 0), 4) AS mrr,
round(coalesce(count(*) FILTER (should_abstain = abstained) / nullif(count(*), 0), 0), 4) AS abstain_accuracy, round(coalesce(count(*) FILTER (should_abstain AND abstained) / nullif(count(*) FILTER (abstained), 0), 0), 4) AS abstain_precision,
round(coalesce(count(*) FILTER (should_abstain AND abstained) / nullif(count(*) FILTER (should_abstain), 0), 0), 4) AS abstain_recall, round(coalesce(count(*) FILTER (NOT should_abstain AND abstained) / nullif(count(*) FILTER (NOT should_abstain), 0), 0), 4) AS false_abstain_rate,
round(coalesce(count(*) FILTER (should_abstain AND NOT abstained) / nullif(count(*) FILTER (should_abstain), 0), 0), 4) AS false_answer_rate"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    hits = kept(bm25_topk(corpus(spark, sf_dir), asked(spark, sf_dir), "doc_id", "request", "query", 5, FIELDS).withColumnRenamed("request", "case_id"), "hits")
    relevant = kept(containment(table(spark, sf_dir, "documents"), items.select(F.col("item_id").alias("case_id"), F.col("text").alias("passage")), "doc_id", "text", "case_id", "passage"), "relevant")
    cases = items.select(F.col("item_id").alias("case_id"), (F.col("item_id") % 3).alias("kind"))
    ranks = ev.case_ranks(cases, hits, relevant)
    best = hits.groupBy("case_id").agg(F.max("score").alias("best"))
    held = relevant.select("case_id").distinct().withColumn("held", F.lit(True))
    out = cases.join(ranks, "case_id").join(best, "case_id", "left").join(held, "case_id", "left")
    return out.select("case_id", "kind", F.col("rank").cast("long").alias("rank"), "mrr", "search_hit", F.col("held").isNull().alias("should_abstain"), (F.coalesce("best", F.lit(0.0)) < 60).alias("abstained"))


@query(f"WITH {SQL_CASES} SELECT case_id, kind, coalesce(rank, 0) AS rank, mrr, search_hit, should_abstain, abstained FROM cr")
def eval_case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank 0: nothing relevant was found."""
    return results(spark, sf_dir).withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))


@query(f"WITH {SQL_CASES} SELECT {SQL_BLOCK} FROM cr")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summary(results(spark, sf_dir))


@query(f"WITH {SQL_CASES} SELECT kind AS \"group\", {SQL_BLOCK} FROM cr GROUP BY kind")
def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_group(results(spark, sf_dir), "kind")


@query(f"WITH {SQL_CASES}, e AS (SELECT case_id, unnest(CASE WHEN kind = 0 THEN ['a', 'b'] ELSE ['a'] END) AS g, * EXCLUDE (case_id) FROM cr) SELECT g AS \"group\", {SQL_BLOCK} FROM e GROUP BY g")
def eval_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags: a for all, b for a third of the cases."""
    tagged = results(spark, sf_dir).withColumn("tags", F.when(F.col("kind") == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return ev.by_group(tagged, "tags")


@query("SELECT item_id AS case_id, 2::INT AS expected_source_count, 1::BIGINT AS source_count, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::INT AS matched_source_count, item_id % 2 = 0 AS evidence_hit, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS evidence_source_recall, FALSE AS source_count_ok FROM benchmark")
def eval_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    cases = b.select(F.col("item_id").alias("case_id"), F.array(F.lit("chunk:0"), F.lit("file:a")).alias("expected"), F.lit(2).alias("least"))
    return ev.matched_evidence(cases, b.select(F.col("item_id").alias("case_id"), F.array(F.concat(F.lit("chunk:"), (F.col("item_id") % 2).cast("string"))).alias("keys")))


@query("SELECT item_id AS case_id, 2::INT AS expected_terms_total, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'schen') THEN 1 ELSE 0 END)::INT AS expected_terms_matched, round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'schen') THEN 1 ELSE 0 END) / 2, 4) AS expected_term_coverage FROM benchmark")
def eval_expected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return ev.expected_terms(b.select(F.col("item_id").alias("case_id"), F.array(F.lit("The"), F.lit(" schen")).alias("terms")), b.select(F.col("item_id").alias("case_id"), "text"))


@query("SELECT count(n_chars) AS count, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS avg, round(median(n_chars), 4) AS median FROM documents")
def index_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.numeric_summary(table(spark, sf_dir, "documents"), "n_chars")


SQL_GROUPS = "k AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), g AS (SELECT t, count(*) AS n, list_sort(list(doc_id))[1:3] AS s FROM k WHERE t <> '' GROUP BY t HAVING count(*) > 1)"


@query(f"WITH {SQL_GROUPS} SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus, round(coalesce(sum(n - 1), 0) / (SELECT count(*) FROM documents), 4) AS ratio FROM g")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")[0]


@query(f"WITH {SQL_GROUPS} SELECT CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS preview, n AS occurrences, array_to_string(s, ',') AS samples FROM g ORDER BY n DESC, t LIMIT 10")
def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")[1].withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("WITH s AS (SELECT coalesce(lang, '(unknown)') AS source, count(*) AS n_documents FROM documents GROUP BY 1), c AS (SELECT coalesce(d.lang, '(unknown)') AS source, count(*) AS n_chunks FROM conversations v LEFT JOIN documents d ON v.conv_id = d.doc_id GROUP BY 1) SELECT source, coalesce(n_documents, 0) AS n_documents, coalesce(n_chunks, 0)::BIGINT AS n_chunks FROM s FULL JOIN c USING (source)")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation are chunks of the document of equal id."""
    return ev.source_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "doc_id", "lang")


SQL_STATS = "SELECT lang, unnest(['n', 'avg_chars']) AS metric, unnest([count(*)::DOUBLE, avg(n_chars)]) AS value FROM documents WHERE {} GROUP BY lang"


def lang_stats(docs: DataFrame) -> DataFrame:
    return ev.long_form(docs.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("avg_chars")), ["lang"], ["n", "avg_chars"])


@query(f"WITH b AS ({SQL_STATS.format('n_chars < 3000')}), c AS ({SQL_STATS.format('TRUE')}) SELECT lang, metric, round(b.value, 6) AS baseline, round(c.value, 6) AS candidate, round(c.value - b.value, 4) AS delta FROM b FULL JOIN c USING (lang, metric)")
def stats_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the shorter documents against those of all."""
    d = table(spark, sf_dir, "documents")
    return ev.metric_diff(lang_stats(d.filter("n_chars < 3000")), lang_stats(d), ["lang"]).withColumns({c: F.round(c, 6) for c in ("baseline", "candidate")})


@query(f"WITH {SQL_CASES} SELECT case_id, array_to_string(list_filter([CASE WHEN case_id % 4 = 0 THEN 'abstained' END, CASE WHEN rank IS NOT NULL AND case_id % 2 = 0 THEN 'rank' END], lambda x: x IS NOT NULL), ',') AS changed FROM cr WHERE case_id % 4 = 0 OR (rank IS NOT NULL AND case_id % 2 = 0)")
def benchmark_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against one in which some decisions flipped and some ranks were lost."""
    a = kept(results(spark, sf_dir), "run")
    b = a.withColumn("abstained", F.when(F.col("case_id") % 4 == 0, ~F.col("abstained")).otherwise(F.col("abstained"))).withColumn("rank", F.when(F.col("case_id") % 2 != 0, F.col("rank")))
    return ev.case_diff(a, b, "case_id", ["abstained", "rank", "search_hit"]).select("case_id", F.array_join("changed", ",").alias("changed"))


@query(f"WITH {SQL_CASES}, s AS (SELECT {SQL_BLOCK} FROM cr) SELECT (recall_at_k >= 0.9) AND (mrr >= 1) AND (false_answer_rate <= 0) AS passed, (CASE WHEN recall_at_k < 0.9 THEN 1 ELSE 0 END + CASE WHEN mrr < 1.0 THEN 1 ELSE 0 END + CASE WHEN false_answer_rate > 0 THEN 1 ELSE 0 END)::INT AS failing FROM s")
def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gate(ev.summary(results(spark, sf_dir)), {"recall_at_k": 0.9, "mrr": 1.0}, {"false_answer_rate": 0.0}).select("passed", F.size("failing_checks").alias("failing"))


@query(f"WITH {SQL_CASES} SELECT case_id, array_to_string(list_filter([CASE WHEN should_abstain <> abstained THEN 'abstain_mismatch' END, CASE WHEN NOT should_abstain AND NOT search_hit THEN 'retrieval_miss' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cr WHERE should_abstain <> abstained OR (NOT should_abstain AND NOT search_hit)")
def failure_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.failures(results(spark, sf_dir)).select("case_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT item_id * 10 + k AS record_no, k < 4 AS covered, CASE k WHEN 1 THEN 'c1-' || item_id || ',c3-' || item_id WHEN 3 THEN 'c2-' || item_id END AS cases, CASE WHEN k = 4 THEN 'draft-' || substr(sha1('t|ask|Third ' || item_id), 1, 12) END AS draft_id FROM benchmark, (VALUES (1), (3), (4)) t(k)")
def failure_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four records and three cases for every item of the benchmark: one record repeats a question, others are covered by question or issue, the last isn't."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("i"), "item_id")
    t = lambda text: F.concat(F.lit(text), F.col("i"))
    none = F.array().cast("array<string>")
    row = lambda k, suite, question, kind, issues: F.struct((F.col("item_id") * 10 + k).alias("record_no"), F.lit(suite).alias("suite_name"), question.alias("question"), F.lit(kind).cast("string").alias("case_type"), issues.alias("issues"))
    r = items.select(F.inline(F.array(row(1, "s", t("What is  RAG "), "lookup", F.array(t("I1-"))), row(2, "s", t("what is rag "), "Lookup", none), row(3, "s", t("Other "), None, F.array(t("i2-"))), row(4, "t", t("Third "), "ask", none))))
    case = lambda c, question, issues: F.struct(t(c).alias("case_id"), question.alias("question"), issues.alias("issues"))
    c = items.select(F.inline(F.array(case("c1-", t("what is RAG "), none), case("c2-", t("unrelated "), F.array(t("I2-"))), case("c3-", t("again "), F.array(t("I1-"))))))
    return ev.backlog(r, c).select("record_no", "covered", F.array_join("matching_case_ids", ",").alias("cases"), "draft_id")


@query("SELECT item_id, 'draft-' || substr(sha1('bench|lookup|' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 12) AS draft_id FROM benchmark")
def draft_case_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", ev.draft_id(F.lit("bench"), F.lit("lookup"), F.col("text")).alias("draft_id"))


@query("SELECT count(*) AS documents, count(quality) AS quality_docs, round(count(quality) / count(*), 4) AS quality_ratio, count(*) FILTER (toxic = 1) AS toxic_docs, round(count(*) FILTER (toxic = 1) / count(*), 4) AS toxic_ratio, count(*) FILTER (quality IS NOT NULL OR toxic = 1) AS any_docs, round(count(*) FILTER (quality IS NOT NULL OR toxic = 1) / count(*), 4) AS any_ratio FROM documents d LEFT JOIN labels l USING (doc_id)")
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for the optional metadata of a document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ev.source_audit(d, {"quality": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1})


@query("SELECT source AS name, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id), name LIMIT 12")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.top_buckets(table(spark, sf_dir, "documents"), F.col("source"), 12, "doc_id").select("name", "n")
