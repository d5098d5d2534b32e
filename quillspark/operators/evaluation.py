"""Scoring of retrieval and answers: metrics per case and group, index statistics, differences, gates and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import collapse, none_if_blank, preview, strip

METRICS = ["recall_at_k", "mrr", "abstain_accuracy", "abstain_precision", "abstain_recall", "false_abstain_rate", "false_answer_rate", "evidence_hit_rate", "evidence_source_recall", "source_count_satisfaction_rate", "expected_term_coverage", "avg_search_latency_ms", "avg_ask_latency_ms"]
CASE_FIELDS = ["abstained", "abstain_correct", "search_hit", "rank", "source_count", "matched_source_count", "evidence_hit", "expected_term_coverage", "top_file_path", "top_location"]


def case_ranks(cases: DataFrame, hits: DataFrame, relevant: DataFrame, case: str = "case_id", key: str = "doc_id") -> DataFrame:
    """case, rank of the first relevant hit (null: none), mrr (its reciprocal, 0 without, rounded per case), search_hit."""
    first = hits.join(relevant.select(case, key).distinct(), [case, key], "left_semi").groupBy(case).agg(F.min("rank").alias("rank"))
    out = cases.select(case).join(first, case, "left")
    return out.withColumn("mrr", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 4)).withColumn("search_hit", F.col("rank").isNotNull())


def matched_evidence(cases: DataFrame, sources: DataFrame, case: str = "case_id") -> DataFrame:
    """cases: case, expected (array of keys "chunk:..." or "file:..."), least. sources: case, keys (array). -> counts, evidence_hit and
    evidence_source_recall (null where nothing is expected), source_count_ok (null where no number is)."""
    found = sources.groupBy(case).agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("found"), F.count("*").alias("source_count"))
    out = cases.join(found, case, "left").withColumn("matched_source_count", F.coalesce(F.size(F.array_intersect("expected", "found")), F.lit(0)))
    n = F.size(F.array_distinct("expected"))
    return out.select(case, n.alias("expected_source_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "matched_source_count",
                      F.when(n > 0, F.col("matched_source_count") > 0).alias("evidence_hit"), F.when(n > 0, F.round(F.col("matched_source_count") / n, 4)).alias("evidence_source_recall"),
                      F.when(F.col("least") > 0, F.coalesce("source_count", F.lit(0)) >= F.col("least")).alias("source_count_ok"))


def expected_terms(cases: DataFrame, texts: DataFrame, case: str = "case_id") -> DataFrame:
    """cases: case, terms (array). texts: case, text. -> total, matched, expected_term_coverage (null without terms)."""
    joined = texts.groupBy(case).agg(F.lower(F.array_join(F.sort_array(F.collect_list("text")), " ")).alias("t"))
    out = cases.join(joined, case, "left")
    matched = F.size(F.filter("terms", lambda x: F.coalesce(F.col("t"), F.lit("")).contains(F.lower(strip(x)))))
    return out.select(case, F.size("terms").alias("expected_terms_total"), matched.alias("expected_terms_matched"), F.when(F.size("terms") > 0, F.round(matched / F.size("terms"), 4)).alias("expected_term_coverage"))


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)


def metric_block(columns: list[str]) -> list[Column]:
    """Aggregates over case results; optional ones only where their columns are there (null without such a case)."""
    n = lambda c: F.count(F.when(c, 1))
    abstain, abstained = F.col("should_abstain"), F.col("abstained")
    out = [
        F.count("*").alias("total_cases"), n(~abstain).alias("answered_cases"), n(abstain).alias("abstain_cases"),
        _rate(n(~abstain & F.col("search_hit")), n(~abstain)).alias("recall_at_k"), _rate(F.sum(F.when(~abstain, F.col("mrr"))), n(~abstain)).alias("mrr"),
        _rate(n(abstain == abstained), F.count("*")).alias("abstain_accuracy"), _rate(n(abstain & abstained), n(abstained)).alias("abstain_precision"), _rate(n(abstain & abstained), n(abstain)).alias("abstain_recall"),
        _rate(n(~abstain & abstained), n(~abstain)).alias("false_abstain_rate"), _rate(n(abstain & ~abstained), n(abstain)).alias("false_answer_rate"),
    ]
    if {"evidence_hit", "evidence_source_recall"} <= set(columns):
        out += [F.round(F.avg(F.when(~abstain, F.col("evidence_hit").cast("double"))), 4).alias("evidence_hit_rate"), F.round(F.avg(F.when(~abstain, F.col("evidence_source_recall"))), 4).alias("evidence_source_recall")]
    if "source_count_ok" in columns:
        out.append(F.round(F.avg(F.when(~abstain, F.col("source_count_ok").cast("double"))), 4).alias("source_count_satisfaction_rate"))
    if "expected_term_coverage" in columns:
        out.append(F.round(F.avg("expected_term_coverage"), 4).alias("expected_term_coverage"))
    out += [F.round(F.avg(c), 2).alias(f"avg_{c}") for c in ("search_latency_ms", "ask_latency_ms") if c in columns]
    return out


def summary(results: DataFrame) -> DataFrame:
    return results.agg(*metric_block(results.columns))


def by_group(results: DataFrame, column: str) -> DataFrame:
    """The block per value of a column; of an array, a case counts in each of its groups."""
    multi = results.schema[column].dataType.simpleString().startswith("array")
    rows = results.withColumn("group", F.explode(F.array_distinct(column)) if multi else F.col(column))
    return rows.groupBy("group").agg(*metric_block(results.columns))


def numeric_summary(rows: DataFrame, column: str) -> DataFrame:
    """count, min, max, avg, exact median; zeros without values."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("count"), F.coalesce(F.min(c), F.lit(0)).cast("long").alias("min"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("max"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("avg"), F.round(F.coalesce(F.median(c), F.lit(0.0)), 4).alias("median"))


def duplicate_groups(chunks: DataFrame, text: str, key: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(groups, surplus and ratio over all chunks; the `most` largest groups with a preview and three samples)."""
    keyed = chunks.withColumn("_t", collapse(F.col(text)))
    groups = keyed.filter("_t <> ''").groupBy("_t").agg(F.count("*").alias("n"), F.min(key).alias("_first"))
    many = groups.filter("n > 1")
    total = chunks.count()
    totals = many.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus")).withColumn("ratio", F.round(F.col("surplus") / max(1, total), 4))
    top = many.orderBy(F.col("n").desc(), "_t").limit(most)
    own = keyed.join(F.broadcast(top.select("_t", "n")), "_t").withColumn("_k", F.row_number().over(Window.partitionBy("_t").orderBy(key))).filter("_k <= 3")
    samples = own.groupBy("_t", "n").agg(F.sort_array(F.collect_list(key)).alias("samples"))
    return totals, samples.select(preview(F.col("_t")).alias("preview"), F.col("n").alias("occurrences"), "samples")


def source_counts(documents: DataFrame, chunks: DataFrame, key: str = "document_id", source: str = "source_id") -> DataFrame:
    """source, documents, chunks: chunks counted under their document's source; unknown ones under (unknown)."""
    named = documents.select(key, F.coalesce(none_if_blank(F.col(source)), F.lit("(unknown)")).alias("source"))
    d = named.groupBy("source").agg(F.count("*").alias("n_documents"))
    c = chunks.groupBy(key).agg(F.count("*").alias("n")).join(named, key, "left").groupBy(F.coalesce("source", F.lit("(unknown)")).alias("source")).agg(F.sum("n").alias("n_chunks"))
    return d.join(c, "source", "full_outer").select("source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def long_form(block: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: a block of metrics as rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in block.columns])
    return block.select(*keys, F.inline(pairs))


def metric_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Long forms -> keys, metric, baseline, candidate, delta (null where one side is missing)."""
    on = [*keys, "metric"]
    both = baseline.withColumnRenamed("value", "baseline").join(candidate.withColumnRenamed("value", "candidate"), on, "full_outer")
    return both.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 4))


def case_diff(baseline: DataFrame, candidate: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, changed: names of the fields that differ, nulls being equal to each other."""
    b, c = baseline.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), candidate.select(key, *[F.col(f).alias(f"c_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"c_{f}")), F.lit(f)) for f in fields]))
    return b.join(c, key, "full_outer").withColumn("changed", changed).filter(F.size("changed") > 0)


def gate(block: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """block with failing_checks (texts) and passed."""
    say = lambda m, sign, v: F.concat(F.lit(f"{m} "), F.col(m).cast("string"), F.lit(f" {sign} {v}"))
    checks = [F.when(F.col(m) < v, say(m, "<", v)) for m, v in least.items()] + [F.when(F.col(m) > v, say(m, ">", v)) for m, v in most.items()]
    out = block.withColumn("failing_checks", F.array_compact(F.array(*checks)))
    return out.withColumn("passed", F.size("failing_checks") == 0)


def failures(results: DataFrame) -> DataFrame:
    """Case results that failed, with their reasons."""
    answer = ~F.col("should_abstain")
    reasons = F.array_compact(F.array(
        F.when(F.col("should_abstain") != F.col("abstained"), "abstain_mismatch"), F.when(answer & ~F.col("search_hit"), "retrieval_miss"),
        F.when(answer & (F.col("source_count_ok") == F.lit(False)), "source_count_below_expectation") if "source_count_ok" in results.columns else F.lit(None)))
    return results.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def draft_id(suite: Column, case_type: Column, question: Column) -> Column:
    clean = [strip(F.coalesce(c, F.lit(""))) for c in (suite, case_type, question)]
    return F.concat(F.lit("draft-"), F.substring(F.sha1(F.concat_ws("|", *clean).cast("binary")), 1, 12))


def backlog(records: DataFrame, cases: DataFrame) -> DataFrame:
    """records: record_no, suite_name, question, case_type, issues (array). cases: case_id, question, issues.

    Records once per (question, case_type), the first of them, with the ids of the cases that cover them: by question or by an issue.
    The two ways are equi-joins of their own.
    """
    low = lambda c: F.lower(collapse(F.coalesce(c, F.lit(""))))
    kind = F.lower(F.coalesce(none_if_blank(F.col("case_type")), F.lit("lookup")))
    first = records.withColumn("_q", low(F.col("question"))).withColumn("_k", F.row_number().over(Window.partitionBy("_q", kind).orderBy("record_no"))).filter("_k = 1").drop("_k")
    by_question = first.filter("_q <> ''").select("record_no", "_q").join(cases.select("case_id", low(F.col("question")).alias("_q")), "_q").select("record_no", "case_id")
    issue = lambda df, key: df.select(key, F.explode(F.transform("issues", F.lower)).alias("issue"))
    by_issue = issue(first, "record_no").join(issue(cases, "case_id"), "issue").select("record_no", "case_id")
    covered = by_question.union(by_issue).distinct().groupBy("record_no").agg(F.sort_array(F.collect_list("case_id")).alias("matching_case_ids"))
    out = first.drop("_q").join(covered, "record_no", "left").withColumn("covered", F.col("matching_case_ids").isNotNull())
    return out.withColumn("draft_id", F.when(~F.col("covered"), draft_id(F.col("suite_name"), F.col("case_type"), F.col("question"))))


def source_audit(documents: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of documents with each kind of metadata, and with any."""
    every = {**flags, "any": reduce(lambda a, b: a | b, flags.values())}
    n = {k: F.count(F.when(F.coalesce(c, F.lit(False)), 1)) for k, c in every.items()}
    return documents.agg(F.count("*").alias("documents"), *[x for k, c in n.items() for x in (c.alias(f"{k}_docs"), F.round(F.coalesce(c / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias(f"{k}_ratio"))])


def top_buckets(rows: DataFrame, column: Column, most: int = 12, order: str | None = None) -> DataFrame:
    """The most frequent values, ties by first seen."""
    n = rows.groupBy(column.alias("name")).agg(F.count("*").alias("n"), F.min(order or F.lit(0)).alias("first_seen"))
    return n.orderBy(F.col("n").desc(), "first_seen", "name").limit(most)


def cases_from(df: DataFrame) -> DataFrame:
    """Benchmark cases as read from JSON lines, with defaults: case_type falls back to type, then lookup; queries to the question."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    listed = lambda c: F.filter(F.transform(F.coalesce(has(c), F.array()).cast("array<string>"), strip), lambda x: x != "")
    question = strip(F.col("question"))
    return df.filter(F.col("question").isNotNull()).select(
        F.col("id").cast("string").alias("id"), F.col("question"), F.when(F.size(listed("queries")) > 0, listed("queries")).otherwise(F.array(question)).alias("queries"),
        listed("expected_chunk_ids").alias("expected_chunk_ids"), F.transform(listed("expected_file_paths"), lambda p: F.replace(p, F.lit("\\"), F.lit("/"))).alias("expected_file_paths"), listed("linked_issue_ids").alias("linked_issue_ids"),
        F.coalesce(has("should_abstain").cast("boolean"), F.lit(False)).alias("should_abstain"), F.coalesce(none_if_blank(has("case_type").cast("string")), none_if_blank(has("type").cast("string")), F.lit("lookup")).alias("case_type"),
        listed("tags").alias("tags"), F.greatest(F.lit(0), F.coalesce(has("min_expected_sources").cast("int"), F.lit(0))).alias("min_expected_sources"), listed("expected_terms").alias("expected_terms"))


