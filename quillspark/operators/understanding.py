"""Query understanding as column expressions over a table of requests: request, question, queries (array)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import dedupe_fold, let, strip, tokens
from quillspark.functions.vocabulary import ALIASES, Vocabulary

PUNCTUATION = r"""[\s\x{3000},，.。!！?？:：;；、'"“”‘’()\[\]{}<>《》]+"""
ROUTES = {"comparison": (24, 8), "procedure": (22, 8)}
POLICIES = {"comparison": "comparison-diverse", "existence": "existence-precise", "procedure": "procedure-semantic", "lookup": "lookup-precise"}


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def any_hint(text: Column, hints: list[str]) -> Column:
    return F.exists(strings(hints), lambda h: text.contains(h))


def normal(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def query_type(text: Column, v: Vocabulary = Vocabulary()) -> Column:
    """The first kind with a hint in the text."""
    t = normal(text)
    kinds = (("comparison", v.comparison), ("existence", v.existence), ("procedure", v.procedure), ("lookup", v.lookup))
    return reduce(lambda c, kind: c.when(any_hint(t, kind[1]), kind[0]), kinds[1:], F.when(any_hint(t, v.comparison), "comparison")).otherwise("definition")


def signal_terms(text: Column, stop: list[str]) -> Column:
    """Distinct tokens outside the stop list, in order."""
    return F.array_except(F.array_distinct(tokens(text)), strings(stop))


def anchors(text: Column, limit: int = 4, v: Vocabulary = Vocabulary()) -> Column:
    return F.slice(signal_terms(text, v.low_signal), 1, limit)


def alias_groups(front_matter: DataFrame | None = None, aliases: str = "aliases", base: list[list[str]] = ALIASES) -> list[list[str]]:
    """Alias groups: the fixed ones, then those of documents (an array column), in lower case, of two distinct members or more,
    groups with equal members once. Grouped before they are collected: one row per distinct group."""
    groups = [list(g) for g in base]
    if front_matter is not None:
        own = F.array_distinct(F.filter(F.transform(aliases, lambda a: F.lower(strip(a))), lambda a: a != ""))
        found = front_matter.select(own.alias("g")).filter(F.size("g") >= 2).groupBy(F.sort_array("g").alias("k")).agg(F.min("g").alias("g"))
        groups += [r["g"] for r in found.orderBy("k").collect()]
    seen, out = set(), []
    for g in groups:
        members = list(dict.fromkeys(m for a in g if (m := a.strip().lower())))
        if len(members) >= 2 and tuple(sorted(members)) not in seen:
            seen.add(tuple(sorted(members)))
            out.append(members)
    return out


def alias_variants(query: Column, groups: list[list[str]]) -> Column:
    """For each group with a member in the query: the query with that member replaced, once, by each other one; four at most."""
    t = normal(query)

    def of(group: Column) -> Column:
        hit = F.get(F.filter(group, lambda a: t.contains(a)), F.lit(0))
        swap = lambda a: let(hit, lambda h: F.concat(F.substring(t, F.lit(1), F.instr(t, h) - 1), a, F.substring(t, F.instr(t, h) + F.length(h), F.length(t))))
        return F.when(hit.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.filter(group, lambda a: a != hit), swap))

    table = F.array(*[strings(g) for g in groups])
    return F.slice(dedupe_fold(F.filter(F.flatten(F.transform(table, of)), lambda x: x != t)), 1, 4)


def alias_subjects(text: Column, groups: list[list[str]]) -> Column:
    """All members of every group that has a member in the text."""
    t = normal(text)
    return F.array_distinct(F.flatten(F.filter(F.array(*[strings(g) for g in groups]), lambda g: F.exists(g, lambda a: t.contains(a)))))


def profile(requests: DataFrame, groups: list[list[str]] = ALIASES, v: Vocabulary = Vocabulary()) -> DataFrame:
    """requests with clean (the non-blank queries), canonical_query, query_type, route_policy, metadata_focus, requires_multi_source,
    anchor_terms, comparison_terms, subject_terms."""
    clean = F.filter(F.transform("queries", strip), lambda q: q != "")
    out = requests.withColumn("clean", F.coalesce(clean, F.array().cast("array<string>")))
    out = out.withColumn("canonical_query", F.coalesce(F.nullif(strip(F.col("question")), F.lit("")), F.get("clean", F.lit(0)), F.lit("")))
    out = out.withColumn("_joined", F.concat_ws(" ", "canonical_query", F.array_join("clean", " "))).withColumn("query_type", query_type(F.col("canonical_query"), v))
    out = out.withColumn("anchor_terms", anchors(F.col("_joined"), 4, v)).withColumn("metadata_focus", any_hint(F.col("canonical_query"), v.metadata))
    policy = reduce(lambda c, kv: c.when(F.col("query_type") == kv[0], kv[1]), POLICIES.items(), F.when(F.lit(False), "")).otherwise("balanced")
    empty = F.array().cast("array<string>")
    return out.withColumns({
        "route_policy": policy, "requires_multi_source": F.col("query_type") == "comparison",
        "comparison_terms": F.when(F.col("query_type") == "comparison", F.col("anchor_terms")).otherwise(empty), "subject_terms": alias_subjects(F.col("_joined"), groups)}).drop("_joined")


def variants(profiles: DataFrame, groups: list[list[str]] = ALIASES, v: Vocabulary = Vocabulary()) -> DataFrame:
    """profiles with variants: the spellings to search for, the most telling first."""
    empty = F.array().cast("array<string>")
    one = F.get("clean", F.lit(0))
    compact = F.array_join(F.filter(F.split(one, PUNCTUATION), lambda p: p != ""), " ")
    single = F.when(F.size("clean") == 1, F.array(compact, F.array_join(anchors(one, 6, v), " "))).otherwise(empty)
    swapped = F.flatten(F.transform("clean", lambda q: alias_variants(q, groups)))
    anchor_line = F.array(F.array_join("anchor_terms", " "))
    extra = (F.when((F.col("query_type") == "comparison") & (F.size("comparison_terms") > 0), F.concat(F.array(F.array_join("comparison_terms", " ")), F.col("comparison_terms")))
             .when(F.col("query_type").isin("existence", "procedure") & (F.size("anchor_terms") > 0), anchor_line).otherwise(empty))
    most = F.when(F.col("query_type").isin("comparison", "procedure") | F.col("metadata_focus"), 7).otherwise(5)
    everything = F.concat(F.array("canonical_query"), F.col("clean"), single, swapped, extra)
    return profiles.withColumn("variants", F.when(F.size("clean") == 0, empty).otherwise(F.slice(dedupe_fold(everything), F.lit(1), most)))


def routed(profiles: DataFrame, recall_k: int = 20, rerank_k: int = 6) -> DataFrame:
    """profiles with recall_k and rerank_k, raised for kinds of queries that need more."""
    raised = lambda i, base: F.greatest(F.lit(base), F.when(F.col("query_type") == "comparison", ROUTES["comparison"][i]).when((F.col("query_type") == "procedure") | F.col("metadata_focus"), ROUTES["procedure"][i]).otherwise(0))
    return profiles.withColumns({"recall_k": raised(0, recall_k), "rerank_k": raised(1, rerank_k)})


def constraints(requests: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """request, queries -> request, kind ("category" or "context"), tokens: what the queries say about where to look."""
    found = lambda pattern, kind: F.transform(F.flatten(F.transform("queries", lambda q: F.regexp_extract_all(q, F.lit(pattern), F.lit(1)))), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))
    rows = requests.select("request", F.explode(F.concat(found(v.category, "category"), found(v.context, "context"))).alias("c")).select("request", "c.kind", "c.p")
    rows = rows.filter((F.col("kind") == "category") | ~F.col("p").contains(v.category_word))
    return rows.select("request", "kind", signal_terms(F.col("p"), v.constraint_stop).alias("tokens")).filter(F.size("tokens") > 0).distinct()


def lookup_intents(requests: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """request, queries -> request, lookup_terms: null where the queries don't look something up."""
    joined = F.array_join(F.filter(F.transform("queries", strip), lambda q: q != ""), " ")
    text = F.translate(joined, "？，", "?,")
    return requests.select("request", F.when(any_hint(text, v.lookup_intent) | text.rlike(v.lookup_info), signal_terms(text, [*v.lookup_stop, *v.constraint_stop])).alias("lookup_terms"))
