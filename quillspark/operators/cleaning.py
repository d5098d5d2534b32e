"""Cleaning of Markdown texts, in a fixed order: byte-order mark, newlines, front matter, trailing blanks, contents markers,
placeholders, tables, rules by source.

Lines are arrays, and steps are array expressions. YAML alone needs Python: a small Arrow function over front-matter blocks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import collapse, glob_pattern, let, newlines, rstrip, rstrip_lines, strip

TOC = r"(?i)^\s*\[toc\]\s*$"
# Lines that stand for text to come.
PLACEHOLDER = r"(?i)^\s*(待续|未完待续|todo|tbd|wip)\s*$"
FENCE = r"^\s{0,3}(`{3,}|~{3,})"
ATX = r"^\s{0,3}(#{1,6})\s+(.*?)\s*$"
# How a table reads as sentences.
TABLE_HEAD, TABLE_ROW, TABLE_IS, TABLE_AND = "表格列: ", "表格行:", "是 ", "；"


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def drop_lines(text: Column, pattern: str) -> tuple[Column, Column]:
    """(text without the lines that match, how many they are)."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(pattern)), "\n"), F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def front_matter_bounds(text: Column) -> tuple[Column, Column, Column]:
    """(raw block or null, the text after it, number of lines it takes): from a first line --- to a line --- or ..."""
    lines = F.split(text, "\n", -1)
    ends = F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(r"^\s*(---|\.\.\.)\s*$"), i))
    end = F.get(F.filter(ends, lambda e: e.isNotNull()), F.lit(0))
    found = text.startswith("---") & F.get(lines, F.lit(0)).rlike(r"^\s*---\s*$") & end.isNotNull()
    block = F.when(found, strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0))), "\n")))
    rest = F.when(found, F.array_join(F.slice(lines, end + 2, F.size(lines)), "\n")).otherwise(text)
    return block, rest, F.when(found, end + 1).otherwise(0)


@F.pandas_udf(T.StringType())
def yaml_mapping(blocks):
    """A YAML mapping as JSON with text keys; null if it isn't one."""
    import yaml

    def one(block):
        if not block:
            return None
        try:
            value = yaml.safe_load(block)
        except yaml.YAMLError:
            return None
        return json.dumps({str(k): v for k, v in value.items()}, ensure_ascii=False, default=str) if isinstance(value, dict) and value else None

    return blocks.map(one)


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", ""), r"\|", -1), strip)


def normalise_tables(docs: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    """docs with tables as sentences, tables_normalized and normalized_table_rows.

    Only documents with a separator line are taken apart into lines. A table starts at a row that a separator follows, outside an
    earlier table; its rows are the unbroken run of rows after that: islands between lines that are no rows, found by windows.
    """
    row, sep = r"^\s*\|.*\|\s*$", r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$"
    some = docs.filter(F.col(text).rlike(sep) & F.col(text).contains("|"))
    lines = some.select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no")
    is_row = F.col("line").rlike(row)
    is_sep = F.size(F.filter(table_cells(F.col("line")), lambda c: ~c.rlike(r"^\s*:?-{3,}:?\s*$"))) == 0
    marked = lines.withColumn("r", is_row).withColumn("s", is_sep).withColumn("island", F.sum((~F.col("r")).cast("int")).over(w))
    start = F.col("r") & F.coalesce(F.lead("s").over(w), F.lit(False))
    marked = marked.withColumn("start", start)
    first = marked.withColumn("head", F.min(F.when(F.col("start"), F.col("no"))).over(Window.partitionBy(key, "island")))
    # the separator of a table may lack outer bars; then it is not a row, and the rows after it are the next island
    head = first.withColumn("head", F.coalesce(F.when(F.col("r") & (F.col("no") >= F.col("head")), F.col("head")), F.when(F.col("s") & F.lag("start").over(w), F.col("no") - 1)))
    head = head.withColumn("head", F.coalesce("head", F.when(F.col("r"), F.last(F.when(F.col("s") & ~F.col("r") & F.lag("start").over(w), F.col("head")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))))
    whole = Window.partitionBy(key, "head")
    own = head.withColumn("headers", F.when(F.col("head").isNotNull(), F.min(F.when(F.col("no") == F.col("head"), table_cells(F.col("line")))).over(whole))).withColumn("rows", F.when(F.col("head").isNotNull(), F.count(F.when(F.col("no") > F.col("head") + 1, 1)).over(whole)).otherwise(0))
    cells = table_cells(F.col("line"))
    pairs = let(cells, lambda c: F.array_join(F.filter(F.transform("headers", lambda h, i: F.when((h != "") & (F.coalesce(F.get(c, i), F.lit("")) != ""), F.concat(h, F.lit(TABLE_IS), F.get(c, i)))), lambda x: x.isNotNull()), TABLE_AND))
    said = (F.when(F.col("rows") == 0, F.col("line")).when(F.col("no") == F.col("head"), F.concat(F.lit(TABLE_HEAD), F.array_join("headers", " | "))).when(F.col("no") == F.col("head") + 1, F.lit(None))
            .otherwise(F.concat(F.lit(TABLE_ROW), F.when(pairs != "", F.concat(F.lit(" "), pairs)).otherwise(""))))
    told = own.withColumn("said", said).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("no", "said")))), lambda x: x["said"]), "\n").alias("_new"), F.count(F.when((F.col("no") == F.col("head")) & (F.col("rows") > 0), 1)).alias("_tables"), F.count(F.when((F.col("rows") > 0) & (F.col("no") > F.col("head") + 1), 1)).alias("_rows"))
    return docs.join(told, key, "left").withColumn(text, F.coalesce("_new", text)).withColumns({"tables_normalized": F.coalesce("_tables", F.lit(0)), "normalized_table_rows": F.coalesce("_rows", F.lit(0))}).drop("_new", "_tables", "_rows")


@dataclass(frozen=True)
class SourceRule:
    """What to drop from documents whose source root and path match."""

    id: str = "(unnamed-rule)"
    path_globs: tuple[str, ...] = ()
    source_root_globs: tuple[str, ...] = ()
    drop_line_patterns: tuple[str, ...] = ()
    drop_trailing_headings: tuple[str, ...] = ()
    enabled: bool = True


def any_glob(value: Column, globs: tuple[str, ...]) -> Column:
    return value.rlike("|".join(f"(?:{glob_pattern(g.strip())})" for g in globs if g.strip()))


def rule_matches(rule: SourceRule) -> Column:
    slash = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    root = any_glob(slash(F.col("source_root")), rule.source_root_globs) if rule.source_root_globs else F.lit(True)
    path = any_glob(slash(F.col("relative_path")), rule.path_globs) | any_glob(slash(F.col("file_path")), rule.path_globs) if rule.path_globs else F.lit(True)
    return root & path


def trailing_section(text: Column, titles: tuple[str, ...]) -> Column:
    """The line of the first heading that is listed and whose section runs to the end of the text; null without one."""
    def of(lines: Column) -> Column:
        fenced = F.aggregate(lines, F.struct(F.lit(False).alias("f"), F.array().cast("array<boolean>").alias("all")), lambda a, x: F.struct((a["f"] != x.rlike(FENCE)).alias("f"), F.concat(a["all"], F.array(a["f"] | x.rlike(FENCE))).alias("all")))["all"]
        level = lambda x: F.length(F.regexp_extract(x, ATX, 1))
        title = lambda x: F.lower(strip(F.regexp_replace(strip(F.regexp_extract(x, ATX, 2)), r"\s+#+\s*$", "")))
        heads = F.filter(F.transform(lines, lambda x, i: F.when(~F.get(fenced, i) & x.rlike(ATX), F.struct(i.alias("no"), level(x).alias("level"), title(x).isin(*titles).alias("listed")))), lambda h: h.isNotNull())
        last = let(heads, lambda hs: F.filter(hs, lambda h: h["listed"] & ~F.exists(hs, lambda o: (o["no"] > h["no"]) & (o["level"] <= h["level"]))))
        return F.get(last, F.lit(0))["no"]

    return let(F.split(text, "\n", -1), of)


def apply_rules(docs: DataFrame, rules: list[SourceRule], text: str = "text") -> DataFrame:
    """docs with the rules applied one after the other, source_rules_applied, and what they dropped."""
    docs = docs.withColumns({"source_rules_applied": F.array().cast("array<string>"), "dropped_lines": F.lit(0), "dropped_sections": F.lit(0)})
    for rule in (r for r in rules if r.enabled):
        on = rule_matches(rule)
        cut, n = (F.col(text), F.lit(0)) if not rule.drop_line_patterns else drop_lines(F.col(text), "|".join(f"(?:{p})" for p in rule.drop_line_patterns))
        docs = docs.withColumns({"_on": on, "_n": F.when(on, n).otherwise(0), "_cut": F.when(on, cut).otherwise(F.col(text))})
        titles = tuple(t.strip().lower() for t in rule.drop_trailing_headings if t.strip())
        docs = docs.withColumn("_at", F.when(F.col("_on"), trailing_section(F.col("_cut"), titles)) if titles else F.lit(None).cast("int"))
        docs = docs.withColumn(text, F.when(F.col("_at").isNotNull(), rstrip(F.array_join(F.slice(F.split("_cut", "\n", -1), F.lit(1), F.col("_at")), "\n"))).otherwise(F.col("_cut")))
        docs = docs.withColumns({"dropped_lines": F.col("dropped_lines") + F.col("_n"), "dropped_sections": F.col("dropped_sections") + F.col("_at").isNotNull().cast("int"), "source_rules_applied": F.when((F.col("_n") > 0) | F.col("_at").isNotNull(), F.array_append("source_rules_applied", F.lit(rule.id))).otherwise(F.col("source_rules_applied"))}).drop("_on", "_n", "_cut", "_at")
    return docs


@dataclass(frozen=True)
class Cleaning:
    """Switches; all is off unless enabled."""

    enabled: bool = False
    extract_front_matter: bool = True
    drop_front_matter: bool = True
    normalize_whitespace: bool = True
    drop_toc: bool = True
    drop_placeholders: bool = True
    tables: bool = True
    dedupe_chunks: bool = True
    rules: list[SourceRule] = field(default_factory=list)


def clean(docs: DataFrame, how: Cleaning, text: str = "text", key: str = "document_id") -> DataFrame:
    """docs with the cleaned text, front_matter (JSON, null without) and counters of what each step did."""
    if not how.enabled:
        return docs.withColumn("front_matter", F.lit(None).cast("string"))
    t = F.col(text)
    out = docs.withColumn("bom_removed", F.coalesce(t.startswith("﻿"), F.lit(False))).withColumn(text, newlines(strip_bom(t)))
    out = out.withColumn("front_matter", F.lit(None).cast("string")).withColumn("front_matter_lines", F.lit(0))
    if how.extract_front_matter:
        block, rest, n = front_matter_bounds(t)
        out = out.withColumns({"_block": block, "_rest": rest, "front_matter_lines": n}).withColumn("front_matter", yaml_mapping("_block"))
        if how.drop_front_matter:
            out = out.withColumn(text, F.when(F.col("front_matter").isNotNull(), F.col("_rest")).otherwise(t))
        out = out.drop("_block", "_rest")
    if how.normalize_whitespace:
        out = out.withColumn("_new", rstrip_lines(t)).withColumn("whitespace_normalized", F.col("_new") != t).withColumn(text, F.col("_new")).drop("_new")
    for on, pattern, name in ((how.drop_toc, TOC, "toc_markers_removed"), (how.drop_placeholders, PLACEHOLDER, "placeholders_removed")):
        if on:
            new, n = drop_lines(t, pattern)
            out = out.withColumns({"_new": new, name: n}).withColumn(text, F.col("_new")).drop("_new")
    if how.tables:
        out = normalise_tables(out, text, key)
    return apply_rules(out, how.rules, text) if how.rules else out


def exact_dedupe(chunks: DataFrame, within: str, order: list[str], text: str = "text") -> DataFrame:
    """chunks without repetitions (white space apart) inside a document; the first stays, with group_size. Blank ones always stay.

    `order` tells a document's chunks apart. The first of each text is found by aggregating digests, so that no text is grouped and a text that
    many chunks share is added up before it is shuffled.
    """
    k = chunks.withColumn("_k", F.md5(F.nullif(collapse(F.col(text)), F.lit("")).cast("binary")))
    first = k.filter("_k IS NOT NULL").groupBy(F.col(within).alias("_w"), F.col("_k").alias("_d")).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_size"))
    met = k.join(first, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_k") == F.col("_d")) & F.struct(*order).eqNullSafe(F.col("_first")), "left")
    return met.withColumn("group_size", F.coalesce("_size", F.lit(1))).filter(F.col("_k").isNull() | F.col("_size").isNotNull()).drop("_k", "_w", "_d", "_first", "_size")


def audit(docs: DataFrame, root: str, marks: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Per root: documents, and how many hold any of each group of marks (case-sensitive)."""
    hit = lambda words: F.count(F.when(reduce(lambda a, b: a | b, [F.col(text).contains(x) for x in words]), 1))
    return docs.groupBy(root).agg(F.count("*").alias("documents"), *[hit(v).alias(k) for k, v in marks.items()])


def samples(docs: DataFrame, group: list[str], order: str, n: int, text: str = "text", chars: int = 200) -> DataFrame:
    """The first n of each group, with a preview."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(F.col("_n") <= n).select(*group, order, F.substring(text, 1, chars).alias("preview"))


