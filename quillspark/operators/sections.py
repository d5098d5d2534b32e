"""Sections of Markdown texts by windows over lines, and chunks of sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import file_name, file_stem, newlines, rstrip, strip, token_estimate

FENCE = r"^\s{0,3}(`{3,}|~{3,})"
ATX = r"^\s{0,3}(#{1,6})\s+(.*?)\s*$"
SIZE, OVERLAP, VERSION = 800, 100, "v1"
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " "]


def marked_lines(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """key, no (from 1), line, in_fence (before the line), level (0: no heading), title, skipped (a heading's underline).

    A heading is found before a fence is, so that a fence line over an underline is a heading and opens nothing. Where
    underlines follow each other, each second one is text again: whether a line is skipped depends on the line before, which a
    run-length window over the candidate lines settles.
    """
    lines = docs.select(key, F.posexplode(F.split(newlines(F.col(text)), "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no")
    under = F.lead("line").over(w).rlike(r"^\s{0,3}(=+|-+)\s*$")
    m = lines.withColumn("atx", F.col("line").rlike(ATX)).withColumn("fence", F.col("line").rlike(FENCE))
    m = m.withColumn("setext", ~F.col("atx") & F.coalesce(under, F.lit(False)) & (strip(F.col("line")) != "")).withColumn("next_eq", F.coalesce(F.lead("line").over(w).rlike(r"^\s{0,3}=+\s*$"), F.lit(False)))
    # fences toggle on lines that are no heading; a heading inside a fence is none, so the parity is taken over plain fence lines first
    m = m.withColumn("in_fence", F.coalesce(F.sum((F.col("fence") & ~F.col("setext")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
    run = F.sum((~F.col("setext") | F.col("in_fence")).cast("int")).over(w)
    m = m.withColumn("run", run).withColumn("nth", F.row_number().over(Window.partitionBy(key, "run").orderBy("no")))
    first_of_run = F.col("setext") & ~F.col("in_fence")
    # inside a run of candidates the first counts, the second is its underline, the third counts again
    offset = F.col("nth") - F.min(F.when(first_of_run, F.col("nth"))).over(Window.partitionBy(key, "run"))
    m = m.withColumn("head", first_of_run & (offset % 2 == 0))
    m = m.withColumn("skipped", F.coalesce(F.lag("head").over(w), F.lit(False)))
    level = F.when(F.col("in_fence") | F.col("skipped"), 0).when(F.col("atx"), F.length(F.regexp_extract("line", ATX, 1))).when(F.col("head"), F.when(F.col("next_eq"), 1).otherwise(2)).otherwise(0)
    title = F.when(F.col("atx"), strip(F.regexp_replace(strip(F.regexp_extract("line", ATX, 2)), r"\s+#+\s*$", ""))).otherwise(strip(F.col("line")))
    return m.select(key, (F.col("no") + 1).alias("no"), "line", "in_fence", level.alias("level"), F.when(level > 0, title).alias("title"), "skipped")


def sections(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """key, section_index, title_path, heading, heading_level, start_line, end_line, text.

    Text before the first heading is a section without titles; sections of blank lines alone are dropped and take no index. The
    titles above a heading are, level by level, the last heading of that level since one of a higher rank.
    """
    w = Window.partitionBy(key).orderBy("no")
    m = marked_lines(docs, key, text).withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        m = m.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct(F.col("no"), F.col("title"))), ignorenulls=True).over(upto))
        m = m.withColumn(f"c{k}", F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("no"))).over(upto))
    now = F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(upto)
    m = m.withColumn("now", F.coalesce(now, F.lit(0)))
    alive = lambda k: (F.col("now") >= k) & F.col(f"h{k}").isNotNull() & (F.col(f"h{k}.no") > F.coalesce(f"c{k}", F.lit(0)))
    path = F.array_compact(F.array(*[F.when(alive(k), F.col(f"h{k}.title")) for k in range(1, 7)]))
    rows = m.filter("NOT skipped").select(key, "no", "line", "part", "now", path.alias("path"))
    one = rows.groupBy(key, "part").agg(F.min("no").alias("start_line"), F.max("no").alias("end_line"), F.max("path").alias("title_path"), F.max("now").alias("heading_level"), F.sort_array(F.collect_list(F.struct("no", "line"))).alias("l"))
    one = one.withColumn("text", rstrip(F.array_join(F.transform("l", lambda x: rstrip(x["line"])), "\n"))).filter("text <> ''")
    numbered = one.withColumn("section_index", F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1)
    return numbered.select(key, "section_index", "title_path", F.coalesce(F.get("title_path", F.size("title_path") - 1), F.lit("")).alias("heading"), "heading_level", "start_line", "end_line", "text")


def blocks(secs: DataFrame, keys: list[str], text: str = "text", start: str = "start_line") -> DataFrame:
    """keys, block_no, text, start_line, end_line: paragraphs between blank lines outside fences. Line numbers count from the first
    line of the stripped text."""
    lines = secs.select(*keys, start, F.posexplode(F.split(strip(newlines(F.col(text))), "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(*keys).orderBy("no")
    fence = F.col("line").rlike(FENCE)
    inside = F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    m = lines.withColumn("inside", inside).withColumn("blank", ~F.col("inside") & ~fence & (strip(F.col("line")) == ""))
    m = m.withColumn("gap", F.sum(F.col("blank").cast("int")).over(w)).filter("NOT blank")
    out = m.groupBy(*keys, start, "gap").agg(F.min("no").alias("a"), F.max("no").alias("b"), F.sort_array(F.collect_list(F.struct("no", "line"))).alias("l"))
    out = out.withColumn("text", strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).filter("text <> ''")
    return out.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("gap")) - 1).alias("block_no"), "text", (F.col(start) + F.col("a")).alias("start_line"), (F.col(start) + F.col("b")).alias("end_line"))


def long_pieces(size: int = SIZE, overlap: int = OVERLAP, compat: bool = True):
    """A column function: pieces of a long text. A piece ends after the last separator of its window, by rank of separators, else at
    `size`; the next starts `overlap` before that end. compat=False never starts a piece inside the separator's own step back: it
    moves on by half a window at least, where the other form can crawl letter by letter."""
    overlap = max(0, min(overlap, size - 1))

    def cut(t: str) -> list[str]:
        t = t.replace("\r\n", "\n").replace("\r", "\n").strip()
        out, at = [], 0
        while at < len(t):
            end = min(len(t), at + size)
            if end < len(t):
                place = next(((p, len(s)) for s in SEPARATORS if (p := t.rfind(s, at, end)) > at), None)
                end = place[0] + place[1] if place else end
            if piece := t[at:end].strip():
                out.append(piece)
            if end >= len(t):
                break
            step = max(end - overlap, at + 1)
            at = step if compat else max(step, min(end, at + size // 2))
        return out

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t) if t is not None else [])

    return pieces


def chunks(secs: DataFrame, key: str = "document_id", size: int = SIZE, overlap: int = OVERLAP, compat: bool = True) -> DataFrame:
    """Sections -> key, section_index, title_path, chunk_index, text, start_line, end_line, token_count, chunk_id.

    Blocks are packed greedily up to `size` letters, two more between blocks; a longer block is cut into pieces that are chunks of
    their own. The packing is a fold over a section's array of blocks.
    """
    b = blocks(secs, [key, "section_index"])
    pieces = long_pieces(size, overlap, compat)
    own = b.withColumn("long", F.length("text") > size).withColumn("pieces", F.when(F.col("long"), pieces(F.when(F.col("long"), F.col("text")))))
    arranged = own.groupBy(key, "section_index").agg(F.sort_array(F.collect_list(F.struct("block_no", "text", "start_line", "end_line", "long"))).alias("b"))
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-1).cast("int").alias("g"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("groups"))

    def step(a: Column, x: Column) -> Column:
        alone, grown = x["long"], a["n"] + 2 + F.length(x["text"])
        new = alone | ~a["open"] | (grown > size)
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        return F.struct(F.when(alone, 0).when(new, F.length(x["text"])).otherwise(grown).cast("int").alias("n"), g.alias("g"), (~alone).alias("open"), F.array_append(a["groups"], g).alias("groups"))

    grouped = arranged.withColumn("g", F.aggregate("b", start, step)["groups"]).select(key, "section_index", F.inline(F.arrays_zip("b", "g"))).select(key, "section_index", F.col("b.block_no").alias("block_no"), "g")
    packed = own.join(grouped, [key, "section_index", "block_no"]).groupBy(key, "section_index", "g").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n").alias("joined"), F.max("pieces").alias("pieces"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    rows = packed.select(key, "section_index", "g", "start_line", "end_line", F.posexplode(F.coalesce("pieces", F.array("joined"))).alias("p", "text"))
    out = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key, "section_index").orderBy("g", "p")) - 1).join(secs.select(key, "section_index", "title_path"), [key, "section_index"])
    return out.select(key, "section_index", "title_path", "chunk_index", "text", "start_line", "end_line", token_estimate(F.col("text")).alias("token_count"), chunk_id(F.col(key), F.col("title_path"), F.col("section_index"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


def chunk_id(document: Column, titles: Column, section: Column, chunk: Column, text: Column) -> Column:
    """A SHA-1 over document, title path, both indexes, and the text's own SHA-1."""
    return F.sha1(F.concat_ws("\n", document.cast("string"), F.array_join(titles, " / "), section.cast("string"), chunk.cast("string"), F.sha1(text.cast("binary"))).cast("binary"))


def contextual_text(text: Column, relative_path: Column, file_path: Column, title: Column, titles: Column) -> Column:
    """What is embedded for a chunk: title, path and section over the body; empty without a body."""
    body = strip(newlines(text))
    label = F.coalesce(F.nullif(strip(F.coalesce(relative_path, F.lit(""))), F.lit("")), F.nullif(file_name(file_path), F.lit("")), strip(file_path))
    named = F.nullif(strip(F.coalesce(title, F.lit(""))), F.lit(""))
    path = F.nullif(F.array_join(F.filter(F.transform(titles, strip), lambda t: t != ""), " / "), F.lit(""))
    some = F.nullif(label, F.lit(""))
    # The labels of a header.
    head = F.concat_ws("\n", F.concat(F.lit("文档标题: "), F.coalesce(named, file_stem(some))), F.concat(F.lit("文档路径: "), some), F.concat(F.lit("章节路径: "), path))
    return F.when(body == "", "").when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def renumbered(chunk_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """chunk_index from 0 through a whole document."""
    return chunk_rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("section_index", "chunk_index")) - 1)


def with_metadata(chunk_rows: DataFrame, documents: DataFrame, columns: list[str], key: str = "document_id") -> DataFrame:
    """chunks with columns of their documents; a column that chunks have themselves goes first."""
    own = documents.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    joined = chunk_rows.join(own, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(c, f"_d_{c}") if c in chunk_rows.columns else F.col(f"_d_{c}"))
    return joined.drop(*[f"_d_{c}" for c in columns])
