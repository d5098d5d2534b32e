"""Ingest queries: hashes, cleaning, chunks, states and stores over the documents, and Markdown over inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import form_of, spread, table
from quillspark.functions.text import language_guess, preview, rstrip_lines, stable_row_id, token_estimate, tokens
from quillspark.operators import cleaning, sections, state
from quillspark.sources import store

from .registry import query

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, sha256(text) AS file_hash, sha1(source) AS source_hash, sha1(doc_id || ':' || source) AS short FROM documents")
def doc_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.sha1("source").alias("source_hash"), F.sha1(F.concat_ws(":", "doc_id", "source")).alias("short"))


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::VARCHAR), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS row_id FROM documents")
def stable_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", stable_row_id(F.col("doc_id").cast("string")).alias("row_id"))


@query("SELECT doc_id, sha1(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), chr(10))) AS h FROM documents")
def doc_line_rstrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha1(rstrip_lines(F.col("text"))).alias("h"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)^\\s*(licensed|copyright).*$'))) AS dropped, sha1(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*(licensed|copyright).*$')), chr(10))) AS h FROM documents")
def doc_drop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, n = cleaning.drop_lines(F.col("text"), r"(?i)^\s*(licensed|copyright).*$")
    return docs(spark, sf_dir).select("doc_id", n.cast("long").alias("dropped"), F.sha1(kept).alias("h"))


@query("WITH k AS (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM documents) SELECT doc_id, group_size FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS n, CASE WHEN k <> '' THEN count(*) OVER (PARTITION BY source, k) ELSE 1 END AS group_size FROM k) WHERE n = 1 OR k = ''")
def doc_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.exact_dedupe(docs(spark, sf_dir), "source", ["doc_id"]).select("doc_id", "group_size")


@query("SELECT lang, count(*) AS documents, count(*) FILTER (contains(text, 'License') OR contains(text, 'Copyright')) AS license, count(*) FILTER (contains(text, '@')) AS mail FROM documents GROUP BY lang")
def cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.audit(docs(spark, sf_dir), "lang", {"license": ["License", "Copyright"], "mail": ["@"]})


@query("SELECT lang, doc_id, substr(text, 1, 200) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def cleaning_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.samples(docs(spark, sf_dir), ["lang"], "doc_id", 5)


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'))::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n, len(list_distinct({TOKENS.format('text')}))::BIGINT AS kinds FROM documents")
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query(f"""WITH f AS (SELECT * FROM (VALUES (0, 'few shot 是 什么'), (1, '混合检索 混合 合检 检索 abc'), (2, '')) t(form, tokens))
SELECT doc_id, md5(trim(tokens || ' ' || array_to_string({TOKENS.format("' ' || coalesce(text, '')")}, ' '))) AS h FROM documents JOIN f ON form = doc_id % 3""")
def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document after a text of two scripts, of Han characters and letters in one, or of none."""
    text = F.concat_ws(" ", form_of("doc_id", ["Few-Shot 是 什么", "混合检索ABC", ""]), "text")
    return docs(spark, sf_dir).select("doc_id", F.md5(F.trim(F.array_join(tokens(text), " "))).alias("h"))


@query("SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS preview, CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS guess FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def doc_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", preview(F.col("text")).alias("preview"), language_guess(F.col("text")).alias("guess"))


MARKDOWN = [
    "# 标题\n\n第一段内容。\n\n## 小节\n\n第二段内容。\n\n# 另一节\ntext",
    "intro\n\nTitle\n=====\nbody\n\nSub\n---\nmore\n```\n# no heading\n```\nend",
    "### deep\na\n# top ##\nb\n## mid\nc\n### low\nd\n## next\ne",
    "## 一\n# 二\n\n### 三\nx",
    "no heading at all",
    "\n\n",
]
SQL_SECTIONS = """(VALUES (1, 0, '标题', '标题', 1, 1, 4, '# 标题~~第一段内容。'), (1, 1, '标题 / 小节', '小节', 2, 5, 8, '## 小节~~第二段内容。'), (1, 2, '另一节', '另一节', 1, 9, 10, '# 另一节~text'),
(2, 0, '', '', 0, 1, 2, 'intro'), (2, 1, 'Title', 'Title', 1, 3, 6, 'Title~body'), (2, 2, 'Title / Sub', 'Sub', 2, 7, 13, 'Sub~more~```~# no heading~```~end'),
(3, 0, 'deep', 'deep', 3, 1, 2, '### deep~a'), (3, 1, 'top', 'top', 1, 3, 4, '# top ##~b'), (3, 2, 'top / mid', 'mid', 2, 5, 6, '## mid~c'), (3, 3, 'top / mid / low', 'low', 3, 7, 8, '### low~d'), (3, 4, 'top / next', 'next', 2, 9, 10, '## next~e'),
(4, 0, '一', '一', 2, 1, 1, '## 一'), (4, 1, '二', '二', 1, 2, 3, '# 二'), (4, 2, '二 / 三', '三', 3, 4, 5, '### 三~x'), (0, 0, '', '', 0, 1, 3, '~~'), (5, 0, '', '', 0, 1, 1, 'no heading at all')) t(document_id, section_index, title_path, heading, heading_level, start_line, end_line, text)"""


@query(f"""WITH e AS (SELECT *, max(section_index) OVER (PARTITION BY document_id) = section_index AS last FROM {SQL_SECTIONS})
SELECT doc_id, section_index, title_path, heading, heading_level, start_line, end_line + last::INT AS end_line, md5(e.text || CASE WHEN last THEN '~doc ' || doc_id ELSE '' END) AS h FROM documents JOIN e ON document_id = doc_id % 6""")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown of one of six forms (the sixth is blank but for its last line), with its id in the last line."""
    text = F.concat(form_of("doc_id", [MARKDOWN[5], *MARKDOWN[:5]]), F.lit("\ndoc "), F.col("doc_id").cast("string"))
    s = sections.sections(docs(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id")
    return s.select("doc_id", F.col("section_index").cast("int").alias("section_index"), F.array_join("title_path", " / ").alias("title_path"), "heading", "heading_level", "start_line", "end_line", F.md5(F.replace("text", F.lit("\n"), F.lit("~"))).alias("h"))


TABLES = ["before\n| 文件类型 | 类型参数 |\n|---|:---:|\n| 普通文件 | f |\n| 目录 | |\n|  |  |\nafter", "| a | b |\n| --- | --- |\nno rows", "| not | a table |\nx"]


@query("""WITH e AS (SELECT * FROM (VALUES (0, 'before~表格列: 文件类型 | 类型参数~表格行: 文件类型是 普通文件；类型参数是 f~表格行: 文件类型是 目录~表格行:~after', 1, 3), (1, '| a | b |~| --- | --- |~no rows', 0, 0), (2, '| not | a table |~x', 0, 0)) t(form, text, tables, n_rows))
SELECT doc_id, md5('doc ' || doc_id || '~' || e.text) AS h, tables, n_rows FROM documents JOIN e ON form = doc_id % 3""")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its id above a table, a table without rows, or none."""
    text = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\n"), form_of("doc_id", TABLES))
    t = cleaning.normalise_tables(docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), text.alias("text")))
    return t.select(F.col("document_id").alias("doc_id"), F.md5(F.replace("text", F.lit("\n"), F.lit("~"))).alias("h"), F.col("tables_normalized").cast("int").alias("tables"), F.col("normalized_table_rows").cast("int").alias("n_rows"))


FRONT = ["---\ntitle: A\naliases: [x, y]\n---\nbody  \n[TOC]\nTODO\nend", "---\nnot closed\nbody", "---\n- a\n- list\n---\nkept", "---\n---\nempty block", "\ufeffplain\r\nlines\r"]


@query("""WITH e AS (SELECT * FROM (VALUES (0, '{"title": "A", "aliases": ["x", "y"]}', 'body~end', 1, 1), (1, NULL, '---~not closed~body', 0, 0), (2, NULL, '---~- a~- list~---~kept', 0, 0), (3, NULL, '---~---~empty block', 0, 0), (4, NULL, 'plain~lines', 0, 0)) t(form, front_matter, text, toc, placeholders))
SELECT doc_id, front_matter, md5(e.text || '~doc ' || doc_id) AS h, toc, placeholders FROM documents JOIN e ON form = doc_id % 5""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's id below one of five beginnings: front matter, none that is closed, a list, an empty block, other line ends."""
    text = F.concat(form_of("doc_id", FRONT), F.lit("\ndoc "), F.col("doc_id").cast("string"))
    c = cleaning.clean(docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), text.alias("text")), cleaning.Cleaning(enabled=True))
    return c.select(F.col("document_id").alias("doc_id"), "front_matter", F.md5(F.replace("text", F.lit("\n"), F.lit("~"))).alias("h"), F.col("toc_markers_removed").cast("int").alias("toc"), F.col("placeholders_removed").cast("int").alias("placeholders"))


@query("""WITH e AS (SELECT * FROM (VALUES (0, 'keep~more', 1, 1, 'edited'), (1, '[编辑于 2017-09-20](x)', 0, 0, ''), (2, '## 参考链接~link~# after~x', 0, 0, '')) t(form, text, dropped_lines, dropped_sections, applied))
SELECT doc_id, md5('doc ' || doc_id || '~' || e.text) AS h, dropped_lines, dropped_sections, applied FROM documents JOIN e ON form = doc_id % 3""")
def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's id above a text that a rule changes, one under another root, or one in which the named section is not the last."""
    rule = cleaning.SourceRule("edited", ("*.md",), ("/notes*",), (r"^\[编辑于 \d{4}-\d{2}-\d{2}\]",), ("参考链接",))
    form = lambda values: form_of("doc_id", values)
    text = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\n"), form(["keep\n[编辑于 2017-09-20](x)\nmore\n## 参考链接\nlink", "[编辑于 2017-09-20](x)", "## 参考链接\nlink\n# after\nx"]))
    path = F.concat(form(["a/", "a/", ""]), F.col("doc_id").cast("string"), F.lit(".md"))
    root = form(["/notes", "/other", "/notes"])
    r = cleaning.apply_rules(docs(spark, sf_dir).select("doc_id", root.alias("source_root"), path.alias("relative_path"), F.concat(root, F.lit("/"), path).alias("file_path"), text.alias("text")), [rule])
    return r.select("doc_id", F.md5(F.replace("text", F.lit("\n"), F.lit("~"))).alias("h"), "dropped_lines", "dropped_sections", F.array_join("source_rules_applied", ",").alias("applied"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, i, x, CASE WHEN trim(x) = '' THEN 1 ELSE 0 END AS blank FROM (SELECT conv_id, unnest(string_split(trim(text, ' ' || chr(10)), chr(10))) AS x, generate_subscripts(string_split(trim(text, ' ' || chr(10)), chr(10)), 1) AS i FROM t)),
g AS (SELECT *, sum(blank) OVER (PARTITION BY conv_id ORDER BY i) AS gap FROM l)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY gap) - 1)::INT AS block_no, sha1(trim(string_agg(x, chr(10) ORDER BY i))) AS h, min(i)::INT AS start_line, max(i)::INT AS end_line FROM g WHERE blank = 0 GROUP BY conv_id, gap""")
def blocks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document, its turns are paragraphs."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text")).withColumn("start_line", F.lit(1))
    b = sections.blocks(turns, ["conv_id"])
    return b.select("conv_id", F.col("block_no").cast("int").alias("block_no"), F.sha1("text").alias("h"), "start_line", "end_line")


SQL_PIECES = """WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
step AS (SELECT doc_id, t, 0 AS st, 0 AS k FROM t WHERE length(t) > 0
  UNION ALL SELECT doc_id, t, greatest(cut - 100, st + 1), k + 1 FROM (SELECT *, {cut} AS cut FROM step) WHERE cut < length(t)),
p AS (SELECT doc_id, k, regexp_replace(substr(t, st + 1, cut - st), '^\\s+|\\s+$', '', 'g') AS piece FROM (SELECT *, {cut} AS cut FROM step))"""


def _cut() -> str:
    w = "substr(t, st + 1, least(length(t), st + 800) - st)"
    cases = []
    for s in sections.SEPARATORS:
        q = "chr(10) || chr(10)" if s == "\n\n" else "chr(10)" if s == "\n" else f"'{s}'"
        r = q if s in ("\n\n", "\n") or len(s) == 1 else f"'{s[::-1]}'"
        off = f"(length({w}) - instr(reverse({w}), {r}) - {len(s)} + 1)"
        cases.append(f"WHEN instr(reverse({w}), {r}) > 0 AND {off} > 0 THEN st + {off} + {len(s)}")
    return f"CASE WHEN st + 800 >= length(t) THEN length(t) {' '.join(cases)} ELSE least(length(t), st + 800) END"


@query(SQL_PIECES.replace("{cut}", _cut()) + " SELECT doc_id, count(*) AS pieces, sum(length(piece))::BIGINT AS chars, min(length(piece)) AS shortest, md5(string_agg(piece, '|' ORDER BY k)) AS h FROM p WHERE piece <> '' GROUP BY doc_id")
def chunk_long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = docs(spark, sf_dir).select("doc_id", F.posexplode(sections.long_pieces()(F.col("text"))).alias("k", "piece"))
    one = cut.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("chars"), F.min(F.length("piece")).cast("long").alias("shortest"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "|")).alias("h"))
    return one


@query("SELECT doc_id, sha1(doc_id || chr(10) || source || chr(10) || '0' || chr(10) || '0' || chr(10) || sha1(text)) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", sections.chunk_id(F.col("doc_id"), F.array("source"), F.lit(0), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, sha1('文档标题: ' || doc_id || chr(10) || '文档路径: ' || source || '/' || doc_id || '.md' || chr(10) || '章节路径: ' || source || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h FROM documents WHERE trim(text) <> ''")
def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    c = docs(spark, sf_dir).filter(F.trim("text") != "").select("doc_id", sections.contextual_text(F.col("text"), path, path, F.lit(None).cast("string"), F.array("source")).alias("c"))
    return c.select("doc_id", F.sha1("c").alias("h"))


@query()
def chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and chunks of every document; held against the chunker's rules by tests."""
    s = sections.sections(spread(docs(spark, sf_dir)).select(F.col("doc_id").alias("document_id"), "text"))
    return sections.renumbered(sections.chunks(s, compat=False)).select("document_id", "chunk_index", "chunk_id", "token_count", "start_line", "end_line")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir)
    base = d.select(F.col("doc_id").alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.lit(0).cast("long").alias("mtime_ns"), F.col("n_chars").alias("size"), F.col("source").alias("file_path"))
    later = base.filter("document_id % 7 <> 0").withColumn("file_hash", F.when(F.col("document_id") % 5 == 0, F.concat("file_hash", F.lit("x"))).otherwise(F.col("file_hash")))
    return base.filter("document_id % 11 <> 0"), later


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)")
def file_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.diff(*snapshots(spark, sf_dir)).select("document_id", "status")


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text) || 'x' ELSE sha256(text) END AS file_hash FROM documents WHERE doc_id % 7 <> 0")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return state.applied(old, new, state.plan(state.diff(old, new))).select("document_id", "file_hash")


@query("SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM conversations) AS chunk_count, greatest((SELECT max(n_chars) FROM documents), (SELECT max(turn) FROM conversations)) AS last_indexed_at, 20::BIGINT AS source_count")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stats(docs(spark, sf_dir).withColumnRenamed("n_chars", "updated_at"), table(spark, sf_dir, "conversations").withColumnRenamed("turn", "updated_at"), sources=20)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return store.upserted(o.filter("o_orderkey % 4 <> 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    _, lines = store.cascade_deleted(o, table(spark, sf_dir, "lineitem").select("l_orderkey"), o.filter("o_orderpriority = '1-URGENT'"), "o_orderkey", "l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n <= 25")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events"), "click", 25, "event_id", "event_type").select("event_type", "event_id")


@query("""SELECT 't' AS "column", count(*) AS scanned, count(*) FILTER (event_id % 4 = 0) AS updated, count(*) FILTER (event_id % 4 >= 2) AS skipped_null, count(*) FILTER (event_id % 4 = 1) AS unchanged FROM events""")
def timestamp_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all events as texts: with a T, in the form that is wanted, null, and unreadable."""
    at = lambda form: F.date_format(F.col("ts").cast("timestamp"), form)
    k = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(F.when(k == 0, at("yyyy-MM-dd'T'HH:mm:ss.SSS")).when(k == 1, at("yyyy-MM-dd HH:mm:ss.SSS")).when(k == 3, "never").alias("t"))
    return store.rewritten_timestamps(rows, ["t"])[1]


@query("SELECT lang AS category, guess AS language, count(*) AS documents FROM (SELECT lang, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS guess FROM documents) GROUP BY ALL")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.sources.markdown import manifest, titled

    d = docs(spark, sf_dir).select("text", F.col("lang").alias("category"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"))
    return manifest(titled(d))
