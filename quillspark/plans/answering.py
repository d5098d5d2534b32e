"""Answering queries: understanding of inline questions, and guardrails, evidence, prompts and citations over the documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import form_of, kept, spread, table
from quillspark.functions.vocabulary import ALIASES
from quillspark.operators import answering, asking, guardrail, ranking, semantic, understanding

from .registry import query
from .retrieval import SQL_BM25, SQL_RERANK, SQL_RRF, TOKENS, asked, lexical_hits, reranked

QUESTIONS = ["2PC 和 3PC 有什么区别", "如何 安装 Redis", "笔记里有没有 raft", "哪些参数 对应 gdb", "HLC", ""]
#: The form of a turn's question, and a word of its own.
SQL_TURNS = "q AS (SELECT conv_id || ':' || turn AS request, (conv_id + turn) % 6 + 1 AS form, 'w' || conv_id || 'x' || turn AS w FROM conversations)"


def questions(spark: SparkSession, sf_dir: str, own: bool = False) -> DataFrame:
    """Every turn as a question of one of six forms; own: with a word of its own at the end."""
    word = F.concat(F.lit("w"), F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string"))
    form = form_of("_k", QUESTIONS)
    q = spread(table(spark, sf_dir, "conversations")).withColumn("_k", F.col("conv_id") + F.col("turn"))
    q = q.select(F.concat_ws(":", "conv_id", "turn").alias("request"), (F.concat_ws(" ", form, word) if own else form).alias("question"))
    return q.withColumn("queries", F.array("question"))


@query(f"""WITH {SQL_TURNS}, e AS (SELECT * FROM (VALUES (1, 'comparison', 'comparison-diverse', FALSE, TRUE), (2, 'procedure', 'procedure-semantic', FALSE, FALSE), (3, 'existence', 'existence-precise', TRUE, FALSE), (4, 'lookup', 'lookup-precise', FALSE, FALSE), (5, 'definition', 'balanced', FALSE, FALSE), (6, 'definition', 'balanced', FALSE, FALSE)) t(form, query_type, route_policy, metadata_focus, requires_multi_source)) SELECT request, query_type, route_policy, metadata_focus, requires_multi_source FROM q JOIN e USING (form)""")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.profile(questions(spark, sf_dir, True)).select("request", "query_type", "route_policy", "metadata_focus", "requires_multi_source")


@query(f"""WITH {SQL_TURNS}, e AS (SELECT * FROM (VALUES (1, '2pc|和|3pc|有什么区别'), (2, 'redis'), (3, '笔记里有没有|笔记|记里|里有'), (4, '哪些参数|些参|参数|对应'), (5, 'hlc'), (6, '')) t(form, anchors)) SELECT request, CASE WHEN form IN (2, 5) THEN anchors || '|' || w WHEN form = 6 THEN w ELSE anchors END AS anchors FROM q JOIN e USING (form)""")
def query_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.profile(questions(spark, sf_dir, True)).select("request", F.array_join("anchor_terms", "|").alias("anchors"))


@query(f"""WITH {SQL_TURNS}, e AS (SELECT * FROM (VALUES (1, '两阶段提交 和 3pc 有什么区别|两阶段提交协议 和 3pc 有什么区别|2pc 和 三阶段提交 有什么区别'), (2, ''), (3, ''), (4, '哪些参数 对应 gnu debugger|哪些参数 对应 调试器'), (5, 'hybrid logical clock|混合逻辑时钟'), (6, '')) t(form, variants)) SELECT request, CASE WHEN variants = '' THEN '' ELSE replace(variants, '|', ' ' || w || '|') || ' ' || w END AS variants FROM q JOIN e USING (form)""")
def alias_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir, True).select("request", F.array_join(understanding.alias_variants(F.col("question"), ALIASES), "|").alias("variants"))


@query(f"""WITH {SQL_TURNS}, e AS (SELECT * FROM (VALUES (1, '2PC 和 3PC 有什么区别|2pc 和 3pc 有什么区别 有什 么区|两阶段提交 和 3pc 有什么区别|两阶段提交协议 和 3pc 有什么区别|2pc 和 三阶段提交 有什么区别|2pc|和'), (2, '如何 安装 Redis|redis'), (3, '笔记里有没有 raft|笔记里有没有 笔记 记里 里有 有没 没有|笔记里有没有 笔记 记里 里有'), (4, '哪些参数 对应 gdb|哪些参数 些参 参数 对应 gdb|哪些参数 对应 gnu debugger|哪些参数 对应 调试器'), (5, 'HLC|hybrid logical clock|混合逻辑时钟'), (6, '')) t(form, variants)) SELECT request, variants FROM q JOIN e USING (form)""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.variants(understanding.profile(questions(spark, sf_dir))).select("request", F.array_join("variants", "|").alias("variants"))


@query(f"""WITH {SQL_TURNS}, e AS (SELECT * FROM (VALUES (1, 24, 8), (2, 22, 8), (3, 22, 8), (4, 20, 6), (5, 20, 6), (6, 20, 6)) t(form, recall_k, rerank_k)) SELECT request, recall_k, rerank_k FROM q JOIN e USING (form)""")
def route_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.routed(understanding.profile(questions(spark, sf_dir, True))).select("request", "recall_k", "rerank_k")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(ranking.score_filter(reranked(spark, sf_dir)), 6)


SQL_EVIDENCE = f"""{SQL_BM25}, {SQL_RRF}, {SQL_RERANK},
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rplace) AS p FROM rk WHERE score >= 0.1) WHERE p <= 6),
es AS (SELECT request, least(1, greatest(0, score)) AS s, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars, row_number() OVER (PARTITION BY request ORDER BY least(1, greatest(0, score)) DESC, p) AS n FROM ev WHERE trim(text) <> ''),
sm AS (SELECT b.item_id AS request, coalesce(max(s), 0) AS top1, coalesce(avg(s) FILTER (n <= 3), 0) AS top3, count(*) FILTER (chars >= 8) AS hit_count, coalesce(sum(chars), 0)::BIGINT AS total_chars FROM benchmark b LEFT JOIN es ON request = item_id GROUP BY 1),
ab AS (SELECT *, CASE WHEN top1 < 0.2 THEN 'top1_score_below_threshold' WHEN top3 < 0.3 THEN 'top3_avg_score_below_threshold' WHEN hit_count < 2 THEN 'recall_hits_below_threshold' WHEN total_chars < 150 THEN 'evidence_chars_below_threshold' END AS reason FROM sm)"""


@query(f"WITH {SQL_EVIDENCE} SELECT request, reason IS NOT NULL AS abstained, reason, round(top1, 6) AS top1, round(top3, 6) AS top3, hit_count, total_chars FROM ab")
def abstain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = guardrail.abstain(asked(spark, sf_dir), guardrail.evidence_summary(evidence(spark, sf_dir)))
    return a.select("request", "abstained", "reason", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"), "hit_count", "total_chars")


SQL_TERMS = f"""ed AS (SELECT request, source, list_distinct(flatten(list({TOKENS.format('text')}))) AS terms, count(*) AS hits FROM ev GROUP BY ALL),
qs AS (SELECT item_id AS request, list_distinct({TOKENS.format('text')}) AS a, list_distinct({TOKENS.format('left(text, 60)')}) AS b FROM benchmark)"""


@query(f"WITH {SQL_EVIDENCE}, {SQL_TERMS} SELECT request, round(coalesce(max(len(list_intersect(a, terms)) / len(a)), 0), 6) AS coverage FROM qs LEFT JOIN ed USING (request) GROUP BY request")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as single queries; a source is a document of several chunks."""
    docs = guardrail.evidence_terms(evidence(spark, sf_dir), [F.col("content")])
    c = guardrail.term_coverage(asked(spark, sf_dir).select("request", F.array("query").alias("queries")), docs)
    return c.select("request", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {SQL_EVIDENCE}, {SQL_TERMS},
w AS (SELECT request, t, count(*) AS w FROM (SELECT request, unnest(a) AS t FROM qs UNION ALL SELECT request, unnest(b) FROM qs) GROUP BY ALL),
tw AS (SELECT request, sum(w) AS tot FROM w GROUP BY request),
we AS (SELECT e.request, e.source, sum(w) FILTER (list_contains(terms, t)) / max(tot) AS c FROM ed e JOIN w USING (request) JOIN tw USING (request) WHERE hits >= 2 GROUP BY ALL),
pl AS (SELECT request, max(greatest(len(list_intersect(a, terms)) / len(a), len(list_intersect(b, terms)) / len(b))) AS c FROM qs JOIN ed USING (request) GROUP BY request)
SELECT item_id AS request, round(greatest(coalesce((SELECT c FROM pl WHERE request = item_id), 0), coalesce((SELECT max(c) FROM we WHERE request = item_id), 0)), 6) AS coverage FROM benchmark""")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of each passage: all of it, and its first letters."""
    docs = guardrail.evidence_terms(evidence(spark, sf_dir), [F.col("content")])
    two = asked(spark, sf_dir).select("request", F.array("query", F.left("query", F.lit(60))).alias("queries"))
    return guardrail.term_coverage(two, docs).select("request", F.round("coverage", 6).alias("coverage"))


def of_conversations(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """The rows for each conversation, its id in front of their request."""
    names = [x.split()[0] for x in schema.split(", ")]
    made = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}>>")
    each = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.inline(made))
    return each.withColumn("request", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("request").cast("string"))).drop("conv_id")


PROFILES = [(1, "comparison", ["redis", "raft"]), (2, "comparison", ["redis", "raft"]), (3, "comparison", ["redis", "raft"]), (4, "lookup", ["redis", "raft"])]
FOUND = [(1, "d1", ["redis", "raft"], 1), (2, "d1", ["redis"], 1), (2, "d2", ["raft", "x"], 2), (3, "d1", ["redis"], 1), (3, "d2", ["redis"], 2)]


@query("SELECT DISTINCT conv_id || ':' || request AS request, complete FROM conversations, (VALUES (1, TRUE), (2, TRUE), (3, FALSE)) t(request, complete)")
def comparison_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation asks four times; what is found differs."""
    p = of_conversations(spark, sf_dir, PROFILES, "request int, query_type string, comparison_terms array<string>")
    d = of_conversations(spark, sf_dir, FOUND, "request int, document string, terms array<string>, first_place int")
    return guardrail.comparison_complete(p, d)


@query("SELECT DISTINCT conv_id || ':' || request AS request, strong FROM conversations, (VALUES (1, TRUE), (2, FALSE), (3, TRUE), (4, FALSE)) t(request, strong)")
def existence_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation asks four times. The top document may cover three fifths; another one has to cover all."""
    r = of_conversations(spark, sf_dir, [(i, ["aa bb cc"]) for i in range(1, 5)], "request int, queries array<string>")
    d = of_conversations(spark, sf_dir, [(1, "t", ["aa", "bb"], 1), (2, "t", ["aa"], 1), (2, "o", ["aa", "bb"], 2), (3, "t", ["x"], 1), (3, "o", ["aa", "bb", "cc"], 2), (4, "t", ["x"], 1)], "request int, document string, terms array<string>, first_place int")
    return guardrail.strong_existence(r, d)


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations),
n AS (SELECT a.conv_id, a.turn, b.turn AS t, b.text AS x, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY CASE WHEN b.turn // 2 = a.turn // 2 THEN 0 ELSE 1 END, abs(b.turn - a.turn), b.turn) AS k FROM c a JOIN c b USING (conv_id))
SELECT conv_id || ':' || turn AS chunk_id, string_agg(t::VARCHAR, ',' ORDER BY t) AS turns, md5(string_agg(trim(x), chr(10) || chr(10) ORDER BY t)) AS h FROM n WHERE k <= 3 GROUP BY conv_id, turn""")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are chunks, two turns a section, a conversation is a document."""
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.floor(F.col("turn") / 2).alias("section_index"), F.col("text").alias("content"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    out = answering.parent_context(chunks.select(F.lit(1).alias("request"), "chunk_id"), chunks)
    return out.select("chunk_id", F.array_join(F.transform("chunk_ids", lambda x: F.substring_index(x, ":", -1)), ",").alias("turns"), F.md5("content").alias("h"))


@query(f"WITH {SQL_EVIDENCE} SELECT request, doc_id, row_number() OVER (PARTITION BY request ORDER BY p) AS ref_index, source || ':' || (doc_id + 1) || '-' || (doc_id + 3) AS location FROM ev WHERE trim(text) <> ''".replace("source || ':'", "doc_id || '.md:'"))
def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = answering.sources(evidence(spark, sf_dir))
    return s.select("request", F.col("chunk_id").alias("doc_id"), F.col("ref_index").cast("long").alias("ref_index"), ranking.location(F.col("file_path"), F.col("chunk_id") + 1, F.col("chunk_id") + 3).alias("location"))


SQL_PROMPT = f"""WITH {SQL_EVIDENCE}, t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM ev WHERE trim(text) <> ''),
c AS (SELECT *, CASE WHEN length(t) > 1200 THEN regexp_replace(left(t, 1199), '\\s+$', '') || '…' ELSE t END AS cut, row_number() OVER (PARTITION BY request ORDER BY p) AS n FROM t),
pb AS (SELECT request, string_agg('P [' || n || ']' || chr(10) || 'place: ' || doc_id || '.md:1-2' || chr(10) || 'file: ' || source || '/' || doc_id || '.md' || chr(10) || 'document: ' || source || chr(10) || 'heading: ' || source || chr(10) || 'score: ' || printf('%.4f', score) || chr(10) || cut, chr(10) || chr(10) ORDER BY n) AS blocks,
              string_agg('[' || n || '] ' || doc_id || '.md:1-2 | ' || source, chr(10) ORDER BY n) AS listed FROM c WHERE n <= 6 GROUP BY request)
SELECT b.item_id AS request, md5(CASE WHEN reason IS NOT NULL THEN '' ELSE concat_ws(chr(10) || chr(10), 'Only what is below counts.', 'Q ' || regexp_replace(b.text, '^\\s+|\\s+$', '', 'g'), 'E', coalesce(blocks, 'no E'), 'R1', 'R2', coalesce(listed, 'no S'), 'Z') END) AS h, reason IS NOT NULL AS empty
FROM benchmark b JOIN ab ON ab.request = item_id LEFT JOIN pb ON pb.request = item_id"""


@query(SQL_PROMPT)
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in a wording of their own, with scores."""
    e = evidence(spark, sf_dir).withColumns({"start_line": F.lit(1), "end_line": F.lit(2)})
    r = asked(spark, sf_dir).withColumnRenamed("query", "question")
    own = answering.Wording("Only what is below counts.", "Q ", "E", "no E", ("R1", "R2"), "no S", "Z", "P")
    p = answering.prompts(r, e, guardrail.abstain(r, guardrail.evidence_summary(e)), wording=own)
    return p.select("request", F.md5("prompt").alias("h"), (F.col("prompt") == "").alias("empty"))


@query("""WITH e AS (SELECT * FROM (VALUES (0, 'x,y', 'y'), (1, '', ''), (2, 'a b', 'a b')) t(form, cited, allowed))
SELECT doc_id, concat_ws(',', nullif(cited, ''), 'd' || doc_id) AS cited, CASE WHEN form = 2 THEN 'a b,d' || doc_id ELSE concat_ws(',', nullif(allowed, ''), 'd' || doc_id) END AS allowed FROM documents JOIN e ON form = doc_id % 3""")
def cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer of one of three forms that also cites the document itself; offered are some ids and it, or nothing."""
    d = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    answer = F.concat(form_of("doc_id", ["a [x] b [ x ] c [y] []", "none", "[[a b]]"]), F.lit(" ["), own, F.lit("]"))
    used = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("y"), F.lit("z"), own)).when(F.col("doc_id") % 3 == 1, F.array(F.lit("q"), own)).otherwise(F.array().cast("array<string>"))
    c = answering.cited_ids(answer)
    return d.select("doc_id", F.array_join(c, ",").alias("cited"), F.array_join(answering.allowed_ids(c, used), ",").alias("allowed"))


@query(f"""WITH {SQL_BM25},
an AS (SELECT request, q.query AS answer, d.text FROM lex JOIN q USING (request) JOIN d USING (doc_id) WHERE rank = 1),
se AS (SELECT request, unnest(string_split_regex(answer, '[。！？!?.]+\\s*|\\n+')) AS s FROM an),
wd AS (SELECT request, list_transform(regexp_extract_all(s, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'), lambda x: lower(x)) AS w FROM se),
gr AS (SELECT DISTINCT request, regexp_replace(array_to_string(w[i:i + 7], ''), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS g FROM (SELECT request, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM wd)),
tx AS (SELECT request, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM an),
cv AS (SELECT request, count(*) AS total, count(*) FILTER (contains(t, g)) AS m FROM gr JOIN tx USING (request) WHERE g <> '' GROUP BY request)
SELECT request, round(coalesce(m / total, 0), 4) AS coverage, coalesce(m / total, 0) < 0.5 AS unverified FROM an LEFT JOIN cv USING (request)""")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage is an answer that cites the first lexical hit."""
    top = lexical_hits(spark, sf_dir).filter("rank = 1").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    t = top.select("request", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    a = asked(spark, sf_dir).join(t.select("request", "chunk_id"), "request").select("request", F.concat(F.col("query"), F.lit("\n["), "chunk_id", F.lit("]")).alias("answer"), F.array("chunk_id").alias("used"))
    return answering.verify(a, t)[0].select("request", "coverage", "unverified")


def documents_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four lines of a document are a chunk, two chunks a section; the source is the title."""
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("none")).alias("document"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    at = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int"))
    c = lines.select("doc_id", "document", "lines", F.explode(at).alias("chunk_index"))
    part = F.slice("lines", 4 * F.col("chunk_index") + 1, F.lit(4))
    c = c.select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "document", F.col("doc_id").alias("document_id"), F.concat("document", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.array("document").alias("title_path"),
                 F.floor(F.col("chunk_index") / 2).cast("int").alias("section_index"), "chunk_index", F.array_join(part, "\n").alias("content"), (4 * F.col("chunk_index") + 1).alias("start_line"), (4 * F.col("chunk_index") + F.size(part)).alias("end_line"))
    # written without vectors, which would take more room than the texts and follow from them
    return kept(c, "chunks").withColumn("embedding", semantic.hash_embedding(F.col("content")))


@query()
def ask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark asked over all documents, in two queries: how many spellings, hits and passages shown, the decision, the prompt's length, and
    how far an answer that is the passage, citing the first hit, is borne out by what was shown."""
    r = asked(spark, sf_dir).select(F.col("request").cast("string").alias("request"), F.col("query").alias("question"), F.array("query", F.substring("query", 1, 60)).alias("queries"))
    a = asking.ask(r, documents_in_chunks(spark, sf_dir))
    first = a.hits.filter("place = 1").select("request", F.concat(F.lit(" ["), "chunk_id", F.lit("]")).alias("cite"))
    answers = r.join(first, "request", "left").select("request", F.concat("question", F.coalesce("cite", F.lit(""))).alias("answer"))
    n = lambda df, name: df.groupBy("request").agg(F.count("*").alias(name))
    out = r.select("request").join(n(a.queries, "queries"), "request", "left").join(n(a.hits, "hits"), "request", "left").join(a.decisions.select("request", "abstained", "reason"), "request").join(a.prompts, "request").join(a.checked(answers), "request", "left")
    return out.select("request", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("hits", F.lit(0)).alias("hits"), "abstained", "reason", F.length("prompt").alias("prompt_chars"), "coverage", "unverified")
