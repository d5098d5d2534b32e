"""Operators on inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import answering, cleaning, guardrail, ranking, sections, state, understanding
from quillspark.operators import traces as tr
from quillspark.sources import jsonl, markdown, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Few-Shot 是 什么", ["few", "shot", "是", "什么"]), ("混合检索", ["混合检索", "混合", "合检", "检索"]), ("", []), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.lit(text).cast("string"))) == want


def test_text_functions(spark):
    assert one(spark, tx.truncated(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, tx.file_stem(F.lit("a\\b/c.d.md"))) == "c.d"
    assert one(spark, tx.path_parts(F.lit("/a/b/c/d/e.md"), 2)) == ["d", "e.md"]
    assert one(spark, tx.dedupe_fold(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")))) == ["A", "b"]
    assert one(spark, F.lit("x/y.md").rlike(tx.glob_pattern("*.md"))) is True
    assert one(spark, tx.language_guess(F.lit("中文 text 中文字字"))) == "zh"


def test_query_understanding(spark):
    rows = [(1, "2PC 和 3PC 有什么区别", ["2PC 和 3PC 有什么区别"]), (2, None, ["如何 安装 Redis"]), (3, "", [])]
    p = understanding.routed(understanding.variants(understanding.profile(spark.createDataFrame(rows, "request int, question string, queries array<string>"))))
    got = {r["request"]: r for r in p.collect()}
    assert got[1]["query_type"] == "comparison" and got[1]["recall_k"] == 24 and got[1]["rerank_k"] == 8 and got[1]["requires_multi_source"]
    assert got[1]["variants"][0] == "2PC 和 3PC 有什么区别" and len(got[1]["variants"]) == 7
    assert any("两阶段提交" in v for v in got[1]["variants"])
    assert got[2]["query_type"] == "procedure" and got[2]["canonical_query"] == "如何 安装 Redis" and "redis" in got[2]["anchor_terms"]
    assert got[3]["variants"] == [] and got[3]["query_type"] == "definition"


def test_alias_groups_from_documents(spark):
    docs = spark.createDataFrame([(["RAG", "rag", "检索增强"],), (["one"],), (["检索增强", "rag"],)], "aliases array<string>")
    assert understanding.alias_groups(docs, base=[]) in ([["rag", "检索增强"]], [["检索增强", "rag"]])


def test_constraints_and_lookup(spark):
    r = spark.createDataFrame([(1, ["程序设计 分类下有没有 Redis"]), (2, ["哪个命令 gdb"]), (3, ["plain"])], "request int, queries array<string>")
    c = {(x["request"], x["kind"]): x["tokens"] for x in understanding.constraints(r).collect()}
    assert "程序设计" in c[(1, "category")]
    i = {x["request"]: x["lookup_terms"] for x in understanding.lookup_intents(r).collect()}
    assert i[3] is None and "gdb" in i[2]


def test_step_order():
    with pytest.raises(ValueError):
        ranking.validated(("rerank", "rerank_candidate_limit"))
    with pytest.raises(ValueError):
        ranking.validated(("top_k_limit", "rerank"))
    assert ranking.validated(ranking.STEPS) == ranking.STEPS


def evidence(spark, rows):
    return spark.createDataFrame(rows, "request int, place int, chunk_id string, document string, content string, score double")


def test_guardrail_reasons(spark):
    long = "x" * 200
    e = evidence(spark, [(1, 1, "a", "d", long, 0.9), (1, 2, "b", "d", long, 0.8), (2, 1, "a", "d", long, 0.1), (3, 1, "a", "d", "short text", 0.9), (3, 2, "b", "d", "short text", 0.9), (4, 1, "a", "d", long, 0.9), (5, 1, "a", "d", " ", 0.9)])
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "request int")
    got = {r["request"]: r["reason"] for r in guardrail.abstain(asked, guardrail.evidence_summary(e)).collect()}
    assert got == {1: None, 2: "top1_score_below_threshold", 3: "evidence_chars_below_threshold", 4: "recall_hits_below_threshold", 5: "top1_score_below_threshold", 6: "top1_score_below_threshold"}


def test_coverage_is_not_stitched(spark):
    e = evidence(spark, [(1, 1, "a", "d1", "redis cluster", 0.9), (1, 2, "b", "d2", "raft paxos", 0.8)])
    docs = guardrail.evidence_terms(e, [F.col("content")])
    r = spark.createDataFrame([(1, ["redis raft cluster paxos"])], "request int, queries array<string>")
    assert guardrail.term_coverage(r, docs).first()["coverage"] == 0.5


def test_comparison_and_decision(spark):
    r = spark.createDataFrame([(1, "redis raft 区别", ["redis raft 区别"])], "request int, question string, queries array<string>")
    p = understanding.profile(r)
    e = evidence(spark, [(1, 1, "a", "d1", "redis " * 50, 0.9), (1, 2, "b", "d1", "redis " * 50, 0.9)])
    d = guardrail.decide(r, p, e, [F.col("content")]).first()
    assert d["abstained"] and d["reason"] in ("query_term_coverage_below_threshold", "comparison_evidence_incomplete")


def test_parent_context(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, 0 if i < 3 else 1, f"t{i}", i * 10, i * 10 + 5) for i in range(6)], "chunk_id string, document_id string, chunk_index int, section_index int, content string, start_line int, end_line int")
    got = answering.parent_context(spark.createDataFrame([(1, "c3"), (2, "c0")], "request int, chunk_id string"), chunks)
    by = {r["request"]: r for r in got.collect()}
    assert by[1]["chunk_ids"] == ["c3", "c4", "c5"] and by[1]["content"] == "t3\n\nt4\n\nt5" and by[1]["start_line"] == 30
    assert by[2]["chunk_ids"] == ["c0", "c1", "c2"]


def test_prompt(spark):
    r = spark.createDataFrame([(1, " 什么? "), (2, "no")], "request int, question string")
    e = spark.createDataFrame([(1, 1, "c", "d", "body", 0.5, "notes/a.md", 3, 7, ["T"])], "request int, place int, chunk_id string, document string, content string, score double, file_path string, start_line int, end_line int, title_path array<string>")
    d = spark.createDataFrame([(1, False), (2, True)], "request int, abstained boolean")
    got = {x["request"]: x["prompt"] for x in answering.prompts(r, e, d).collect()}
    assert got[2] == "" and "place: a.md:3-7" in got[1] and "score: 0.5000" in got[1] and "[1] a.md:3-7 | T" in got[1] and "Question: 什么?" in got[1]


def test_citations(spark):
    text = "混合检索结合了词法与语义检索的优势，效果更好"
    a = spark.createDataFrame([(1, "混合检索结合了词法与语义检索的优势 [notes/rag.md#7]。", ["notes/rag.md#7"]), (2, "a [x] b [x] c", [])], "request int, answer string, used array<string>")
    t = spark.createDataFrame([(1, "notes/rag.md#7", text)], "request int, chunk_id string, text string")
    whole, detail = answering.verify(a, t)
    by = {r["request"]: r for r in whole.collect()}
    assert not by[1]["unverified"] and by[1]["coverage"] == 0.5556 and by[1]["matched_ids"] == ["notes/rag.md#7"]
    assert by[2]["unverified"] and by[2]["coverage"] == 0.0
    assert detail.filter("request = 2").first()["chunk_id"] == "x"


def test_chunks_pack_and_split(spark):
    para = "word " * 30
    docs = spark.createDataFrame([("d", "# T\n\n" + "\n\n".join([para.strip()] * 8) + "\n\n" + "y" * 2000)], "document_id string, text string")
    c = sections.chunks(sections.sections(docs), compat=False).orderBy("chunk_index").collect()
    assert all(len(r["text"]) <= 800 for r in c) and c[0]["text"].startswith("# T\n\nword")
    assert [r["chunk_index"] for r in c] == list(range(len(c)))
    assert len({r["chunk_id"] for r in c}) == len(c)


def test_contextual_text(spark):
    rows = spark.createDataFrame([(" body ", "a/b.md", None, ["S", " "]), ("", "a/b.md", "T", ["S"])], "t string, p string, f string, s array<string>")
    got = [r["x"] for r in rows.select(sections.contextual_text(F.col("t"), F.col("p"), F.col("p"), F.col("f"), F.col("s")).alias("x")).collect()]
    assert got == ["文档标题: b\n文档路径: a/b.md\n章节路径: S\n\nbody", ""]


def test_empty_key_chunks_stay(spark):
    rows = spark.createDataFrame([("d", 0, "a  b"), ("d", 1, "a b "), ("d", 2, " "), ("d", 3, " ")], "d string, i int, text string")
    assert sorted(r["i"] for r in cleaning.exact_dedupe(rows, "d", ["i"]).collect()) == [0, 2, 3]


def test_state(spark):
    schema = "document_id string, file_hash string, mtime_ns long, size long, file_path string"
    a = spark.createDataFrame([("a", "1", 1, 1, "p"), ("b", "1", 1, 1, "p"), ("c", None, 1, 1, "p")], schema)
    b = spark.createDataFrame([("b", "2", 1, 1, "p"), ("c", None, 1, 1, "p"), ("d", "1", 1, 1, "p")], schema)
    got = [(r["document_id"], r["status"]) for r in state.in_order(state.diff(a, b)).collect()]
    assert got == [("b", "modified"), ("c", "unchanged"), ("d", "added"), ("a", "removed")]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# 标题".encode())
    (tmp_path / "sub" / "B.MD").write_bytes(b"bad \xff byte")
    (tmp_path / "sub" / "skip.md").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    got = {r["relative_path"]: r["text"] for r in markdown.scan(spark, [markdown.Source(str(tmp_path), ("*skip*",), "s")]).collect()}
    assert got == {"a.md": "# 标题", "sub/B.MD": "bad � byte"}


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.version() is None
    v = s.write({"docs": spark.range(3)})
    assert s.read("docs").count() == 3
    with pytest.raises(RuntimeError):
        s.write({"docs": spark.range(1)}, expect=None)
    s.write({"docs": spark.range(5)}, expect=v)
    assert s.read("docs").count() == 5 and s.read("docs", v).count() == 3
    with pytest.raises(ValueError):
        store.replaced(spark.range(2), spark.range(2).union(spark.range(1)), ["id"])


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"id": 1}\n\n[2]\nnot json\n{"id": 3}\r\n')
    assert [r["id"] for r in jsonl.objects(spark, str(tmp_path / "x.jsonl"), "id int").collect()] == [1, 3]
    assert [r["line_number"] for r in jsonl.lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_number").collect()] == [1, 3, 4, 5]


def test_request_precedence(spark):
    import json

    rows = [
        {"request_id": "a", "event": "http.request.start", "timestamp": "1776234722000"}, {"request_id": "a", "event": "http.request.end", "timestamp": "1776234722500", "status_code": 503},
        {"request_id": "b", "event": "http.request.start", "timestamp": "1776234722000"}, {"request_id": "b", "span_name": "http.request", "event": "end", "timestamp": "1776234723000", "duration_ms": 7.5},
        {"request_id": "c", "event": "stage.x.end", "duration_ms": 30, "span_id": "1"}, {"request_id": "c", "event": "stage.y.end", "duration_ms": 20, "span_id": "2", "parent_span_id": "1"},
        {"level": "ERROR", "message": "orphan"}]
    r = tr.parse(spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(rows)], "line string, line_number long"))
    got = {x["request_id"]: x for x in tr.requests(r).collect()}
    assert (got["a"]["status"], got["a"]["status_code"], got["a"]["duration_ms"]) == ("failed", 503, 500.0)
    assert (got["b"]["status"], got["b"]["duration_ms"]) == ("ok", 7.5)
    assert got["c"]["status"] == "partial" and got["c"]["stage_count"] == 2
    st = {x["stage"]: x["self_ms"] for x in tr.stage_events(r).collect()}
    assert st == {"stage.x": 10.0, "stage.y": 20.0}
    assert tr.errors(r).filter("request_id IS NULL").first()["message"] == "orphan"


def test_redaction_reaches_nested_values(spark):
    line = '{"question": "a \\"b\\" c", "n": {"question": [1, 2], "k": {"question": "z"}}, "ok": "question"}'
    lines = [line, '{"question": {"a": {"b": "z"}}}', '{"question": [["z"], "]"], "ok": "question"}', '{"question": "' + "z" * 100_000 + '", "ok": 1}', '{"a": [[{"question": "z"}]], "q": "{"}', "[" * 100_000]
    rows = tr.parse(spark.createDataFrame([(x,) for x in lines], "line string"), tr.LogSource(redact_fields=("question",))).collect()
    assert [r["parse_error"] for r in rows] == [None] * 5 + ["invalid JSON"]
    assert rows[0]["raw"]["ok"] == "question" and rows[0]["raw"]["question"] == "[REDACTED]" and '"z"' not in rows[0]["raw"]["n"]
    assert all("z" not in str(r["raw"]) for r in rows[:5]) and rows[3]["raw"]["ok"] == "1"


def test_order_and_partitioning_do_not_matter(spark, sf):
    from quillspark.operators.lexical import bm25_topk

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    q = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS request", "text AS query")
    run = lambda x: sorted((r["request"], r["rank"], r["doc_id"]) for r in bm25_topk(x, q, "doc_id", "request", "query", 5, {"title": 2.5, "content": 1.5}).collect())
    assert run(d) == run(d.repartition(5, "doc_id").orderBy(F.rand(1)))


def test_models_are_plug_ins(spark):
    from quillspark.operators import semantic

    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in semantic.embedded(rows, "t", "id", lambda: lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    hits = spark.createDataFrame([(1, "a", 1, "q", "xx", 0.1), (1, "b", 2, "q", "xxxx", 0.2)], "request int, chunk_id string, place int, query string, content string, score double")
    out = ranking.rerank_model(hits, lambda: lambda pairs: [len(c) for _, c in pairs]).orderBy("place").collect()
    assert [r["chunk_id"] for r in out] == ["b", "a"] and 0.8 < out[1]["score"] < out[0]["score"] < 1


def test_metadata_relaxes_the_cascade(spark):
    """Little text that matches the constraints by both searches: one chunk, a cluster in one document, several documents; each against a case that just misses it."""
    both, lexical = ["lexical:0", "semantic:0"], ["lexical:0"]
    long, short = "x" * 60, "y" * 20
    cases = {
        1: [("d1", long, 0.5, True, 1.0, both, ["p" * 100])],  # one strong chunk with what its metadata says
        2: [("d1", long, 0.5, True, 1.0, lexical, ["p" * 100])],  # found by one search only
        3: [("d1", long, 0.5, True, 0.5, both, ["p" * 100])],  # constraints half covered
        4: [("d1", short, 0.5, True, 1.0, both, ["p" * 60])] * 3,  # a cluster: 60 letters and 60 of metadata, counted once
        5: [(f"d{i}", short, 0.5, True, 1.0, both, ["p" * 60]) for i in range(3)],  # the same in several documents needs 150
        6: [(f"d{i}", short, 0.5, True, 1.0, lexical, ["p" * 95]) for i in range(3)],
        7: [("d1", "tiny", 0.5, True, 1.0, both, ["p" * 150])] * 2,  # short chunks count where their document has two
        8: [("d1", "tiny", 0.5, False, None, both, ["p" * 150])] * 2,
        9: [],
    }
    rows = [(r, i + 1, f"{r}-{i}", *x) for r, xs in cases.items() for i, x in enumerate(xs)]
    e = spark.createDataFrame(rows, "request int, place int, chunk_id string, document string, content string, score double, constraint_passed boolean, constraint_coverage double, source_hits array<string>, support_values array<string>")
    requests = spark.createDataFrame([(r,) for r in cases], "request int")
    got = {r["request"]: (r["reason"], r["hit_count"]) for r in guardrail.abstain(requests, guardrail.evidence_summary(e)).collect()}
    few, chars = "recall_hits_below_threshold", "evidence_chars_below_threshold"
    assert got == {1: (None, 2), 2: (few, 1), 3: (few, 1), 4: (None, 3), 5: (chars, 3), 6: (None, 3), 7: (None, 2), 8: (few, 0), 9: ("top1_score_below_threshold", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_against_brute_force(spark, seed):
    """Sections of random paragraphs, fences with blank lines in them, and words longer than a chunk."""
    rng, size, overlap = random.Random(seed), 60, 10

    def paragraph():
        kind = rng.random()
        if kind < 0.15:
            return ["```", "code", "", "more code", "```"]
        if kind < 0.3:
            return ["z" * rng.randint(55, 200)]
        return [" ".join(rng.choice(["ab", "cde", "f", "ghij", "混合"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 2))]

    def brute(paragraphs, first):
        """(text, start, end) of every chunk. paragraphs: (lines, blank lines after them)."""
        placed, line = [], first
        for lines, gap in paragraphs:
            placed.append(("\n".join(lines), line, line + len(lines) - 1))
            line += len(lines) + gap
        out, held = [], []
        flush = lambda: out.append(("\n\n".join(x[0] for x in held), held[0][1], held[-1][2])) if held else None
        for text, a, b in placed:
            if len(text) > size:
                flush()
                held = []
                step = size - overlap
                starts = [k for k in range(0, len(text), step) if k == 0 or k - step + size < len(text)]
                out += [(text[k : k + size], a, b) for k in starts]
            else:
                if held and len("\n\n".join([x[0] for x in held] + [text])) > size:
                    flush()
                    held = []
                held = [*held, (text, a, b)]
        flush()
        return out

    made = [[(paragraph(), rng.randint(1, 3)) for _ in range(rng.randint(1, 12))] for _ in range(40)]
    rows = [(i, 0, ["t"], 5, "\n".join(line for lines, gap in ps for line in [*lines, *[""] * gap])) for i, ps in enumerate(made)]
    secs = spark.createDataFrame(rows, "document_id int, section_index int, title_path array<string>, start_line int, text string")
    got = {}
    for r in sections.chunks(secs, size=size, overlap=overlap).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["text"], r["start_line"], r["end_line"]))
        assert r["chunk_index"] == len(got[r["document_id"]]) - 1
    assert got == {i: brute(ps, 5) for i, ps in enumerate(made)}
