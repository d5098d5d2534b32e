"""Alias groups as tables against the expressions over fixed groups."""

import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import alias_tables, understanding
from quillspark.plans.catalogue import QUERIES


def test_as_the_expressions_give(spark):
    docs = [(1, ["Kafka", " kafka ", "broker"]), (2, ["broker", "KAFKA"]), (3, ["alone"]), (4, None), (5, ["x", "yy", "zzz"]), (6, ["", "  "]), (7, ["中文", "chinese"]), (8, ["queue", "broker", "Log"])]
    df = spark.createDataFrame(docs, "doc_id long, aliases array<string>")
    questions = [(1, "What is a Kafka broker, kafka?"), (2, "2PC and hlc"), (3, ""), (4, None), (5, "两阶段提交协议"), (6, "  the queue  "), (7, "x yy"), (8, "中文 subagent"), (9, "nothing here")]
    q = spark.createDataFrame(questions, "id long, text string")
    table = alias_tables.groups_table(df, "doc_id")
    groups = understanding.alias_groups(df)
    assert sorted(map(sorted, (r["members"] for r in table.collect()))) == sorted(map(sorted, groups))
    ordered = [r["members"] for r in table.orderBy("place").collect()]
    got = {r["id"]: (r["alias_variants"], r["alias_subjects"]) for r in alias_tables.expanded(q, "id", "text", table).collect()}
    want = q.select("id", understanding.alias_variants(F.col("text"), ordered).alias("v"), understanding.alias_subjects(F.col("text"), ordered).alias("s")).collect()
    assert got == {r["id"]: (r["v"], r["s"]) for r in want}
    assert got[1][0] and "broker" in got[1][1] and got[9] == ([], [])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, aliases array<string>")
    q = spark.createDataFrame([(1, "2pc"), (1, "2pc")], "id long, text string")
    assert alias_tables.groups_table(df, "doc_id", base=[]).count() == 0
    out = alias_tables.expanded(q.distinct(), "id", "text", alias_tables.groups_table(df, "doc_id", base=[])).collect()
    assert [(r["alias_variants"], r["alias_subjects"]) for r in out] == [([], [])]
    assert alias_tables.expanded(q.limit(0), "id", "text", alias_tables.groups_table(df, "doc_id")).count() == 0


def test_long_documents_and_common_members(spark, tmp_path):
    """Words of a document are cut out once, not once for each of them, and of a turn's variants only those that count are made."""
    words = lambda i, n: " ".join(f"{a}{b}word" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"[:n]) + f" {i}"
    long = "alpha alpha " + " ".join([words(i, 26) for i in range(60)])
    docs = [(0, long, "S0")] + [(i, "common " + "".join(chr(97 + int(c)) for c in f"{i:05}"), "S1") for i in range(1, 6001)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", " The COMMON thing, alpha "), (2, 0, "user", None), (3, 0, "assistant", "common")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.monotonic()
    got = {r["conv_id"]: (r["variants"], r["subjects"]) for r in QUERIES["turn_aliases"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 40
    md5 = lambda x: hashlib.md5("|".join(x).encode()).hexdigest()
    names = [d[1].split()[1] for d in docs[1:]]
    t = "the common thing, alpha"
    variants = [t.replace("alpha", "aaword"), t.replace("alpha", "s0"), t.replace("common", names[0]), t.replace("common", "s1")]
    assert got == {1: (md5(variants), md5(["alpha", "aaword", "s0", "common", names[0], "s1", *names[1:]])), 2: (md5([]), md5([]))}


def test_questions_times_groups_are_not_shuffled(spark):
    """Every question holds a word of every group: what is shuffled grows with questions and groups, not with their pairs."""
    names = ["".join(chr(97 + int(c)) for c in f"{i:05}") for i in range(4000)]
    df = spark.createDataFrame([(i, ["common", n, f"S{i % 3}"]) for i, n in enumerate(names)], "doc_id long, aliases array<string>")
    q = spark.createDataFrame([(i, f"some common thing {names[i]} {i}") for i in range(600)], "id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    groups = alias_tables.groups_table(df, "doc_id", base=[])
    out = alias_tables.expanded(q, "id", "text", groups).select("id", F.array_join("alias_variants", "|"), F.size("alias_subjects"), F.md5(F.array_join("alias_subjects", "|"))).collect()
    assert written() - before < 8_000_000
    every = list(dict.fromkeys(m for i, n in enumerate(names) for m in ("common", n, f"s{i % 3}")))
    subjects = (len(every), hashlib.md5("|".join(every).encode()).hexdigest())
    variants = lambda t: "|".join([t.replace("common", a) for a in every[1:5]])
    assert sorted(map(tuple, out)) == [(i, variants(f"some common thing {names[i]} {i}"), *subjects) for i in range(600)]


def test_groups_in_slabs(spark, monkeypatch):
    """More groups than one task holds: what a question meets in each slab is put together."""
    docs = [(i, [f"w{i % 7}a", f"w{i % 5}b", f"w{i % 3}c"]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, aliases array<string>")
    q = spark.createDataFrame([(i, i % 2, f"w{i % 7}a and w{i % 3}c" if i % 4 else None) for i in range(30)], "id long, other long, text string")
    table = alias_tables.groups_table(df, "doc_id")
    whole = sorted(map(tuple, alias_tables.expanded(q, "id", "text", table).collect()))
    monkeypatch.setattr(alias_tables, "SLAB", 5)
    assert sorted(map(tuple, alias_tables.expanded(q, "id", "text", table).collect())) == whole
    ordered = [r["members"] for r in table.orderBy("place").collect()]
    assert whole == sorted(map(tuple, q.select("id", "other", "text", understanding.alias_variants(F.col("text"), ordered), understanding.alias_subjects(F.col("text"), ordered)).collect()))


def test_words_inside_texts(monkeypatch):
    """Against the language's own search: words of all lengths that share their beginnings, texts that are cut in pieces and don't run into each other."""
    rng = random.Random(3)
    for _ in range(200):
        some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        letters = rng.choice(["ab", "ab\xe9中", "abcdefgh "])
        words = list(dict.fromkeys(w for w in (some(rng.choice([3, 8, 40, 70])) for _ in range(rng.randint(0, 30))) if w))
        texts = [some(rng.choice([0, 5, 200])) + rng.choice([*words, ""]) + some(9) for _ in range(rng.randint(0, 12))]
        monkeypatch.setattr(alias_tables, "PIECE", rng.choice([7, 64, 1 << 18]))
        text, word = alias_tables.Words(pa.array(words, pa.string())).inside(pa.array(["before", *texts], pa.string()).slice(1))
        assert list(zip(text.tolist(), word.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t]
