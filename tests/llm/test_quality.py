import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import quality_ledger as q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def measured(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in q.ledger(rows).collect()}


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n\n x y z", "é ñ ü é ñ ü", "## $$ a|b", "a\x0bb\x0cc\rd", "same\nsame\nsame", " not a blank ", "w " * 3000, "l o n g " * 5000, "𝒳 𝒴 𝒵 𝒳 𝒴 𝒵"]


def test_measures(spark):
    got = measured(spark, TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), min_size=1, max_size=20))
def test_measures_of_random_texts(spark, texts):
    got = measured(spark, texts)
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (4,), (8,), (1,)], "fail_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in q.ablation(rows, "base").collect()}
    assert got == {"few_words": (3, 2, 5), "repeated_trigrams": (1, 0, 3)}
    assert rows.filter(q.kept("v1")).count() == 1 and rows.filter(q.kept("base")).count() == 3
    assert q.ablation(rows.limit(0), "base").first()["n_failed"] == 0


def test_empty_clashing_repeated(spark):
    rows = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9)], "doc_id long, text string, n_words int")
    out = q.ledger(rows)
    assert out.count() == 2 and {r["n_words"] for r in out.collect()} == {2}
    assert q.ledger(rows.limit(0)).count() == 0


def test_clean_text_is_kept(spark):
    words = " ".join(f"word{i % 97}x{i}" for i in range(120))
    assert q.ledger(spark.createDataFrame([(1, words)], "doc_id long, text string")).filter(q.kept("v1")).count() == 1


def test_only_dataframe_functions(spark):
    plan = q.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string").select("doc_id", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
