import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import language as lg

WORDS = {"en": "the of and that with water house thing which", "de": "der die und nicht wasser haus schule über straße", "fr": "le la et que dans maison école être où"}


def labelled(spark):
    return spark.createDataFrame([(f"{t} {' '.join(reversed(t.split()))}", k) for k, t in WORDS.items() for _ in range(5)] + [(None, "en"), ("x", None)], "text string, lang string")


def page(lang, text):
    return f'<!DOCTYPE html><html{f" lang={chr(34)}{lang}{chr(34)}" if lang else ""}><head><script>var der="die und"</script></head><body><!-- le la --><p>{text}&nbsp;</p></body></html>'


def test_evidence_is_fused(spark):
    rows = [(i, f"https://a{i % 3}.example.com/x/{i}", page("de", WORDS["de"])) for i in range(20)] + [(100, "https://a1.example.com/empty", "<p></p>"), (101, "https://b.example.org/", page(None, WORDS["fr"])), (102, None, None), (103, "https://c.org/", page("de", WORDS["en"] * 20)), (101, "https://b.example.org/", page(None, WORDS["fr"]))]
    got = {r["page_id"]: r for r in lg.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), lg.fit(labelled(spark))).collect()}
    assert got[0]["lang"] == "de" and got[0]["declared"] == "de"
    assert got[100]["lang"] == "de"  # its host speaks for it
    assert got[101]["lang"] == "fr" and got[101]["declared"] is None
    assert got[103]["lang"] == "en" and got[103]["declared"] == "de"  # a wrong declaration
    assert got[102]["lang"] in WORDS and 0 < got[102]["probability"] <= 1
    assert abs(sum(got[0]["posterior"].values()) - 1) < 1e-9


def test_visible_text():
    assert lg.visible('<p>a&amp;b</p><script>x</script><style>y</style><!-- z -->c').split() == ["a&b", "c"]
    assert lg.declared('<html class="x" lang=EN-us>') == "en" and lg.declared(None) == "" and lg.declared("<p lang='fr'>") == ""


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>x</p>")], "page_id long, url string, html string")
    model = lg.fit(labelled(spark))
    assert lg.identify(pages.limit(0), model).count() == 0
    assert lg.identify(pages, lg.fit(labelled(spark).limit(0))).first()["lang"] is None


def test_every_language_has_its_share(spark):
    many = [(f"{WORDS['en']} {i}", "en") for i in range(300)] + [(f"{WORDS['de']} copies", "DE" if i % 2 else "de") for i in range(300)] + [(WORDS["fr"], "fr")]
    texts = spark.createDataFrame(many, "text string, lang string")
    got = lg.picked(texts, "text", "lang", 20).collect()
    assert sorted(r["lang"] for r in got) == ["de", *["en"] * 20, "fr"] and len({r["text"] for r in got}) == 22
    first = texts.selectExpr("text", "xxhash64(text, lang) AS r").filter("lang = 'en'").orderBy("r").limit(20)
    assert {r["text"] for r in got if r["lang"] == "en"} == {r["text"] for r in first.collect()}
    assert lg.fit(texts, sample=3).languages == ["de", "en", "fr"]
    assert lg.picked(texts, "text", "lang", 3).count() == 5


OLD_HIDDEN = re.compile(r"(?ias)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
OLD_DECLARED = re.compile(r"""(?ias)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,3})\b""")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<!--", "-->", "<script", "</script", "</SCRIPT >", "<style>", "</style>", "<html", " lang", "=", '"', "'", "de", "fr", " ", "x", "<p>", "&amp;", "é", "!", "--", "<template ", "</template>"]), max_size=25).map("".join))
def test_scanners_are_the_regular_expressions(page):
    assert lg.visible(page) == html.unescape(OLD_HIDDEN.sub(" ", page))
    m = OLD_DECLARED.search(page)
    assert lg.declared(page) == (m[1].lower() if m else "")


@pytest.mark.parametrize("part", ["<script ", "<html ", "<", "<!--", "<html lang=", " lang = ", "<template>", "</script ", "<html lang=    ", "<html\tlang "])
def test_scanners_are_linear(part):
    page, began = part * 200_000, time.process_time()
    lg.visible(page), lg.declared(page), lg.declared("<html lang=" + " " * 1_000_000)
    assert time.process_time() - began < 10


def test_held_out_accuracy(spark, sf):
    """Labelled documents that the letter models haven't seen, as pages of unknown hosts."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) > 0 AND lang IS NOT NULL")
    model = lg.fit(docs.filter("doc_id % 5 <> 0"))
    held = docs.filter("doc_id % 5 = 0")
    got = lg.identify(held.select("doc_id", F.lit(None).cast("string").alias("url"), F.col("text").alias("html")), model, key="doc_id").join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    right, n = got.agg(F.count(F.when(F.col("lang") == F.col("truth"), 1)), F.count("*")).first()
    print(f"held-out accuracy: {right} of {n}")
    assert right / n > 0.97, right / n


def test_clashing_columns_and_long_pages(spark):
    long = page("fr", (WORDS["fr"] + " ") * 50_000)
    rows = spark.createDataFrame([(1, "https://a.fr/", long, "mine", 0.5, "mine")], "page_id long, url string, html string, lang string, probability double, host string")
    got = lg.identify(rows, lg.fit(labelled(spark))).first()
    assert got["lang"] == "fr" and got["text_lang"] == "fr"
