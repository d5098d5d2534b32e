import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.url_automaton import RULES, SEPARATOR, Automaton, GlobRule, judge, symbols


def regex(glob):
    parts = {-1: "(?s:.)*", -2: f"[^{SEPARATOR}]*", -3: f"[^{SEPARATOR}]"}
    return re.compile("".join(parts.get(s) or re.escape(chr(s)) for s in symbols(glob)) + r"\Z", re.DOTALL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab*?" + SEPARATOR, max_size=40), min_size=1, max_size=6), st.lists(st.text(alphabet="abc" + SEPARATOR, max_size=12), min_size=1, max_size=12))
def test_automaton_is_the_regular_expression(globs, urls):
    rules = [GlobRule(g, "block") for g in globs]
    got = Automaton(rules).run(urls)
    want = [[bool(regex(g).match(u)) for g in globs] for u in urls]
    if SEPARATOR in "".join(globs):
        assert got.tolist() == want
    else:  # without a separator in any rule, none is special
        assert all(a == b for g, w, us in zip(got.tolist(), want, urls, strict=True) for a, b in zip(g, w, strict=True) if SEPARATOR not in us)


def test_words_carry():
    glob = "x" * 200
    assert Automaton([GlobRule("ab", "a"), GlobRule(glob, "b"), GlobRule(glob + "y", "c")]).run([glob, glob + "y", "ab", ""]).tolist() == [[False, True, False], [False, False, True], [True, False, False], [False] * 3]


def test_contract(spark):
    urls = ["http://a.Example.COM/en/7x?q", "https://example.com/en/8", "https://x.net/de/1", "https://m.example.net/de/8", "https://example.net/de/9", "http://org/es/", "http://borg/es/", None, "no scheme", "http://h", "http://h?x", "http://b.org/es", "http://c.io/x.com/en/1", "http://cheap-pills.example.io/a", "http://ä.com/en/ü"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(rows, RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5] == ("org", "/es/", "org/es/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9][:2] == ("h", "") and got[10][:2] == ("h", "")
    assert got[11][2:] == (None, "allow") and got[12][2:] == (None, "allow") and got[13][2:] == (None, "block") and got[14][2:] == ("com/en/", "block")


def test_empty_repeated_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "http://a.com/en/", "x"), (1, "http://a.com/en/", "x"), (None, None, None)], "page_id long, url string, rule string")
    assert judge(rows, RULES).count() == 3
    assert judge(rows.limit(0), RULES).count() == 0
    assert judge(rows, []).filter("verdict = 'allow'").count() == 3


def test_many_rules_in_parts(spark, monkeypatch):
    """50,000 rules in several parts, and in lots of few URLs: as a set of hosts says."""
    from quillspark.llm import url_automaton as ua

    rules = [ua.host_rule(f"h{i}.example{i % 7}.com/p{i}", "block" if i % 2 else "allow") for i in range(50_000)]
    assert len(ua.automata(rules)) > 3
    monkeypatch.setattr(ua, "STATE_BYTES", 1 << 20)
    urls = [f"https://x.h{i}.example{i % 7}.com/p{i}/q" for i in range(0, 50_000, 2500)] + ["https://h1.example2.com/p1", "https://other.org/", None, "https://" + "a" * 3000 + ".com/"]
    got = [(r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got[:20] == [(f"h{i}.example{i % 7}.com/p{i}", "allow") for i in range(0, 50_000, 2500)] and got[20:] == [(None, "allow")] * 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab*?" + SEPARATOR, min_size=1, max_size=30), min_size=1, max_size=9), st.lists(st.text(alphabet="abc" + SEPARATOR, max_size=12), min_size=1, max_size=12))
def test_parts_are_the_whole(globs, urls):
    from quillspark.llm import url_automaton as ua

    old = ua.PASS_WORDS, ua.STATE_BYTES
    rules = [GlobRule(g, "block") for g in globs]
    whole = ua.first_fit(ua.automata(rules), urls)
    try:
        ua.PASS_WORDS, ua.STATE_BYTES = 0.5, 16
        assert (ua.first_fit(ua.automata(rules), urls) == whole).all()
    finally:
        ua.PASS_WORDS, ua.STATE_BYTES = old
    hit = Automaton(rules).run(urls)
    assert whole.tolist() == [next((k for k, h in enumerate(row) if h), len(rules)) for row in hit]
