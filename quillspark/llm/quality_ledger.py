"""Quality rules as a bitmask ledger (DataFrame functions only).

`ledger` evaluates every rule once and stores measurements and one failure bit per rule. Policies are versioned
masks over these bits, so that a new policy, or an ablation, never reads a text again.

Defined results: a null or empty text has no words and fails the minimum-words rule; repeated rows each get their own
ledger row; a column of the input with the name of a ledger column is replaced; an empty table gives an empty ledger.
Trigrams are compared through 64-bit hashes; 33 bits select candidates, all 64 decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANKS, WORD, let, text_of, words_array

POSITION_BITS = 31
POSITION_MASK = (1 << POSITION_BITS) - 1


def measures(text: Column) -> dict[str, Column]:
    """The measurements over one text column that is never null."""
    words = words_array(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, repeated_words).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """Words inside the 3-word windows that occur twice or more in the array, the first occurrence included.

    One sort of primitive longs (33 hash bits, then the position) brings equal windows together; the few windows whose
    neighbour agrees on 33 bits are compared on the full hash. O(n log n) for texts of any length.
    """
    hash_at = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    windows = F.when(F.size(words) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(words) - 3))
    packed = F.sort_array(F.transform(windows, lambda i: F.shiftleft(hash_at(i), POSITION_BITS).bitwiseOR(i.cast("long"))))
    group = lambda x: F.shiftright(x, POSITION_BITS)
    near = let(packed, lambda s: F.filter(s, lambda x, i: group(x).eqNullSafe(group(F.get(s, i - 1))) | group(x).eqNullSafe(group(F.get(s, i + 1)))))
    exact = F.sort_array(F.transform(near, lambda x: let(x.bitwiseAND(F.lit(POSITION_MASK)).cast("int"), lambda p: F.struct(hash_at(p).alias("h"), p.alias("p")))))
    same = lambda s, x, i: x["h"].eqNullSafe(F.get(s, i)["h"])
    starts = F.sort_array(F.transform(let(exact, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))), lambda x: x["p"]))
    return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))


@dataclass(frozen=True)
class Rule:
    """fails: a condition on the measurement columns. Its bit is its place in the rule list."""

    name: str
    fails: str


#: Version 1 of the rules. Ratios are compared as products, so that integers decide. Append only: the order is the bits' meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)

#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_trigrams"),
    "v1": tuple(r.name for r in RULES),
}


def mask(policy: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[name] for name in dict.fromkeys(policy))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs without its text, with the measurements and fail_bits."""
    if len(rules) > 63:
        raise ValueError("a ledger has at most 63 rules")
    own = measures(F.col("_text"))
    keep = [c for c in docs.columns if c != text and c.lower() not in {*own, "fail_bits", "_text"}]
    measured = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text}`").alias("_text")).select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in own.items()])
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def kept(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy], rules)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that fail it alone, and rows kept without it.

    One aggregation to distinct bit patterns (at most 2^rules, in practice a few) from which all ablations follow.
    """
    full = mask(POLICIES[policy], rules)
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = [(i, r.name) for i, r in enumerate(rules) if full >> i & 1]
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(f"{k}{i}") for i, _ in names for k, c in (
        ("fail", F.col("fail_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0),
        ("alone", F.col("fail_bits").bitwiseAND(F.lit(full).cast("long")) == (1 << i)),
        ("left", F.col("fail_bits").bitwiseAND(F.lit(full & ~(1 << i)).cast("long")) == 0),
    )]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"fail{i}").alias("n_failed"), F.col(f"alone{i}").alias("n_failed_alone"), F.col(f"left{i}").alias("n_kept_without")) for i, name in names])
    return patterns.agg(*sums).select(F.inline(rows))


def op3_quality_ledger(spark, sf_dir: str) -> DataFrame:
    """Every document's ledger row with the base verdict and policy v1."""
    from .text import read_table

    out = ledger(read_table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept("v1")).alias("kept"), "n_lines", "fail_bits")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
m AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM w),
tri AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM m)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS k FROM tri) WHERE k > 1) GROUP BY r),
v AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects over all documents, alone and with the others, from the ledger's bits."""
    from .text import read_table

    return ablation(ledger(read_table(spark, sf_dir, "documents")), "v1")


ABLATION_SQL = f"""
WITH l AS ({OP3_SQL}), r AS (SELECT unnest(['few_words', 'repeated_trigrams', 'many_symbols', 'duplicate_lines', 'short_words', 'long_words']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, (count(*) FILTER (fail_bits & bit <> 0))::BIGINT AS n_failed, (count(*) FILTER (fail_bits = bit))::BIGINT AS n_failed_alone, (count(*) FILTER (fail_bits & (63 - bit) = 0))::BIGINT AS n_kept_without FROM r LEFT JOIN l ON true GROUP BY rule
"""
