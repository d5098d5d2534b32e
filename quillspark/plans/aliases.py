"""Alias groups of all documents, looked for in the questions of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.frames import computed, spread, table
from quillspark.operators import alias_tables

from .registry import query

SQL_ALIASES = r"""
w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]{5,}') AS ws FROM documents),
g0 AS (SELECT doc_id, list_filter([ws[1], list_filter(ws, lambda x: x <> ws[1])[1], lower(source)], lambda x: x IS NOT NULL AND x <> '') AS m FROM w),
g1 AS (SELECT doc_id, CASE WHEN len(m) = 3 AND m[3] IN (m[1], m[2]) THEN m[1:2] WHEN len(m) = 2 AND m[1] = m[2] THEN m[1:1] ELSE m END AS m FROM g0),
g AS (SELECT min(doc_id) AS doc_id, min_by(m, doc_id) AS m FROM g1 WHERE len(m) >= 2 GROUP BY list_sort(m)),
t AS (SELECT conv_id, turn, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, t, doc_id, m, list_filter(m, lambda a: contains(t, a))[1] AS hit FROM t, g WHERE len(list_filter(m, lambda a: contains(t, a))) > 0),
v0 AS (SELECT conv_id, turn, t, doc_id, hit, unnest(m) AS a, unnest(range(len(m))) AS pos FROM h),
v1 AS (SELECT conv_id, turn, t, a, hit, doc_id, pos, substr(t, 1, instr(t, hit) - 1) || a || substr(t, instr(t, hit) + length(hit)) AS v FROM v0),
v2 AS (SELECT conv_id, turn, v, min((doc_id, pos)) AS o FROM v1 WHERE a <> hit AND v <> t GROUP BY ALL),
v3 AS (SELECT conv_id, turn, v, o, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS k FROM v2),
vs AS (SELECT conv_id, turn, string_agg(v, '|' ORDER BY o) AS variants FROM v3 WHERE k <= 4 GROUP BY ALL),
s0 AS (SELECT conv_id, turn, a, min((doc_id, pos)) AS o FROM v0 GROUP BY ALL),
ss AS (SELECT conv_id, turn, string_agg(a, '|' ORDER BY o) AS subjects FROM s0 GROUP BY ALL)"""


@query(f"WITH {SQL_ALIASES} SELECT conv_id, turn, md5(coalesce(variants, '')) AS variants, md5(coalesce(subjects, '')) AS subjects FROM t LEFT JOIN vs USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn)")
def turn_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document names its first two long words and its source as aliases; every user's turn is looked through for all of them."""
    docs = spread(table(spark, sf_dir, "documents"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    docs = computed(docs, {"_w": words}).select("doc_id", F.array(F.get("_w", F.lit(0)), F.get(F.filter("_w", lambda x: x != F.get("_w", F.lit(0))), F.lit(0)), F.col("source")).alias("aliases"))
    groups = alias_tables.groups_table(docs, "doc_id", base=[])
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), "text")
    out = alias_tables.expanded(turns, "key", "text", groups)
    return out.select("conv_id", "turn", F.md5(F.array_join("alias_variants", "|")).alias("variants"), F.md5(F.array_join("alias_subjects", "|")).alias("subjects"))
