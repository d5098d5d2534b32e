"""The registered queries against their SQL, and the pipeline's stages."""

import pytest

from quillspark.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, connection
from .test_near import brute_classes, corpus


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert_same(df, connection(sf), ORACLES[name])
    else:
        assert df.count() >= 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n[2:3].isdigit()} == set(range(1, 14))


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] <= n[1] and n[3] <= n[2] and n[5] == n[4]
    assert cp.run(spark, sf).count() == n[5]


def test_pipeline_takes_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "w " * 20_000, "en", "src0", 1)], docs.schema))
    for name, stage in cp.STAGES:
        odd = stage(spark, odd, sf)
        assert odd.count() > 0
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_stages_against_brute_force(spark, sf):
    """Near copies by all pairs, a planted passage among texts that share nothing with the benchmark, targets by filling up, shards within their limit."""
    import corpus_pipeline as cp

    stages, texts = dict(cp.STAGES), corpus(7, 40)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = stages["near_dedup"](spark, docs, sf)
    assert ids(kept) == sorted(set(brute_classes(texts)))
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    planted = docs.unionByName(spark.createDataFrame([(1000, f"before it {passage} after it", "en", "s0", 1)], docs.schema))
    assert ids(stages["decontamination"](spark, planted, sf)) == list(range(len(texts)))
    sizes = {s: sum(len(t.split()) for i, t in enumerate(texts) if i % 4 == int(s[1])) for s in ("s0", "s1", "s2", "s3")}
    weights, target, free = dict(zip(sorted(sizes), (5, 2, 1, 5))), {}, set(sizes)
    while free:  # sources above three times their size stay there, the rest shares what is left
        left = sum(sizes.values()) - sum(target.values())
        goal = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else goal
        free = free - over if over else set()
    got = dict.fromkeys(sizes, 0)
    for r in stages["mixing"](spark, docs, sf).collect():
        got[r["source"]] += len(r["text"].split())
    longest = max(len(t.split()) for t in texts)
    assert all(abs(got[s] - target[s]) <= longest for s in sizes), (got, target)
    shards = stages["sharding"](spark, docs, sf).groupBy("shard").sum("bytes").collect()
    assert sum(r[1] for r in shards) == sum(len(t.encode()) for t in texts) and all(r[1] <= 64 << 20 for r in shards)
