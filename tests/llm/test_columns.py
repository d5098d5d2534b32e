"""Columns of any name, and ids of any content, come through."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination as dc
from quillspark.llm.mixing import mixed
from quillspark.llm.order_minhash import deduplicated
from quillspark.llm.sharding import OWN, shard

ODD = ["size", "Source_Size", "target", "taken", "copies", "score", "difference", "_fp", "fp", "_meta", "_h", "_mix_hash", "shard", "part", "entities", "runs", "aside_0", "x", "key", "row", "item", "n", "a b", "c.d", "range", "rank"]


def odd(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")).alias(c) for c in ODD if c.lower() not in [x.lower() for x in docs.columns]])


def as_they_were(df, names=ODD):
    bad = [c for c in names if df.filter(~F.col(f"`{c}`").eqNullSafe(F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")))).limit(1).count()]
    return not bad, bad


def test_stages_hand_columns_through(spark, sf):
    import corpus_pipeline as cp

    docs = odd(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and docs.count() > 0, name
        assert as_they_were(docs) == (True, []), name
    last = cp.STAGES[-1][1](spark, docs, sf)
    assert as_they_were(last, [c for c in ODD if c.lower() not in OWN]) == (True, [])


def test_operators_hand_columns_through(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(12)]
    docs = odd(spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, source string"))
    items = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1)
    for df in (mixed(docs), deduplicated(docs), dc.decontaminated(docs, items)):
        assert df.columns == docs.columns and as_they_were(df) == (True, []) and df.count() > 5
    out = shard(docs, 200)
    assert set(docs.columns) - {"shard", "part"} < set(out.columns) and as_they_were(out, [c for c in ODD if c not in OWN]) == (True, [])


@pytest.mark.parametrize("ids", [["a\r\nb", "", None, "x:y>z", "é %0A", " a ", "<urn:page>"], [5, None, -3, 0]])
def test_ids_of_pages(spark, tmp_path, ids):
    from quillspark.llm import warc

    kind = "string" if isinstance(ids[0], str) else "long"
    pages = spark.createDataFrame([(i, f"http://h/{k}", f"payload {k // 2}") for k, i in enumerate(ids)], f"page_id {kind}, url string, html string")
    back = warc.read(warc.write(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] for r in back), key=repr) == sorted(ids, key=repr)
    assert {r["refers_to"] for r in back if r["record_type"] == "revisit"} <= set(ids)


def test_a_hundred_languages(spark):
    """Planning grows with the languages, not with a power of them."""
    import time

    from quillspark.llm.language import fit, identify

    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": [letters[k % 26] + letters[(k * 7 + j) % 26] + letters[(k // 26 + j) % 26] for j in range(5)] for k in range(100)}
    docs = spark.createDataFrame([(" ".join(w * 4), lang) for lang, w in own.items() for _ in range(3)], "text string, lang string")
    model = fit(docs)
    pages = spark.createDataFrame([(i, f"http://h{i}.{lang}/", f"<p>{' '.join(w * 5)}</p>") for i, (lang, w) in enumerate(own.items())], "page_id long, url string, html string")
    began = time.monotonic()
    got = {r["page_id"]: (r["lang"], r["probability"], len(r["posterior"])) for r in identify(pages, model).collect()}
    assert time.monotonic() - began < 60
    names = list(own)
    assert len(got) == 100 and all(n == 100 for *_, n in got.values()) and sum(got[i][0] == names[i] for i in got) >= 95
