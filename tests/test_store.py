"""Schemas of stored versions: drift is seen, and tables are rebuilt together."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources.store import Store

OLD = {"documents": "doc_id bigint, title string", "chunks": "chunk_id string, doc_id bigint, n int"}
NEW = {"documents": "doc_id bigint, title string, lang string", "chunks": "chunk_id string, doc_id bigint, n bigint"}


def tables(spark, n, new):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("title"), *[F.lit("en").alias("lang")] * new)
    c = spark.range(2 * n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.floor(F.col("id") / 2).alias("doc_id"), F.col("id").cast("bigint" if new else "int").alias("n"))
    return {"documents": d, "chunks": c}


def test_drift_has_all_tables_rebuilt_at_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert set(store.drift(OLD)) == {"documents", "chunks"} and store.schemas() == {}
    first, built = store.ensured(OLD, lambda: tables(spark, 3, 0))
    assert built and store.drift(OLD) == {} and store.ensured(OLD, lambda: 1 / 0) == (first, False)
    assert set(store.drift(NEW)) == {"documents", "chunks"}
    assert store.drift(NEW)["chunks"] == ({"chunk_id": "string", "doc_id": "bigint", "n": "int"}, {"chunk_id": "string", "doc_id": "bigint", "n": "bigint"})
    reader = store.read("documents"), store.read("chunks")

    def build():
        assert store.version() == first and store.read("chunks").schema["n"].dataType.simpleString() == "int"  # the old version, while the new one is made
        return tables(spark, 5, 1)

    second, built = store.ensured(NEW, build)
    assert built and second != first and store.drift(NEW) == {}
    assert (reader[0].count(), reader[1].count()) == (3, 6) and (store.read("documents").count(), store.read("chunks").count()) == (5, 10)
    assert set(store.drift(OLD)) == {"documents", "chunks"}


def test_what_fails_leaves_the_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first, _ = store.ensured(OLD, lambda: tables(spark, 3, 0))
    with pytest.raises(ValueError, match="not as expected"):
        store.ensured(NEW, lambda: tables(spark, 3, 0))
    with pytest.raises(ValueError, match="not as expected"):
        store.ensured(NEW, lambda: {"documents": tables(spark, 3, 1)["documents"]})
    with pytest.raises(ZeroDivisionError):
        store.ensured(NEW, lambda: 1 / 0)

    def overtaken():
        store.write(tables(spark, 4, 0), expect=first)
        return tables(spark, 5, 1)

    with pytest.raises(RuntimeError, match="another writer"):
        store.ensured(NEW, overtaken)
    assert store.read("documents").count() == 4 and set(store.drift(NEW)) == {"documents", "chunks"}


def test_columns_in_another_order_or_case_are_drift(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.ensured(OLD, lambda: tables(spark, 3, 0))
    for other in ("title string, doc_id bigint", "doc_id bigint, Title string", "doc_id bigint"):
        assert set(store.drift({"documents": other})) == {"documents"}
    assert store.drift({"documents": OLD["documents"]}) == {} and set(store.drift({"sections": "id int"})) == {"sections"}
