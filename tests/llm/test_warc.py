import gzip
import os

import pytest
from pyspark.sql import functions as F

from quillspark.llm import warc

PAGES = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, "http://c/", "other"), (4, None, None), (5, "http://d/", ""), (None, "http://e/", "same"), (6, "http://f/\r\nx", "é ü 漢" * 1000), (1, "http://b/", "same")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages(spark), folder)
    assert index.count() == len(PAGES)
    back = warc.read(index, folder)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in back.collect()), key=repr)
    same, nothing = warc.base32_sha1(b"same"), warc.base32_sha1(b"")
    assert [g for g in got if g[4] == same] == sorted([(1, "response", None, 4, same), (1, "revisit", 1, 4, same), (3, "revisit", 1, 4, same), (None, "revisit", 1, 4, same)], key=repr)
    assert [g for g in got if g[4] == nothing] == [(4, "response", None, 0, nothing), (5, "revisit", 4, 0, nothing)]
    text = back.filter("page_id = 6").first()
    assert bytes(text["payload"]).decode() == "é ü 漢" * 1000 and text["url"] == "http://f/%0D%0Ax"


def test_selected_records_by_offset(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    many = spark.range(500).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    index = warc.write(many.repartition(3), folder)
    some = warc.read(index.filter("page_id % 7 = 0"), folder)
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in some.collect()) == [(i, f"page {i}") for i in range(0, 500, 7)]
    for name in os.listdir(tmp_path / "w" / "archives"):  # each member stands alone, and so does the whole file
        assert gzip.decompress((tmp_path / "w" / "archives" / name).read_bytes()).startswith(b"WARC/1.1\r\n")


def test_ranges():
    rows = [{"file": f, "offset": o, "length": 10} for f, o in (("a", 0), ("a", 10), ("a", 200), ("b", 210), ("b", 215))]
    assert [len(r) for r in warc.ranges(rows, gap=5, span=100)] == [2, 1, 2]
    assert [len(r) for r in warc.ranges(rows[:2], gap=5, span=15)] == [1, 1]


def test_smaller_payloads_are_never_revisits(spark, tmp_path):
    index = warc.write(pages(spark), f"file://{tmp_path}/w", smallest=5)
    assert index.filter("record_type = 'revisit'").count() == 0


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages(spark).filter("page_id = 2").coalesce(1), folder)
    name = next(n for n in os.listdir(tmp_path / "w" / "archives"))
    record = warc.record(2, "http://c/", b"tampered", warc.base32_sha1(b"other"), None)
    (tmp_path / "w" / "archives" / name).write_bytes(record)
    with pytest.raises(Exception, match="digest"):
        warc.read(index.withColumn("length", F.lit(len(record)).cast("long")), folder).collect()


def test_stray_files_are_swept(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages(spark), folder)
    (tmp_path / "w" / "archives" / "part-lost.warc.gz").write_bytes(b"x")
    assert warc.sweep(folder, index) == 1 and warc.read(index, folder).count() == len(PAGES)


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages(spark).limit(0), folder)
    assert index.count() == 0 and warc.read(index, folder).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "int", "string"])
def test_ids_long_payloads_and_other_columns(spark, tmp_path, kind):
    folder = f"file://{tmp_path}/w"
    rows = spark.createDataFrame([(1, "http://a/", "x" * 6_000_000, "mine", 1), (2, "http://b/", "x" * 6_000_000, "mine", 1), (3, "http://c/", "y", None, None)], "page_id int, url string, html string, payload_digest string, offset long")
    back = warc.read(warc.write(rows.withColumn("page_id", F.col("page_id").cast(kind)), folder), folder)
    got = {str(r["page_id"]): (r["record_type"], r["payload_bytes"]) for r in back.select("page_id", "record_type", "payload_bytes").collect()}
    assert got == {"1": ("response", 6_000_000), "2": ("revisit", 6_000_000), "3": ("response", 1)} and dict(back.dtypes)["page_id"] == kind
    with pytest.raises(TypeError):
        warc.write(rows.withColumn("page_id", F.col("page_id").cast("double")), folder)
