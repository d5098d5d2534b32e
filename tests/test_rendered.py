"""Documents that are rendered by the same rule in Spark and in SQL, with texts of every kind of white space."""

import pytest

from quillspark.plans.catalogue import ORACLES, QUERIES

from .compare import assert_same

TEXTS = [None, "", " ", "\n\t ", "a", " a \r\n b\x0c", "a.", ".", "a\x0b", "a\x0bb", "\xa0", "a\xa0", "a\xa0b", "\u3000a\u3000b \u2003", "a\u2028b", "\u2028", "a \u2028", "a\x85", "\x85 ", "a\x1c", "\ufeffa", "# a\n```", "a |\n|---|\n| b |", "x\n\nend", "\xe9a\u3002 "]


@pytest.mark.parametrize("name", ["document_front_matter", "document_sections", "document_source_rules", "document_tables", "document_tokens"])
def test_white_space(spark, tmp_path, name):
    import duckdb

    rows = [(i, t, [None, "en"][i % 2], [None, "src1", "src 2"][i % 3], [None, 3][i % 2]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
