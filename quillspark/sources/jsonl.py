"""JSON-lines readers with line numbers, and small writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.frames import kept


def lines(spark: SparkSession, path: str) -> DataFrame:
    """log_path, line_number (from 1), line of each non-blank line; bytes that are no UTF-8 become U+FFFD.

    Files of any size are read in blocks; lines are counted per block, and one row for each block says with which number it begins.
    """
    block = [F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = kept(spark.read.text(path, lineSep="\n").select(*block, F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("line")), "lines")
    sizes = rows.groupBy("log_path", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    begin = F.coalesce(F.sum("_n").over(Window.partitionBy("log_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(sizes.select("log_path", "_start", "_first", begin.alias("_begin")), ["log_path", "_start"])
    line = F.regexp_replace("line", r"\r$", "")
    return numbered.select("log_path", (F.col("_begin") + F.col("_at") - F.col("_first") + 1).cast("int").alias("line_number"), line.alias("line")).filter(F.trim("line") != "")


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that are JSON objects."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    return text.filter(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("o")).select("o.*")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def suite(spark: SparkSession, path: str) -> DataFrame:
    """A suite file (a list, or an object with entries): name, benchmark_path, gate, thresholds with their defaults."""
    entry = "name string, benchmark_path string, config_path string, base_url string, reindex_mode string, gate boolean, min_recall_at_k double, min_mrr double, min_abstain_accuracy double, max_false_abstain_rate double, max_false_answer_rate double, output_path string, notes string"
    raw = spark.read.text(path, wholetext=True)
    either = F.coalesce(F.from_json("value", f"entries array<struct<{', '.join(x.replace(' ', ':', 1) for x in entry.split(', '))}>>")["entries"], F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in entry.split(', '))}>>"))
    rows = raw.select(F.inline(either))
    return rows.fillna({"gate": True, "min_recall_at_k": 1.0, "min_mrr": 1.0, "min_abstain_accuracy": 1.0, "max_false_abstain_rate": 0.0, "max_false_answer_rate": 0.0})
