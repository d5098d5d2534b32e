"""Documents to training shards: the stages in order, each over all that the one before it kept.

Every stage but the last returns the columns it got, whatever they are called, with their values; repeated rows are rows of their own, except where a stage
says otherwise; an empty table stays empty; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontamination import decontaminated
from quillspark.llm.mixing import mixed
from quillspark.llm.order_minhash import deduplicated
from quillspark.llm.sharding import shard
from quillspark.llm.text import read_table, written
from quillspark.llm.toxicity import accepted, fit, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject. A null or empty text has the score of the labels' prior; equal texts have equal scores."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return accepted(docs, fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, of rows that repeat it one. Null and empty texts are no copies of each other
    and stay."""
    return deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark. Null and empty texts hold none; with an empty benchmark all stay."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"), exact_short=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source close to its target share of words; documents taken twice come twice. A null source is a source, the last; documents without words
    count for nothing and come once. Of rows that are equal in every column as many are taken as the budget asks for."""
    return mixed(docs)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of every document, in columns that replace those of the same names. A null text has 0 bytes; equal rows that no hash bit parts go to
    numbered parts."""
    return shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: The first stage scores with a trained model, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
