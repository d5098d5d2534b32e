"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a lambda inside body uses it many times."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words (runs of anything but ASCII blanks); 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def words_array(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(docs with every column but those in `own` under a name that no operator uses, a function that gives a frame with these columns its old names
    back, without those called like one of `replaced`, whatever their case, and with the columns `more`)."""
    names = {c: c if c in own else f"aside_{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, replaced: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*[F.col(f"`{new}`").alias(old) for old, new in names.items() if old.lower() not in replaced], *more)

    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), back


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: str = "4m") -> None:
    """From now on Arrow batches of this session hold about `limit` bytes at most: Spark's default of 64 MB is held several times over
    by each Python worker and by the JVM beside its heap. A limit that the session has set itself stays."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864", "67108864b", "64m"):
        spark.conf.set(_BATCH, limit)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where the setting is absent, it is set to a folder of
    this application if all runs on one machine (tests); a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/quillspark-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the folder of a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df with its rows numbered from 0 in the order of `by`. Rows are sorted in ranges; only the ranges' sizes, one row each, meet in one task."""
    rows = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
