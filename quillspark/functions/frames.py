"""Small helpers over DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows, counted first.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, as it is otherwise (then the join shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_side(df: DataFrame, most: int) -> DataFrame:
    """As small_side, where it is known that df has at most `most` rows: nothing has to be run to count them."""
    return F.broadcast(df) if most <= BROADCAST_ROWS else df


#: Below so many bytes a task, a scan is dealt out anew: a small file may be one row group, and so one task.
SMALL_TASK = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small enough for that to cost next to nothing; large inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= n * SMALL_TASK else df


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: str = "4m") -> None:
    """From now on Arrow batches of this session hold about `limit` bytes at most, for Spark's default is held several times over by each
    Python worker. A limit that the session has set itself stays."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864", "67108864b", "64m"):
        spark.conf.set(_BATCH, limit)


def computed(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns that are worked out once per row, where they stand. A plain projection would be copied into every filter and
    expression above it, which grows out of hand when columns build on each other."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where the setting is absent, it is set to a folder of
    this application if all runs on one machine; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/quillspark-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once: it is worked out once, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by, name: the exact q-quantile of a numeric column in each group, interpolated between neighbours; nulls don't count.

    Values are sorted in ranges over all tasks; only the ranges' counts (ranges x groups) meet, to say where in the order each range begins.
    """
    keys = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    g = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*keys, F.col(f"`{value}`").cast("double").alias("_v")).filter("_v IS NOT NULL")
    rows = kept(rows.repartitionByRange(*g, "_v").sortWithinPartitions(*g, "_v").withColumn("_at", F.monotonically_increasing_id()), "quantile").withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy(*g, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    all_of = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(all_of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(all_of))
    s = sizes.select(*[F.col(c).alias(f"{c}s") for c in g], F.col("_range").alias("_ranges"), "_first", "_before", "_all")
    on = F.col("_range") == F.col("_ranges")
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}s"))
    spot, place = F.lit(q) * (F.col("_all") - 1), F.col("_before") + F.col("_at") - F.col("_first")
    near = rows.join(F.broadcast(s), on).withColumn("_spot", spot).withColumn("_place", place).filter((F.col("_place") == F.floor("_spot")) | (F.col("_place") == F.ceil("_spot")))
    part = F.col("_spot") - F.floor("_spot")
    return near.groupBy(*g).agg((F.min("_v") + (F.max("_v") - F.min("_v")) * F.first(part)).alias(name)).withColumnsRenamed({f"_g{i}": c for i, c in enumerate(by)})


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def form_of(key: str, values: list[str]) -> Column:
    """One of the values for each row, by its key in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))
