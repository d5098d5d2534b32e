"""Sharding by extendible hashing (DataFrame functions only).

A row's place is the prefix of a 60-bit hash of its content. The directory is indexed by the first `bits` of it; a bucket is as
deep as it must be: only buckets above the byte limit split on another bit. Byte sums per directory cell are computed once, by
a grouped aggregation over (hash, bytes), and rolled up bit by bit, so that depths follow from small tables; where a cell of the
directory is itself above the limit, its rows alone are counted with more bits.

Defined results: a null text has 0 bytes; a row larger than the limit gets a shard that holds no other row, if its hash is its own;
equal rows, which no bit separates, overflow into numbered parts that fit (`part`), it doesn't matter which is in which; very long texts
count by their bytes; an empty table gives an empty result. Columns of the input that clash with a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import set_aside, text_of, written

HASH_BITS = 60
LIMIT = 64 << 20

#: A directory of up to so many entries (counted, some 100 bytes each) is broadcast; a larger one is joined by shuffle, however small its files are.
BROADCAST_ENTRIES = 1 << 17

OWN = ("shard", "depth", "part", "shard_bytes", "shard_rows", "bytes")


def place(*columns: Column) -> Column:
    """The first 60 bits of an MD5, which any engine can compute, as a number."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(bits: int) -> Column:
    return F.shiftright(F.col("_h"), HASH_BITS - bits)


def side(entries: DataFrame, n: int) -> DataFrame:
    """A side of a join with n rows: broadcast if that is few; otherwise never, also not by Spark's own estimate, which takes files' sizes."""
    return F.broadcast(entries) if n <= BROADCAST_ENTRIES else entries.hint("merge")


def directory(rows: DataFrame, limit: int, bits: int, above: int) -> DataFrame:
    """_h, _b -> cell (the first `bits` of _h), depth (null where the cell itself is above the limit), with shard_bytes and
    shard_rows. above: bits that are known not to suffice (-1: none)."""
    level = rows.groupBy(prefix(bits).alias("cell")).agg(F.sum("_b").alias("b"), F.count("*").alias("n"))
    level = written(level, "shard-cells")
    found = level.select("cell", *[F.lit(None).cast(t).alias(c) for c, t in (("depth", "int"), ("shard_bytes", "long"), ("shard_rows", "long"))])
    # one row per cell, with the sums of each of its prefixes by window-free roll-up: cell -> (depth, prefix) pairs, summed
    sums = level.select(F.explode(F.sequence(F.lit(above + 1), F.lit(bits))).alias("d"), "cell", "b", "n").groupBy("d", F.expr(f"shiftright(cell, {bits} - d)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    fits = sums.filter((F.col("b") <= limit) | (F.col("n") == 1)).select(F.col("d"), "p", "b", "n")
    up = level.select("cell", F.explode(F.sequence(F.lit(above + 1), F.lit(bits))).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {bits} - d)"))
    best = up.join(fits.hint("merge") if 1 << bits > BROADCAST_ENTRIES else fits, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "b", "n")).alias("s")).select("cell", F.col("s.d").alias("depth"), F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("shard_rows"))
    return found.select("cell").join(best.hint("merge") if 1 << bits > BROADCAST_ENTRIES else best, "cell", "left")


def shard(docs: DataFrame, limit: int = LIMIT, key: tuple[str, ...] = ("doc_id", "text"), text: str = "text", step: int = 6) -> DataFrame:
    """docs with bytes, shard (the hash prefix as bits), depth, part, shard_bytes and shard_rows.

    The first directory has about 2^step cells per shard of the mean fill; a cell above the limit adds `step` bits at a time.
    Reads docs twice for (hash, bytes) and once for the result; their texts are shuffled only if the directory exceeds
    BROADCAST_ENTRIES.
    """
    docs, back = set_aside(docs, *key, text)
    names = docs.columns
    tagged = docs.select(*[F.col(f"`{c}`") for c in names], place(*[F.col(f"`{c}`") for c in key]).alias("_h"), F.octet_length(text_of(f"`{text}`")).cast("long").alias("_b"))
    rows = tagged.select("_h", "_b")
    total = docs.agg(F.sum(F.octet_length(text_of(f"`{text}`")).cast("long"))).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    levels, above = [], -1
    while True:
        entries = written(directory(rows, limit, bits, above), "shard-directory")
        levels.append((bits, entries))
        deep = entries.filter("depth IS NULL").select("cell")
        if bits == HASH_BITS or not (n := deep.count()):
            break
        rows = rows.withColumn("cell", prefix(bits)).join(side(deep, n), "cell", "left_semi").select("_h", "_b")
        above, bits = bits, min(HASH_BITS, bits + step)
    out = tagged
    for k, (b, entries) in enumerate(levels):
        e = side(entries.select(F.col("cell").alias(f"_c{k}"), F.struct("depth", "shard_bytes", "shard_rows").alias(f"_e{k}")), entries.count())
        out = out.join(e, prefix(b) == F.col(f"_c{k}"), "left")
    pick = lambda c: F.coalesce(*[F.col(f"_e{k}.{c}") for k in range(len(levels))])
    out = out.select(*[F.col(f"`{c}`") for c in names], "_h", F.col("_b").alias("bytes"), F.coalesce(pick("depth"), F.lit(HASH_BITS)).alias("depth"), F.lit(0).cast("long").alias("part"), pick("shard_bytes").alias("shard_bytes"), pick("shard_rows").alias("shard_rows"))
    if levels[-1][0] == HASH_BITS and levels[-1][1].filter("depth IS NULL").limit(1).count():
        out = overflow(out, limit)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substring(F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("depth")))
    return out.withColumn("shard", F.when(F.col("part") > 0, F.concat(name, F.lit("."), F.col("part").cast("string"))).otherwise(name)).transform(back, OWN, ("bytes", "shard", "depth", "part", "shard_bytes", "shard_rows"))


def overflow(out: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash that exceed the limit together, in parts that fit. They are dealt to 64 salts by their input partition,
    so that no task numbers all of them; equal rows are interchangeable. They are written with their salts, so that each row's part is settled
    before sums are taken."""
    over = F.col("shard_bytes").isNull()
    stuck = written(out.filter(over).withColumn("_salt", F.spark_partition_id() % 64), "shard-stuck")
    n = F.row_number().over(Window.partitionBy("_h", "_salt").orderBy("bytes")) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes")))).cast("long")
    stuck = written(stuck.withColumn("part", 1 + F.col("_salt") + 64 * F.floor(n / per).cast("long")), "shard-stuck")
    sums = written(stuck.groupBy("_h", "part").agg(F.sum("bytes").alias("_sb"), F.count("*").alias("_sn")), "shard-parts")
    stuck = stuck.drop("shard_bytes", "shard_rows", "_salt").join(sums, ["_h", "part"]).withColumnsRenamed({"_sb": "shard_bytes", "_sn": "shard_rows"})
    return out.filter(~over).unionByName(stuck.select(*out.columns))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """One folder per shard. files: tasks that write."""
    sharded.repartition(files, "shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    return shard(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "part")


#: A limit at which small tables split, too.
SMALL_LIMIT = 32 << 10


def small_shards(spark, sf_dir: str) -> DataFrame:
    """All documents under a limit of SMALL_LIMIT bytes: directories of several depths, single rows above the limit."""
    from .text import read_table

    return shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SMALL_LIMIT).drop("text", "part")


def sql(limit: int) -> str:
    """What `shard` gives, where no two rows are equal."""
    return f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h, row_number() OVER () AS r FROM documents),
p AS (SELECT r, doc_id, bytes, h, d, h >> ({HASH_BITS} - d) AS p FROM h, (SELECT unnest(range(0, {HASH_BITS + 1})) AS d)),
s AS (SELECT *, (sum(bytes) OVER w)::BIGINT AS shard_bytes, count(*) OVER w AS shard_rows FROM p WINDOW w AS (PARTITION BY d, p)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d) AS k FROM s WHERE shard_bytes <= {limit} OR shard_rows = 1)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE right(bin(p + (1::BIGINT << d)), d) END AS shard, d::INTEGER AS depth, shard_bytes, shard_rows FROM k WHERE k = 1
"""


OP9_SQL, SMALL_SHARDS_SQL = sql(LIMIT), sql(SMALL_LIMIT)
