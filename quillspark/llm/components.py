"""Connected components of a link table, by joins on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import discard, written


def components(links: DataFrame) -> DataFrame:
    """links (x, y) -> node, root: the smallest node of its component, for every node that has a link.

    Alternates large-star and small-star steps until a pass changes nothing; each pass is written to the shared folder. The
    number of passes grows with the logarithm of the longest chain. A star's centre is dealt out as any join key: after
    the first pass a node keeps one link, to the smallest node it has seen.
    """
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "links")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "links-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = written(small, "links-small")
        # a fixed point: every node hangs on one root, and no root hangs on another
        now = total(small)
        discard(large)
        discard(edges)
        edges = small
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
