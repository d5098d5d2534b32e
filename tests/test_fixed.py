"""Numbers as text, against what DuckDB prints."""

import random

import duckdb
from pyspark.sql import functions as F

from quillspark.functions.text import fixed


def test_fixed_as_printed(spark):
    made = random.Random(4)
    values = [n / 20000 for n in range(1, 12000, 2)] + [n / 32 for n in range(64)] + [made.random() * 10 ** made.randint(-6, 5) for _ in range(3000)] + [0.0, 1.0, -0.25, -0.00005, 0.99995, 0.00015, 12345.00025]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").orderBy("i").select(fixed(F.col("v"), 4)).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT printf('%.4f', ?::DOUBLE)", [v]).fetchone()[0] for v in values]
    assert got == want
    assert [(v, g, w) for v, g, w in zip(values, got, want, strict=True) if f"{v:.4f}" != w] == []


def test_nothing_stays_nothing(spark):
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 4)).first()[0] is None
