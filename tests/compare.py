"""Spark results against DuckDB on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    out = []
    for r in df.astype(object).itertuples(index=False, name=None):
        out.append(tuple(plain(x.item() if hasattr(x, "item") else x) for x in r))
    return sorted(out, key=repr)


def assert_same(df, con, sql):
    a, b = df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
