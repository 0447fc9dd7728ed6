"""Compares a query with its SQL on DuckDB."""

import glob
import os

import duckdb
import numpy as np


def database(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v)[:10] if hasattr(v, "isoformat") else v)
        else:
            df[c] = df[c].astype("float64").round(6)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def assert_same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = _plain(a), _plain(b)
    for c in a.columns:
        u, v = a[c], b[c]
        if u.dtype.kind == "f" and v.dtype.kind == "f":
            assert np.allclose(u, v, rtol=1e-9, atol=1e-6, equal_nan=True), c
        else:
            same = (u.astype(str).str[:10] == v.astype(str).str[:10]) if c == "day" else (u == v) | (u.isna() & v.isna())
            assert same.all(), (c, u[~same].head(), v[~same].head())
