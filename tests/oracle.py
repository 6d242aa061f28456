"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, run, sql, sf=SF):
    df = run(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows(want.columns, want.fetchall())
    assert got == expected
