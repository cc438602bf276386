"""Comparison of a query with its DuckDB equivalent on the same tables."""

import glob
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in data)


def check(spark, sf_dir: str, query, sql: str) -> int:
    con = connection(sf_dir)
    con.execute(sql)
    expected = rows([d[0] for d in con.description], con.fetchall())
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
    return len(got[1])
