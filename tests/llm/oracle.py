"""Compares a Spark result with a DuckDB query over the same tables."""

import glob
import os

import duckdb


def compare(spark, sf_dir, df, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    expected = sorted(result.fetchall(), key=str)
    got = sorted(map(tuple, df.select(*names).collect()), key=str)
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g == e
    return len(got)
