"""Every registered query with an oracle, against DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tracelake.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    assert got == expected
    assert got, "an empty result proves nothing"


def test_queries_without_an_oracle_run(spark):
    for name, f in registry.queries().items():
        if name not in ORACLES:
            assert f(spark, SF).count() > 0, name
