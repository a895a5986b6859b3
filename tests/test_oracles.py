"""Every core query against its SQL on DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from jobmill.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = core.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.execute(core.ORACLES[name])
    assert sorted(d[0] for d in theirs.description) == columns
    order = [[d[0] for d in theirs.description].index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=repr)
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in theirs.fetchall()), key=repr)
    assert got == wanted


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(core.QUERIES) - set(core.ORACLES)):
        assert core.QUERIES[name](spark, SF).columns, name
