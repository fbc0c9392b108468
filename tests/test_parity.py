"""Every registered core query against its SQL, on the smallest tables."""

import duckdb
import pytest

from fieldloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 8) + 0.0 if isinstance(v, float) else v


def test_all_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
