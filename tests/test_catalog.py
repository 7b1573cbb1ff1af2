import glob
import os

import duckdb
import pytest

from cliptide.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want
