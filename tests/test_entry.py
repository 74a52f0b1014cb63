"""The driver's contract."""

import glob
import os

import __spark_entry__ as E
import duckdb
import pytest

DATA = os.environ.get("CORPUSLOOM_DATA", "/root/testdata/sf0.001")
CORE = [q for q in E.catalogue.QUERIES]


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def check(spark, name):
    df = E.queries()[name](spark, DATA)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if sql := E.oracle_sql().get(name):
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        assert sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall()) == got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    check(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
