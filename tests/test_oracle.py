"""Every query with SQL is held against it on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from corpusloom import plans  # noqa: E402
from corpusloom.session import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    place = [want.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=str)
    assert got == sorted((tuple(norm(r[i]) for i in place) for r in want.fetchall()), key=str)
