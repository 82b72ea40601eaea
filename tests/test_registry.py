"""Every registered query of the library against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarrylight.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert all(c.replace("_", "").isalnum() for c in columns)
    rows = sorted(str(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    out = db.execute(ORACLE_SQL[name])
    at = [[c[0] for c in out.description].index(c) for c in columns]
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in out.fetchall())
