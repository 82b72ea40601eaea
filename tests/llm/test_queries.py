"""Registered queries against their SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from quarrylight.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(found, key=str)
