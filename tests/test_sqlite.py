import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import service as sv
from quarrylight.sources.sqlite import read_sqlite, write_sqlite


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        with sqlite3.connect(tmp_path / f"a{k}.db") as db:
            db.execute("CREATE TABLE semantic (id TEXT, n INTEGER, x REAL, content TEXT, created_at TEXT)")
            db.executemany("INSERT INTO semantic VALUES (?, ?, ?, ?, ?)", [(f"{k}-{i}", i, i / 2, f"c{i} é", f"2024-01-{1 + i % 28:02}") for i in range(250)])
            db.execute("DELETE FROM semantic WHERE n % 50 = 3")
            db.execute("INSERT INTO semantic VALUES (NULL, 'odd', 'odd', X'ff41', NULL)")
            if k:
                db.execute("CREATE TABLE memory_facts (source_id TEXT, fact TEXT)")
                db.executemany("INSERT INTO memory_facts VALUES (?, ?)", [(f"{k}-{i % 3}", f"f{i}") for i in range(7)])
                db.execute("CREATE TABLE keyed (id TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
                db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
        db.close()
    return str(tmp_path)


def test_ranges_columns_and_filters(spark, folder):
    df = read_sqlite(spark, folder, "semantic", rows=40)
    assert df.dtypes == [("id", "string"), ("n", "bigint"), ("x", "double"), ("content", "string"), ("created_at", "string")]
    assert df.rdd.getNumPartitions() == 3 * 7
    want = {(f"{k}-{i}", i, i / 2, f"c{i} é", f"2024-01-{1 + i % 28:02}") for k in range(3) for i in range(250) if i % 50 != 3}
    got = [tuple(r) for r in df.collect()]
    assert set(got) - {(None, None, None, "�A", None)} == want and len(got) == len(want) + 3
    narrow = read_sqlite(spark, folder, "semantic", "id string, n long, missing string", rows=40)
    some = narrow.filter("n >= 240 AND id > '1' AND n < 245")
    assert sorted(tuple(r) for r in some.collect()) == sorted((f"{k}-{i}", i, None) for k in (1, 2) for i in range(240, 245))
    assert narrow.filter("n IS NULL").count() == 3 and narrow.filter(F.col("n") == 7).count() == 3
    assert [r.v for r in read_sqlite(spark, folder, "keyed").orderBy("id", "v").collect()] == [1, 1, 2, 2]
    assert read_sqlite(spark, f"{folder}/a0.db", "semantic").count() == 246


def test_missing_tables_and_grouped_facts(spark, folder):
    facts = read_sqlite(spark, folder, "memory_facts")
    assert facts.count() == 14 and read_sqlite(spark, f"{folder}/a0.db", "memory_facts", "source_id string, fact string").collect() == []
    with pytest.raises(Exception, match="no file has a table"):
        read_sqlite(spark, folder, "nothing").collect()
    held = read_sqlite(spark, folder, "semantic", "id string").withColumnRenamed("id", "source_id").filter("source_id LIKE '%-1'")
    got = {r.source_id: list(r.facts) for r in sv.with_facts(held, facts).collect()}
    assert got == {"0-1": [], "1-1": ["f1", "f4"], "2-1": ["f1", "f4"]}


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é'{i}", i / 3, None) for i in range(100)], "a long, `b c` string, d double, e string").repartition(4)
    paths = write_sqlite(df, f"file://{tmp_path}/out", "t")
    assert len(paths) == 4 == len(list((tmp_path / "out").iterdir()))
    assert sorted(map(tuple, read_sqlite(spark, f"{tmp_path}/out", "t").collect())) == sorted(map(tuple, df.collect()))
