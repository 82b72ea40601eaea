"""Queries over whole texts: against their SQL without any prefix of the text, over
made documents that differ only far behind their openings."""

import duckdb
import pytest

from quarrylight.plans import sqltext as s
from quarrylight.plans.curation_queries import norm
from quarrylight.plans.registry import ORACLE_SQL, QUERIES

OPENING = "the harbour crew painted seven wooden boats before noon " * 10
ENDS = [
    "In May 2021 Melanie visited 14 Museums.",
    "The decision was Robert's, on 3 June.",
    "A workflow for review of Anna's notes",
    "A workflow for review of Anna's notes",
    "prefer quiet stations; stations close 1999! Done",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    texts = [OPENING + x for x in ENDS] + ["Short one. And 77 more", "the boats\n\tof  Clara", "the boats of clara", "the", (OPENING + ENDS[1]).upper()]
    rows = [(i, x, "en", f"s{i % 2}", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def same(spark, d, name, *cuts):
    """``cuts``: (with, without) prefix, as in the SQL."""
    sql = ORACLE_SQL[name]
    for cut, whole in cuts:
        sql = sql.replace(cut, whole)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, d)
    out = con.execute(sql)
    at = [[c[0] for c in out.description].index(c) for c in got.columns]
    rows = sorted(str(tuple(r)) for r in got.collect())
    assert rows and rows == sorted(str(tuple(r[i] for i in at)) for r in out.fetchall())
    return got


def test_text_functions(spark, tables):
    got = {r.doc_id: r for r in same(spark, tables, "text_functions", ("left(text, 200)", "text")).collect()}
    assert got[0].numbers == "2021 14" and got[0].entities == "may melanie museum"


def test_word_pairs(spark, tables):
    got = {r.pair: r.n for r in same(spark, tables, "word_pairs", ("left(text, 300)", "text")).collect()}
    assert got["before noon"] == 60


def test_duplicate_groups(spark, tables):
    got = same(spark, tables, "duplicate_groups", ("left(text, 400)", "text"))
    assert sorted(r.locations for r in got.collect()) == ["1,9", "2,3", "6,7"]


def test_dedupe_source_family(spark, tables):
    got = same(spark, tables, "dedupe_source_family", (f"left({norm('text')}, 2)", norm("text")))
    assert [r.doc_id for r in got.collect()] == [1]


def test_opening_audit(spark, tables):
    words = f"array_to_string(list_slice(string_split({s.squeeze('text')}, ' '), 1, 8), ' ')"
    got = same(spark, tables, "opening_audit", ("left(text, 3)", words))
    assert got.first().openings == 6


def test_mnemonic_keys(spark, tables):
    got = {r.doc_id: float(r.salience) for r in same(spark, tables, "mnemonic_keys", ("left(text, 300)", "text")).collect()}
    assert (got[0], got[1], got[2], got[5]) == (0.8, 0.84, 0.8, 0.72)


def test_phrase_matches_against_brute_force(spark):
    """Phrases of one to many words, blanks in a row, nulls, an empty one, repeated ones."""
    from quarrylight.operators.curation import phrase_matches

    texts = ["a b c d", "xa b c dx", "a  b c", "b", "", None, "one two three four five", "a\nb c d e", "long " * 5000 + "a b c d"]
    phrases = ["a b c d", "b c", "b", "a b c", "  ", "", "two three four", "c d e", None, "b", "four five six", "a  b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_k int, norm string")
    got = phrase_matches(rows, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()
    want = sorted((k, p) for k, x in enumerate(texts) if x is not None for p in {p for p in phrases if p is not None} if p in x)
    assert sorted(map(tuple, got)) == want
    assert not phrase_matches(rows.limit(0), rows.select("norm").toDF("phrase").limit(0)).collect()
