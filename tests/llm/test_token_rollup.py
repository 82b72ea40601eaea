import collections

from quarrylight.llm.token_rollup import Rollup, rolled_up
from quarrylight.llm.tokens import count

SCHEMA = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, doc_id long"


def test_signed_batches_are_idempotent(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == []
    first = spark.createDataFrame([("insert", "a", "en", "t", 10, None, 1), ("insert", "a", "en", "t", 5, None, 2), ("insert", None, None, "t", 7, None, 3)], SCHEMA)
    second = spark.createDataFrame([("revise", "a", "en", "t", 12, 10, 1), ("delete", "a", "en", "t", 5, None, 2), ("delete", None, None, "t", 7, None, 3)], SCHEMA)
    assert r.apply("1", first) and not r.apply("1", first)
    assert r.apply("2", second) and not r.apply("2", second)
    assert sorted(map(tuple, r.totals().collect()), key=str) == sorted([("a", "en", "t", 1, 12), (None, None, "t", 0, 0)], key=str)
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "t", 1, 12)]
    assert not r.apply("1", first)
    # a writer that lost the race for a version rereads and commits after the winner
    other = Rollup(spark, f"file://{tmp_path}/r")
    assert other.apply("other", second)
    assert not r.log.commit(other.version, {"batch": "late", "path": "x"})
    assert r.apply("3", first) and not other.apply("3", first)
    assert {"other", "3"} <= r.batches


def test_moves_and_vacuum(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/r")
    r.apply("1", spark.createDataFrame([("insert", "a", "en", "t", 10, None, 1), ("insert", None, "en", "t", 5, None, 2)], SCHEMA))
    move = spark.createDataFrame([("revise", "b", "de", "t", 11, 10, 1, True, "a", "en"), ("revise", "b", None, "t", 5, 5, 2, True, None, "en")], SCHEMA + ", moved boolean, old_source string, old_lang string")
    r.apply("2", move)
    assert sorted(((x.source, x.lang, x.n_docs, x.n_tokens) for x in r.totals().collect()), key=str) == sorted([("a", "en", 0, 0), (None, "en", 0, 0), ("b", "de", 1, 11), ("b", None, 1, 5)], key=str)
    r.compact()
    r.vacuum()
    assert len(list(tmp_path.glob("r/delta-*"))) == 0
    fresh = Rollup(spark, f"file://{tmp_path}/r")
    assert not fresh.apply("2", move)
    assert sorted(((x.source, x.lang, x.n_docs, x.n_tokens) for x in fresh.totals().collect()), key=str) == sorted([("b", "de", 1, 11), ("b", None, 1, 5)], key=str)


def test_compactions_at_once_and_batches_meanwhile(spark, tmp_path):
    """Whatever comes between the sum of a compaction and its commit, totals are
    those of the batches."""
    batch = lambda k, n: spark.createDataFrame([("insert", "a", "en", "t", n, None, k)], SCHEMA)
    totals = lambda r: [tuple(x) for x in r.totals().collect()]
    r, other = (Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert r.apply("1", batch(1, 10)) and r.apply("2", batch(2, 20)) and not Rollup(spark, f"file://{tmp_path}/none").compact()

    def between(x, act):
        plain = x._sum
        x._sum = lambda paths: (out := plain(paths).persist(), out.count(), act(), setattr(x, "_sum", plain))[0]

    between(r, lambda: other.compact())  # the other one wins; this one gives up
    assert not r.compact() and totals(r) == totals(other) == [("a", "en", "t", 2, 30)]
    assert len(list(tmp_path.glob("r/sum-*"))) == 1
    r.apply("3", batch(3, 100))
    between(r, lambda: other.apply("4", batch(4, 1000)))  # a batch stays beside the sum
    assert r.compact() and totals(r) == totals(other) == totals(Rollup(spark, f"file://{tmp_path}/r")) == [("a", "en", "t", 4, 1130)]
    assert len(r.deltas) == 2
    between(r, lambda: (other.apply("5", batch(5, 1)), other.compact()))
    assert not r.compact() and totals(r) == [("a", "en", "t", 5, 1131)]
    between(r, lambda: (other.apply("6", batch(6, 2)), other.apply("7", batch(7, 3))))
    r.apply("8", batch(8, 4))
    assert r.compact() and other.compact() and totals(r) == totals(other) == [("a", "en", "t", 8, 1140)]
    other.vacuum()
    assert totals(r) == [("a", "en", "t", 8, 1140)] and not r.apply("6", batch(6, 2))


def test_query_equals_direct_counts(spark):
    rows = [(i, f"some words {'é' * (i % 5)} here {i}", ["a", "b", None][i % 3], ["en", None][i % 2]) for i in range(60)]
    rows += [(102, "word " * 60_000 + " " * 1_200_000, "a", "en"), (100, None, "a", "en"), (101, "", "a", "en"), (5, rows[5][1], "c", "en"), (None, "x y", "a", "en")]
    want = collections.Counter()
    for _, t, s, g in rows:
        want[s, g, "byte_bpe_50k", "d"] += 1
        want[s, g, "byte_bpe_50k", "t"] += count(t or "") + 1
        want[s, g, "words_v1", "d"] += 1
        want[s, g, "words_v1", "t"] += len((t or "").split())
    got = collections.Counter()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS kind", "2 AS n_tokens", "3 AS tokenizer")
    for r in rolled_up(df).collect():
        got[r.source, r.lang, r.tokenizer, "d"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "t"] += r.n_tokens
    assert got == want
    assert rolled_up(df.limit(0)).collect() == []
