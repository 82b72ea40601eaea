import random

import duckdb

from quarrylight.llm.mixing import SQL, mix, mixed, targets


def reshare(sizes, weights=(1, 2, 3), most=3):
    """The contract in words: excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_targets(spark):
    rng = random.Random(0)
    for n in (1, 2, 5, 9):
        sizes = {(None if i == 0 and n > 2 else f"s{i}"): rng.choice([0, 1, 10, 1000, 50000]) + 1 for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = reshare(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_equals_sql_and_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60) + "x#" * rng.randint(0, 5), rng.choice(["a", "a", "a", "a", "b", "c", None, "é"])) for i in range(3000)]
    rows += [(3001, None, "a"), (3002, "", "b"), (None, "one two", "c"), (5, "one two three", "b"), (5, "one two three", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS bucket", "3 AS target")
    got = mix(df, buckets=16).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(((d, z, s, round(t, 6), k) for d, z, s, t, k in db.execute(SQL).fetchall()), key=str)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == want
    taken, goal = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 61 for s in goal)
    out = mixed(df)
    assert out.columns == df.columns
    sizes = {}
    for r in out.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    assert sizes == taken


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).collect() == [] and mixed(df).collect() == []
