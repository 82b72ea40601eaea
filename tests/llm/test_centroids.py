import math
import random

import duckdb
import numpy as np

from quarrylight.llm import centroids as cn


def plain(rows):
    """The contract with Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: __import__("hashlib").sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, _, v in sorted((sha(i), v, v) for i, v in kept if i is not None)[:8]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(10):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own) if o == k] for k in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    last = [(i, *near(v)) for i, v in kept]
    each = {k: sum(d for _, d, o in last if o == k) for k in range(len(centres))}
    return sorted(((i, k, d, each[k], sum(each.values()), cn.digest_of(centres[k])) for i, d, k in last), key=str)


def made(n, seed=0):
    rng = random.Random(seed)
    at = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(at)]) for i in range(n)]
    whole = [rng.choice([0.0, 0.5, 1.0]) for _ in range(64)]
    rows += [(n, None), (n + 1, [0.0] * 63), (n + 2, [0.0] * 65), (n + 3, [float("nan")] + [0.0] * 63), (n + 4, [float("inf")] * 64), (n + 5, [None] + [0.0] * 63), (None, rows[0][1]), (3, rows[3][1]), (3, rows[5][1])]
    return rows + [(n + 10 + i, whole) for i in range(60)] + [(n + 100, [60_000.0] * 64), (n + 101, [-60_000.0] * 64)]


SCHEMA = "vec_id long, embedding array<double>"


def test_equals_a_plain_version_and_the_sql(spark):
    rows = made(900)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "2 AS points").repartition(3)
    want = plain(rows)
    assert sorted((tuple(r) for r in cn.clustered(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in cn.clustered(df, block=100).collect()), key=str) == want
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(db.execute(cn.SQL).fetchall(), key=str) == want


def test_whole_nodes_are_assigned_where_boxes_are_small(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(0, 100) if d < 2 else 0.0 for d in range(64)]) for i in range(4000)]
    report = {}
    cn.clustered(spark.createDataFrame(rows, SCHEMA), report=report).collect()
    assert report["vectors"] == 4000 and len(report["measured"]) == 10 and report["measured"][-1] < 4000 * 8 / 3


def test_filtering_keeps_ties_to_the_smaller_number():
    rng = np.random.default_rng(2)
    points = rng.integers(-2, 3, (500, 64))
    tree = cn.Tree(points)
    assert (tree.points == points[tree.order]).all()
    centres = np.concatenate([points[:3], points[:3], rng.integers(-2, 3, (2, 64))])
    own = np.full(500, -1)
    for node, left in tree.assigned(centres):
        a, b = tree.start[node], tree.stop[node]
        assert (own[a:b] == -1).all()
        own[a:b] = left[cn.distances(tree.points[a:b], centres[left]).argmin(axis=1)]
    assert (own == cn.distances(tree.points, centres).argmin(axis=1)).all()
    again = cn.Tree.unpacked(*tree.packed())
    assert (again.points == tree.points).all() and (again.sums == tree.sums).all() and list(again.left) == list(tree.left)


def test_few_equal_and_none(spark):
    rows = [(i, [1.0] * 64) for i in range(40)]
    assert sorted((tuple(r) for r in cn.clustered(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)
    assert sorted((tuple(r) for r in cn.clustered(spark.createDataFrame(rows[:3], SCHEMA)).collect()), key=str) == plain(rows[:3])
    assert cn.clustered(spark.createDataFrame([], SCHEMA)).collect() == [] and cn.clustered(spark.createDataFrame([(1, [1.0])], SCHEMA)).collect() == []
