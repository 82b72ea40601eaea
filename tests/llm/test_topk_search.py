import numpy as np
import pytest

from quarrylight.llm import topk_search
from quarrylight.llm.topk_search import best_of, top_k


def brute(rows, every, k):
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted(((-int(v @ w), i) for i, w in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 32)
    monkeypatch.setattr(topk_search, "ANNULI", 24)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [(5000 + i, [0.5] * 12) for i in range(300)]
    rows += [(9000, None), (9001, [None] + [0.1] * 11), (9050, [float("nan")] * 12), (9100, [float("inf")] * 12), (9150, []), (9200, [1.0, 2.0]), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS annulus", "2 AS pivot", "'l' AS label").repartition(5)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    report = {}
    assert sorted(map(tuple, top_k(df, pivots=6, report=report).collect())) == brute(as_float, 50, 5)
    assert report["pairs"] == 38 * 1802


def test_most_pairs_are_never_scored(spark):
    """On clustered vectors of like length the bounds leave less than a third."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(24, 16))
    v = centres[rng.integers(0, 24, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows, report = [(i, x.tolist()) for i, x in enumerate(v)], {}
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), report=report).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 5)
    assert 0 < report["scored"] < 0.33 * report["pairs"]


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [float(1 << 20) + i, float(i % 7) * 1e6]) for i in range(200)]
    assert sorted(map(tuple, top_k(spark.createDataFrame(rows, schema)).collect())) == brute(rows, 50, 5)
    with pytest.raises(ValueError, match="too long"):
        top_k(spark.createDataFrame([(0, [1e18]), (1, [1.0])], schema))


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    got = top_k(spark.createDataFrame([(0, [1.0]), (3, [0.5]), (2, [0.5]), (1, [-1.0])], schema)).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 2, 32768), (0, 2, 3, 32768), (0, 3, 1, -65536)]


def test_best_of_ties():
    assert best_of(np.array([1.0, 3, 3, 3, 9]), np.array([9, 8, 7, 6, 5]), 2, 5).tolist() == [3, 2]


def test_blocks_of_queries_are_never_broadcast(spark, monkeypatch):
    """All in all they may be larger than any table, though the planner takes them for small."""
    monkeypatch.setattr(topk_search, "GROUP", 300)
    monkeypatch.setattr(topk_search, "CHUNK", 32)
    plans, own = [], topk_search.staged
    monkeypatch.setattr(topk_search, "staged", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, label))
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(2000, 6)))]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 5)
    rounds = [p for p in plans if "query_ids" in p]
    assert len(rounds) > 1
    for plan in rounds:
        join = next(line for line in plan.splitlines() if "Join" in line and ("group#" in line or "annulus#" in line))
        assert "SortMergeJoin" in join
