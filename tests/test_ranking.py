"""Golden cases of the hybrid ranking."""

from quarrylight.operators import ranking as r

SCHEMA = "user_id string, table string, id string, pos int, content string, tags array<string>, confidence double, strength double"


def ask(spark, query, rows, **more):
    q = spark.createDataFrame([("u", 1, query, more.pop("preferred", []))], "user_id string, qid int, query string, preferred array<string>")
    m = spark.createDataFrame([("u", "episodic", str(i), i, *x) for i, x in enumerate(rows)], SCHEMA)
    return {x.id: x for x in r.hybrid_rank(q, m, **{"top_k": 5, "min_score": 0.0, **more}).collect()}


def test_golden_scores(spark):
    got = ask(spark, "What database does the user prefer?", [("User prefers SQLite for local apps.", [], 0.8, 0.8), ("User went hiking yesterday.", [], 0.8, 0.8)])
    assert (got["0"].score, got["1"].score) == (1.117492, 0.5725) and got["0"].rank == 1
    got = ask(spark, "When did Melanie paint a sunrise?", [("Melanie experienced a meteor shower during a camping trip last year.", ["camping", "memory"], 0.95, 0.9), ("Melanie shared a painting of a sunrise from 2022 that holds special meaning to her.", ["painting", "sample_speaker:Melanie", "sample_dia_id:D1:12"], 0.9, 0.85)])
    assert (got["0"].score, got["1"].score) == (1.08517, 1.813254) and got["1"].rank == 1


def test_duplicates_and_thresholds(spark):
    same = ("User prefers SQLite for local apps.", [], 0.8, 0.8)
    got = ask(spark, "database user prefer", [same, same, ("Nothing in common", [], 0.2, 0.2), ("On 3 May 2021 nothing", [], 1.0, 1.0)], min_score=0.15)
    assert set(got) == {"0", "3"}
    got = ask(spark, "what time was it", [("On 3 May 2021 nothing", [], 1.0, 1.0), ("x", [], 0.0, 0.0)], min_score=0.35, preferred=["episodic"])
    assert got["0"].score == 0.53 and set(got) == {"0"}


def test_indexables_prefer_the_exact_key(spark):
    q = spark.createDataFrame([("u", 1, "review-pr")], "user_id string, qid int, query string")
    x = spark.createDataFrame([("u", 1, 1, "workflow", "sqlite-local", 0.95, None, None, None), ("u", 2, 2, "workflow", "review-pr", 0.9, None, None, None)], "user_id string, id int, pos int, kind string, key string, salience double, reconstructive_hint string, tags array<string>, steps array<string>")
    assert [r_.id for r_ in r.rank_indexables(q, x).orderBy("rank").collect()] == [2, 1]


def paired_indexables(queries, indexables, top_k):
    """R10 over all pairs of a user, by a plain loop; scores and positions only, as equal ones may change places."""
    import re
    from decimal import ROUND_HALF_UP, Decimal

    from quarrylight.functions import plain

    out = []
    for user, qid in sorted({(u, i) for u, i, _ in queries}):
        found = []
        for text in [x for u, i, x in queries if (u, i) == (user, qid)]:
            norm, tokens = re.sub("[^a-z0-9]+", "-", text.lower()).strip("-"), plain.tokens(text)
            for owner, _, pos, kind, key, salience, hint, tags, steps in indexables:
                if owner != user:
                    continue
                low, hay = (key or "").lower(), set(plain.tokens(" ".join([key or "", hint or "", *(tags or []), *(steps or [])])))
                score = 0.5 if salience is None else salience
                score += 0.55 if low and (low in norm or norm in low) else 0.0
                score += 0.1 if kind == "workflow" and re.search("review|workflow|procedure|how do i", norm.replace("-", " ")) else 0.0
                score += sum(t in hay for t in tokens) / len(tokens) * 0.35 if tokens else 0.0
                score = float(Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
                found += [(-score, pos)] if score >= 0.35 else []
        out += [(user, qid, k + 1, pos, -score) for k, (score, pos) in enumerate(sorted(found)[:top_k])]
    return out


INDEXABLE = "user_id string, id int, pos int, kind string, key string, salience double, reconstructive_hint string, tags array<string>, steps array<string>"


def test_indexables_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = ["review", "the", "of", "at", "tea", "cats", "pull", "request", "a", "Paris", "deploy", "it", "12"]
    some = lambda n: [rng.choice(words) for _ in range(rng.randrange(n))]
    key = lambda: rng.choice(["-", "_", ""]).join(some(6)) + rng.choice(["", "", "x", "To-the-of-tea"])
    x = [(rng.choice("ab"), i, i, rng.choice(["workflow", "mnemonic", None]), rng.choice([key(), key(), None]), rng.choice([None, 0.1, 0.3, 0.35, 0.6, rng.random()]), rng.choice([None, " ".join(some(5))]), rng.choice([None, some(3)]), rng.choice([None, some(3)])) for i in range(300)]
    x += [("a", 7, 7, "workflow", "review", 0.2, None, None, None)] * 3
    q = [(u, i, " ".join(some(8)) + rng.choice(["", "?", " how do I"])) for u in "abc" for i in range(40)]
    q += [("a", 100, "..."), ("a", 101, "at"), ("a", 102, "to the of"), ("a", 103, "the-of"), ("a", 104, ""), ("b", 105, "e"), ("a", 1, "tea"), ("a", 2, "cats"), ("a", 2, "cats")]
    queries = spark.createDataFrame(q, "user_id string, qid int, query string").repartition(3)
    for k in (2, 9):
        got = sorted((r_.user_id, r_.qid, r_.rank, r_.id, r_.score) for r_ in r.rank_indexables(queries, spark.createDataFrame(x, INDEXABLE).repartition(4), k).collect())
        assert got == paired_indexables(q, x, k)


def test_indexables_without_all_pairs(spark):
    """Pairs with nothing in common are not made."""
    x = spark.range(20_000).selectExpr("concat('u', id % 1) AS user_id", "id", "id AS pos", "'mnemonic' AS kind", "concat('zz', id) AS key", "0.4 AS salience", "'' AS reconstructive_hint", "CAST(NULL AS array<string>) AS tags", "CAST(NULL AS array<string>) AS steps")
    q = spark.range(50).selectExpr("concat('u', id % 1) AS user_id", "id AS qid", "concat('question number ', id) AS query")
    out = r.rank_indexables(q, x, 3)
    assert {(r_.id, r_.score) for r_ in out.collect()} == {(0, 0.4), (1, 0.4), (2, 0.4)}
    # no join by user alone; the one without a key brings the lengths of short questions, one row
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "user_id" in line]
    assert joins and all("entry#" in line or "ask#" in line or "flavour#" in line for line in joins)


def test_nearest_vectors_of_odd_lengths(spark, monkeypatch):
    import math
    import random

    from quarrylight.operators import vectors as vc

    rng = random.Random(5)
    vector = lambda n: [rng.choice([None, 0.0, 1.0, rng.uniform(-1, 1)]) for _ in range(n)]
    held = [(u, t_, i, vector(rng.choice([0, 3, 5, 8]))) for u in ("a", "b", None) for t_ in ("episodic", "semantic") for i in range(40)] + [("a", "semantic", 99, None), ("a", "semantic", 98, [1.0, 0.0, 0.0]), ("a", "episodic", 97, [2.0, 0.0, 0.0])]
    asked = [(u, q, vector(rng.choice([3, 8]))) for u in ("a", "b", "c") for q in range(9)] + [("a", 50, []), ("a", 51, [1.0, 0.0, 0.0])]

    def cosine(x, y):
        pairs = [(p or 0.0, q or 0.0) for p, q in zip(x or [], y or [])]
        norm = math.sqrt(sum(p * p for p, _ in pairs)) * math.sqrt(sum(q * q for _, q in pairs))
        return round(sum(p * q for p, q in pairs) / norm, 9) if norm else 0.0

    want = {}
    for u, q, x in asked:
        best = sorted((-cosine(x, y), t_, i) for v, t_, i, y in held if v == u)[:6]
        want |= {(u, q, k + 1): (t_, i, -c) for k, (c, t_, i) in enumerate(best)}
    queries = spark.createDataFrame(asked, "user_id string, qid int, q_embedding array<double>").repartition(3)
    vectors = spark.createDataFrame(held, "user_id string, table string, id int, embedding array<float>").select("user_id", "table", "id", "embedding").repartition(4)
    # floats of the vectors are taken as they are stored
    exact = {(r_.user_id, r_.table, r_.id): r_.embedding for r_ in vectors.collect()}
    held[:] = [(u, t_, i, exact[u, t_, i]) for u, t_, i, _ in held]
    want = {}
    for u, q, x in asked:
        best = sorted((-cosine(x, y), t_, i) for v, t_, i, y in held if v == u)[:6]
        want |= {(u, q, k + 1): (t_, i, -c) for k, (c, t_, i) in enumerate(best)}
    got = {(r_.user_id, r_.qid, r_.rank): (r_.table, r_.id, round(r_.vector, 9)) for r_ in vc.vector_top(queries, vectors, 6).collect()}
    assert got == {k: (t_, i, round(c, 9) + 0.0) for k, (t_, i, c) in want.items()}
    assert vc.vector_top(queries, vectors.limit(0), 6).collect() == []
