"""Mined candidates against the rule as a loop."""

import random

from pyspark.sql import functions as F

from quarrylight.operators import curation as c


def loop(rows, count):
    scored = sorted((r for r in rows if r[2]), key=lambda r: (-r[3], r[0]))
    ordered = [r for k, share in c.SHARES.items() for r in [x for x in scored if x[2] == k][: max(1, int(count * share))]]
    for r in scored:
        if len(ordered) >= count:
            break
        if r not in ordered:
            ordered.append(r)
    picked, seen = [], set()
    for r in sorted(ordered):
        if r[1].lower()[:160] not in seen and len(picked) < count:
            seen.add(r[1].lower()[:160])
            picked.append(r[0])
    return picked


def test_quotas_refill_and_prefixes(spark):
    rng = random.Random(3)
    for count, kinds in ((2, 4), (7, 4), (40, 2), (40, 4), (500, 4), (30, 1)):
        names = [*c.SHARES][:kinds]
        rows = [(i, rng.choice(["Same text ", "same TEXT ", "x" * 170, "x" * 165]) + str(rng.randint(0, 80)), rng.choice([*names, names[0], None]), rng.randint(-2, 4)) for i in range(300)]
        df = spark.createDataFrame(rows, "pos int, text string, bucket string, points int").repartition(5)
        assert [r.pos for r in c.mined_candidates(df, count).orderBy("pos").collect()] == loop(rows, count)


def test_buckets_and_points(spark):
    cases = [
        ("It failed on the dataset, must retry with more care", False, "correction", 8), ("You must always test this with some care, please", False, "rule", 2), ("Results of the validation run are in, see below", False, "milestone", 5),
        ("I'm checking the logs of the server now, one moment", True, "transient", -3), ("I'm checking the logs of the server now, one moment", False, None, -3), ("ok!", False, "transient", -2), ("hello there, how is it going over on your side", True, None, 0),
    ]
    df = spark.createDataFrame([(i, t, a) for i, (t, a, *_) in enumerate(cases)], "i int, t string, a boolean")
    got = df.select("i", c.candidate_bucket(F.col("t"), F.col("a")).alias("b"), c.candidate_points(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r.b, r.p) for r in got] == [(b, p) for *_, b, p in cases]
    assert c.mined_candidates(df.select("i", F.col("t").alias("text"), F.col("i").alias("pos"), F.lit("rule").alias("bucket"), F.lit(1).alias("points")).limit(0), 5).collect() == []
