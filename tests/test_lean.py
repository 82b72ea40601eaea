"""Lean formats: what is written is read back; what is wrong is told by line."""

import json

from pyspark.sql import functions as F

from quarrylight.functions import lean

MEMORY = "struct<type:string,content:string,strength:double,decay_rate:double,emotional_weight:double,confidence:double,tags:array<string>,temporal_expression:string,resolved_time:string>"
FACT = "struct<subject:string,predicate:string,value_text:string,confidence:double,inference_kind:string,evidence_text:string,temporal_expression:string,resolved_time:string>"
SCHEMA = f"i int, action string, memory {MEMORY}, facts array<{FACT}>, reasoning string"


def test_numbers(spark):
    xs = [0.0, 1.0, 0.86, -0.5, 1e-5, 0.0001, 123456.0, 1234567.0, 0.1 + 0.2, 1e20, 100.0, 0.000123456789, 9.999999e-5, 999999.5, 12.50]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", lean.number_text(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{x:g}" for x in xs]


def test_numbers_halfway_between_two_texts(spark):
    xs = [111055.5, 113056.5, 113056.50000000001, 0.1234565, 2.5e-7 + 1e-12, 1.234565e23, 1.2345649999999999e23, 1000005e10, 5e-324, -1.7976931348623157e308, 8388608.5, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    assert [r.t for r in df.select(lean.number_text(F.col("x")).alias("t")).collect()] == ["" if x is None else f"{x:g}" for x in xs]
    memory = lambda x: ("episodic", "x", x, None, None, x, [], None, None)
    rows = [(i, "store_episodic", memory(x), [("a", "b", "c", y, None, "e", None, None) for y in (x, None, 113056.5)], "r") for i, x in enumerate(xs)]
    out = spark.createDataFrame(rows, SCHEMA).orderBy("i").select(lean.at_tag(*[F.col(c) for c in ("action", "memory", "facts", "reasoning")]).alias("at")).collect()
    for r, x in zip(out, xs):
        assert [y for y in r.at.split("\n") if y.startswith(("@s", "@p", "conf="))] == ([] if x is None else [f"@s {x:g}", f"@p {x:g}"]) + ["conf=" + ("" if x is None else f"{x:g}"), "conf=", "conf=113056"]


def test_round_trips(spark):
    odd = 'a "b" \\ | , = @c { } é ☃ =x'
    memory = ("semantic", odd, 0.8, None, 0.125, 1.0, ["a,b", "c|d"], "last week", None)
    fact = ("Ada", "likes_it", odd, 0.5, None, odd + " end", None, "2024")
    rows = [(0, "promote_semantic", memory, [fact, (*fact[:3], None, "explicit", "e", "t", None)], "because = of"), (1, "ignore", None, [], "none"), (2, "store_episodic", ("episodic", "x", None, None, None, None, [], None, None), [], "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [F.col(c) for c in ("action", "memory", "facts", "reasoning")]
    out = lean.parse_at_tags(df.withColumn("at", lean.at_tag(*parts)).withColumn("compact", lean.compact(*parts)), "at").orderBy("i").collect()
    for r, (_, action, m, facts, why) in zip(out, rows):
        assert r.issues == []
        d = json.loads(r.decision)
        assert (d["action"], d["reasoning"]) == (action, why)
        assert d.get("memory") == (None if m is None else {k: v for k, v in zip(("type", "content", "strength", "decay_rate", "emotional_weight", "confidence", "tags", "temporal_expression", "resolved_time"), m) if v is not None and v != []})
        keys = ("subject", "predicate", "value", "confidence", "inference_kind", "evidence_text", "temporal_expression", "resolved_time")
        assert d["facts"] == [{k: v for k, v in zip(keys, (*f[:4], f[4] or "explicit", *f[5:])) if v is not None} for f in facts]
        assert json.loads(r["compact"]) == [action, None if m is None else list(m[:6]) + [m[6]] + list(m[7:]), [[*f[:4], f[4] or "explicit", *f[5:]] for f in facts], why]
    assert out[1].at == "@a ignore\n@m none\n@r none\n@end"


def test_wrong_blocks(spark):
    good = "@a store_episodic\n@t episodic\n@c x\n@r why\n"
    cases = [
        (good + "@end\nrubbish", []), ("\n  " + good.replace("\n", "\r\n"), []), (good + "@m none\n", ["$.memory"]), ("@m none\n" + good, []), (good + "@c later\u2028@s .5", []),
        (good + "@s high", ["$.memory.strength"]), (good + "odd line", ["$.line[5]"]), (good + "@ef", ["$.line[5]"]), (good + "@f\nsub=a", ["$.facts"]), (good + "@f\n@f\nx=1\nno\n@ef", ["$.line[6]", "$.line[7]", "$.line[8]"]),
        (good + "@f\nsub=a\npred=likes\nval=v=w\nconf=x\nkind=explicit\nev=e\n@ef", ["$.facts[0].confidence"]), (good + "@f\nsub=a\npred=Not Snake\nval=v\nconf=\nkind=guess\nev=e\n@ef", ["$.facts[0].predicate", "$.facts[0].inference_kind"]),
        ("@a odd\n@m none\n@r r", ["$.action", "$.action", "$.memory"]), ("", ["$.action", "$.memory.content", "$.memory.type", "$.reasoning"]), (None, ["$.action", "$.memory.content", "$.memory.type", "$.reasoning"]), ("@a store_episodic\n@r r", ["$.memory.content", "$.memory.type"]),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    out = lean.parse_at_tags(df, "x").orderBy("i").collect()
    heads = lambda r: [p for p in (x.path for x in r.issues) if not (cases[r.i][0] or "").count("@f\n@f") or p.startswith("$.line")]
    assert [heads(r) for r in out] == [w for _, w in cases]
    assert json.loads(out[4].decision)["memory"] == {"type": "episodic", "content": "later", "strength": 0.5}
    assert [r.decision is None for r in out] == [bool(w) for _, w in cases]


def test_lines(spark):
    xs = ["ignore", " \n Store:  a: b \nrest", "store:", "STORE_it", "nothing", "", None, "Ignore", "store"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", lean.parse_minimal(F.col("x")).alias("m"), lean.parse_binary(F.col("x")).alias("b")).orderBy("i")
    got = df.collect()
    assert [(r.m.action, r.m.content) for r in got] == [("ignore", None), ("store_episodic", "a: b"), (None, None), (None, None), (None, None), (None, None), (None, None), (None, None), (None, None)]
    assert [r.m.issue for r in got] == [None, None, "store line missing content", "unsupported minimal line: STORE_it", "unsupported minimal line: nothing", "empty minimal output", "empty minimal output", "unsupported minimal line: Ignore", "unsupported minimal line: store"]
    assert [r.b.action for r in got] == ["ignore", "store_episodic", "store_episodic", "store_episodic", None, None, None, "ignore", "store_episodic"]
    made = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate([("ignore_noise ", "x"), (None, "x"), ("store", " a "), ("store", " "), ("store", None)])], "i int, a string, c string").orderBy("i").select(lean.minimal(F.col("a"), F.col("c")).alias("m"), lean.binary(F.col("a")).alias("b")).collect()
    assert [tuple(r) for r in made] == [("ignore", "ignore"), ("ignore", "ignore"), ("store: a", "store"), (None, "store"), (None, "store")]
