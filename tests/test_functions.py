"""Hand-computed values of text, temporal, decision and segment functions."""

import json

from pyspark.sql import functions as F

from quarrylight.functions import tagged
from quarrylight.functions import temporal as tm
from quarrylight.functions import text as t
from quarrylight.operators import decisions as dc
from quarrylight.operators import segment as sg


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("v")).first().v


def test_tokens(spark):
    assert one(spark, t.tokens("x"), x="What database does the user prefer?") == ["database", "doe", "user", "prefer"]
    assert one(spark, t.tokens("x"), x="Stories boxes bus this") == ["story", "box", "bus", "thi"]
    assert one(spark, t.entity_tokens("x"), x="éPari Émma Tokyoé Rome") == ["pari", "tokyo", "rome"]
    assert one(spark, t.numbers("x"), x="7 42 2023 12345 x99 1999.") == ["42", "2023", "1999"]
    assert one(spark, t.fnv1a("x"), x="abc") == 440920331


def test_keys(spark):
    assert one(spark, t.recall_key("x"), x="  Review PR: now! ") == "review-pr-now"
    assert one(spark, t.predicate("x"), x=" Likes  Tea ") == "likes_tea" and one(spark, t.predicate("x"), x="--") is None
    assert one(spark, t.step_id("x"), x="Run `npm test` First!") == "run_npm_test_first" and one(spark, t.step_id("x"), x="!!") == "step"
    assert one(spark, t.first_statement("x"), x="One. Two.") == "One." and one(spark, t.first_statement("x"), x="no end") == "no end"
    assert one(spark, t.base_source("x"), x="s:chunk-12") == "s"
    assert one(spark, t.redacted("x"), x="mail a.b@c.org  key sk-abcdefghijkl") == "mail [REDACTED_EMAIL] key [REDACTED_API_KEY]"
    assert one(spark, t.tag_value("x", "k"), x=["a", "k:v:w"]) == "v:w"
    assert one(spark, t.unique_tags("x"), x=[" a b ", "", "c", "c"]) == ["a_b", "c"]
    assert one(spark, t.workflow_steps("x"), x="# T\n1. Open it\n 2. Close it\nno\n3. open it") == ["open_it", "close_it"]
    assert one(spark, t.workflow_key("x", F.col("y")), x="# Train on a GPU", y=["Workflow:My-Key"]) == "my-key"
    assert one(spark, t.workflow_key("x"), x="# GPU train run") == "runpod-gpu-train"
    assert one(spark, t.estimated_tokens("x"), x="  abcde ") == 2 and one(spark, t.estimated_tokens("x"), x=" ") == 0


def test_temporal(spark):
    def resolve(word, stamp):
        return one(spark, tm.resolve_relative("w", tm.source_date("s"), extended=True), w=word, s=stamp)

    assert resolve("yesterday", "2023-05-08T13:56:00Z") == "7 May 2023"
    assert resolve("last week", "1:56 pm on 8 May, 2023") == "week before 8 May 2023"
    assert resolve("next month", "2023-12-31") == "January 2024" and resolve("last year", "2024-02-29") == "2023"
    assert resolve("this week", "2023-05-08") == "week of 8 May 2023" and resolve("today", "no date") is None
    got = one(spark, tm.normalized(F.lit(None).cast("string"), F.col("x"), F.lit(None).cast("string"), F.lit(0.4), F.col("s")), x="Left yesterday.", s="2023-05-08")
    assert tuple(got) == ("yesterday", "7 May 2023", 0.9)
    assert tuple(one(spark, tm.normalized(F.lit("someday"), F.col("x"), F.lit("z"), F.lit(0.4), F.col("s")), x="", s="2023-05-08")) == (None, None, None)


def test_actions(spark):
    assert one(spark, dc.normalize_action("x"), x=" Ignore_Noise ") == "ignore" and one(spark, dc.normalize_action("x"), x="odd") == "store_episodic"
    assert [one(spark, dc.route("x"), x=a) for a in ("flag_conflict", "promote_semantic", "store_episodic")] == ["conflict_log_and_hold", "semantic_upsert", "episodic_insert"]
    assert one(spark, dc.action_of_operation("x"), x="Recall weighting") == "rank"


def test_parse_decision(spark):
    good = {"action": "promote_semantic", "memory": {"content": "User likes tea", "confidence": 0.9}, "facts": [{"subject": "user", "predicate": "Likes", "value": "tea", "evidence_text": "likes tea"}, {"subject": "person", "predicate": "p", "value": "v", "evidence_text": "e"}], "indexables": [{"kind": "Workflow", "key": "My Key!"}, {"kind": "no", "key": "k"}]}
    rows = [("1", "x " + json.dumps(good) + " y", "f"), ("2", "not json", "fall"), ("3", '{"action":"store","memory":"plain text"}', "f"), ("4", '{"action":"ignore","memory":null}', "f")]
    out = {r.id: r for r in dc.parse_decision(spark.createDataFrame(rows, "id string, raw string, fb string"), "raw", "fb").collect()}
    assert out["1"].action == "promote_semantic" and out["1"].memory.content == "User likes tea"
    assert [(f.subject, f.predicate, f.value_text) for f in out["1"].facts] == [("user", "likes", "tea")]
    assert [(i.kind, i.key) for i in out["1"].indexables] == [("workflow", "my-key")]
    assert out["2"].parse_error and out["2"].memory.content == "fall" and out["2"].memory.tags == ["parse_fallback"] and out["2"].action == "store_episodic"
    assert out["3"].memory.content == "plain text" and out["3"].action == "store" and out["4"].memory is None


def test_consolidation_keeps_half(spark):
    rows = [("a", "update_existing", 0.5, None, "alpha beta gamma delta", "alpha beta only"), ("a", "update_existing", 0.5, None, "alpha beta gamma delta", "other"), ("a", "ignore", 0.2, None, "x", "y"), ("a", "ignore", 0.5, 0.4, "x", "y")]
    df = spark.createDataFrame([("store_episodic", *r[1:]) for r in rows], "action string, verdict string, near double, cos double, old string, merged string")
    assert [r.final_action for r in dc.consolidated(df, "action", "verdict", "near", "cos", "old", "merged").collect()] == ["update_existing", "store_episodic", "store_episodic", "store_episodic"]


def test_segments():
    assert sg.segments("  short ") == [(0, "short", 2, "single")]
    text = "\n".join(["# One", "para " * 30, "", "1. first", "2. second", "tail", "", "## Two", "more " * 40])
    got = sg.segments(text, 50, 5)
    assert {"markdown_header", "numbered_block"} <= {g[3] for g in got} and all(g[2] <= 50 for g in got)
    assert any("1. first\n2. second\ntail" in g[1] for g in got)
    assert "".join("".join(g[1].split()) for g in got) == "".join(text.split())
    long = " ".join(f"Sentence number {i}." for i in range(200))
    assert all(n <= 60 for _, _, n, _ in sg.segments(long, 60, 5))


def test_tagged():
    text = "A:store_episodic\nT:episodic\nC:likes\\ctea\nQ:0.7,0.02,0.2,0.8\nF:user|likes|tea|0.9|explicit|user likes tea\nR:why\nEND"
    status, d, notes = tagged.repaired(text)
    assert status == "parsed" and d["memory"]["content"] == "likes,tea" and not notes
    status, d, notes = tagged.repaired("A:store_episodic\nT:episodic\nC:x\nQ:about 0.7,,,,9\nF:user|Likes It|tea|0.9|guess|e\nF:bad\njunk\nZ:1\nEND")
    assert status == "repaired" and d["facts"][0]["predicate"] == "likes_it" and d["reasoning"] == "Stored: x"
    assert {"coerced_q_strength", "truncated_q_quad", "snake_cased_predicate", "forced_explicit_kind", "dropped_malformed_fact", "dropped_untagged_line", "dropped_unknown_tag"} <= set(notes)
    assert tagged.repaired("garbage")[0] == "failed_safe" and tagged.repaired("A:ignore\nM:-\nR:r\nEND")[0] == "parsed"
    assert tagged.complete_objects('x {"a": "}"} {b {"c": 1}} {') == ['{"a": "}"}', '{b {"c": 1}}']
