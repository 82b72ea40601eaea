"""Remembering in order of arrival, against a plain loop and as a stream."""

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F

from quarrylight.functions import plain
from quarrylight.functions import text as t
from quarrylight.operators import ranking
from quarrylight.streaming import remember as rm

TEXTS = ["Melanie's studies in May 2023, 12 classes!", "The boxes of 1999 were lost yesterday", "Über ÇA 3 May 10 ties Classes", "", "when? DATE 7 July x_12 a12 12", "Kelvin K İstanbul s ss ies bies", "  A\tb\x0bc\n\n D {x} y} "]


def test_plain_forms_equal_the_columns(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    got = df.select("x", t.tokens("x"), t.significant_tokens("x"), t.numbers("x"), t.entity_tokens("x"), t.temporal_question("x"), t.temporal_signal("x"), t.content_key("x")).collect()
    for r in got:
        assert tuple(r)[1:] == (plain.tokens(r.x), plain.significant_tokens(r.x), plain.numbers(r.x), plain.entity_tokens(r.x), plain.temporal_question(r.x), plain.temporal_signal(r.x), plain.content_key(r.x))


def test_plain_score_equals_the_ranking(spark):
    rows = [("u", "semantic" if i % 2 else "episodic", f"m{i}", i, x, ["May", "class:a"], "src", 0.3 + i / 20, 0.7) for i, x in enumerate(TEXTS)]
    memories = spark.createDataFrame(rows, "user_id string, table string, id string, pos int, content string, tags array<string>, source_id string, confidence double, strength double")
    asked = spark.createDataFrame([("u", i, x) for i, x in enumerate(TEXTS)], "user_id string, qid int, query string")
    native = {(r.qid, r.id): r.score for r in ranking.hybrid_rank(asked, memories, top_k=20, min_score=0.0).collect()}
    for i, x in enumerate(TEXTS):
        for r in rows:
            m = plain.Memory(r[1], {"id": r[2], "content": r[4], "tags": r[5], "source_id": r[6], "confidence": r[7], "strength": r[8]})
            if (i, r[2]) in native:
                assert abs(plain.Question(x).score(m) - native[i, r[2]]) < 2e-6
    assert len(native) > 20


def request(user, seq, text, action="store_episodic", **more):
    return {"user_id": user, "seq": seq, "request_id": f"{user}-{seq}", "action": action, "held": None, "content": text, "strength": None, "confidence": None, "tags": [], "source": "s"} | dict.fromkeys(rm.FIELDS) | {"source_id": more.get("source", "s")} | more


def _judge():
    """A nested function, which tasks get by value."""

    def judge(new, near_id, old):
        if "merge" in new:
            return 'Sure: {"action": "update_existing", "merged_content": "%s"}' % (old if "badly" in new else f"{old} + {new}")
        if "conflict" in new:
            return '{"action": "FLAG_conflict "}'
        if "boom" in new:
            raise RuntimeError("no model")
        return "nothing"

    return judge


judge = _judge()


def loop(rows):
    """The rules in words: every request against all that its user has written."""
    held = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        mine = held.setdefault(r["user_id"], [])
        text, action, near, against = r["content"].strip(), r["action"], None, None
        if r["held"]:
            yield r["request_id"], "ignore", r["held"], "", text, None
            continue
        known = [m for table in ("semantic", "episodic") for m in [x for x in mine[::-1] if x[0] == table][:50]]
        if action not in ("ignore", "rank") and text:
            question = plain.Question(text)
            scores = [question.score(plain.Memory(m[0], m[1])) for m in known]
            if scores and max(scores) >= 0.3:
                near = known[scores.index(max(scores))]
                try:
                    said = re.search(r"\{.*\}", judge(text, near[1]["id"], near[1]["content"]))
                    said = json.loads(said[0]) if said else None
                except RuntimeError:
                    said = None
                merged = (said or {}).get("merged_content", "")
                own = set(plain.significant_tokens(text))
                if said and not (merged and len(own & set(plain.significant_tokens(merged))) < math.ceil(len(own) / 2)):
                    action, text = said["action"].strip().lower(), merged or text
                    against = near[1]["id"] if action == "flag_conflict" else None
        family = re.sub(r":chunk-\d+$", "", r["source"])
        same = [m for m in mine if " ".join(m[1]["content"].lower().split()) == " ".join(text.lower().split()) and (m[2] in (r["source"], family) or m[2].startswith(family + ":chunk-"))]
        route = rm.dc.ROUTES[action]
        if text and same:
            yield r["request_id"], "ignore", "dedupe_skip", "", text, None
        elif route in ("ignore", "recall_only"):
            yield r["request_id"], action, route, "", text, None
        else:
            table = {"semantic_upsert": "semantic", "update_with_supersede": "semantic", "conflict_log_and_hold": "episodic" if action == "flag_and_store" else None}.get(route, "episodic")
            if table:
                defaults = {"strength": 0.85 if table == "semantic" else 0.75, "confidence": 0.85 if table == "semantic" else 0.8}
                mine.append((table, {"id": r["request_id"], "content": text, "tags": r["tags"], **defaults} | {c: r[c] for c in rm.FIELDS}, r["source_id"]))
            yield r["request_id"], action, route, table, text, against


def made():
    words = ["likes", "green", "tea", "Melanie", "May", "2023", "running", "cats", "Paris", "conflict", "merge", "badly", "boom"]
    rows = []
    for i in range(260):
        text = " ".join(words[(i * i + 3 * k + i // 7) % len(words)] for k in range(2 + i % 4))
        action = ["store_episodic", "promote_semantic", "ignore", "flag_and_store", "flag_conflict", "decay", "rank"][i % 11 % 7]
        rows.append(request("a" if i % 3 else "b", i, text, action, source=["s", "s:chunk-2", "q"][i % 3], source_id=["s", "s:chunk-2", "q"][i % 3]))
    rows += [request("c", 1, "  "), request("c", 2, "held text", held="grounding_reject"), request("d", 9, "Cats  in Paris"), request("d", 10, "cats in\tparis", source="s:chunk-3"), request("d", 11, "cats in paris", source="z", source_id="z")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in rm.PREPARED.split(", ")) for r in rows], rm.PREPARED)


def seen(df):
    return sorted((r.request_id, r.action, r.route, r.memory_table, r.content, r.conflict_id) for r in df.collect())


def test_table_and_stream_equal_the_loop_and_survive_a_restart(spark, tmp_path):
    rows = made()
    want = sorted(((i, a, r, t or None, c, n) for i, a, r, t, c, n in loop(rows) if i not in ("c-1",)), key=str)
    table = seen(rm.remembered(frame(spark, rows).repartition(6), judge))
    assert [x for x in table if x[0] != "c-1"] == want
    assert {x[2] for x in want} >= {"dedupe_skip", "update_with_supersede", "conflict_log_and_hold", "episodic_insert", "semantic_upsert", "ignore"} and any(x[5] for x in want)
    assert ("c-1", "ignore", "ignore", None, "", None) in table
    # as a stream, in two runs of one checkpoint, the state going on
    rows.sort(key=lambda r: r["seq"])
    for part in (rows[:120], rows[120:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rm.remember_stream(spark.readStream.schema(rm.PREPARED).parquet(f"{tmp_path}/in"), judge)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen(spark.read.schema(rm.OUT).parquet(f"{tmp_path}/out")) == table


def test_embeddings_gate_and_answers(spark):
    known = rm.Known()
    known.write("episodic", {"id": "1", "content": "Melanie likes green tea", "strength": None, "confidence": None, "tags": [], "source_id": "s"})
    near = known.nearest("Melanie likes green tea a lot")
    assert near[0].id == "1" and near[1] > 0.3
    merge = lambda new, i, old: json.dumps({"action": "update_existing", "merged_content": f"{old} {new}"})
    apart, same = (lambda x: [1.0, 0.0] if "lot" in x else [0.0, 1.0]), (lambda x: [1.0, 1.0])
    assert rm._verdict("Melanie likes green tea a lot", near[0], merge, apart) is None
    assert rm._verdict("Melanie likes green tea a lot", near[0], merge, same)[0] == "update_existing"
    assert rm.consolidation("x {\"action\": \" Store_semantic\"} y") == ("promote_semantic", "") and rm.consolidation("{}") is None and rm.consolidation('{"action": 3}') is None and rm.consolidation(None) is None and rm.consolidation('{"action": "odd", "merged_content": 4}') == ("store_episodic", "")
    # half of the new text's own words must survive a merge
    assert rm.retains("alpha beta gamma", "alpha gamma") and not rm.retains("alpha beta gamma", "alpha other") and rm.retains("1 2", "x")
    again = rm.Known(known.packed())
    assert again.packed() == known.packed() and again.nearest("green tea")[0].id == "1"
    for i in range(60):
        again.write("episodic", {"id": f"x{i}", "content": f"word{i} text", "strength": 0.1, "confidence": 0.1, "tags": [], "source_id": None})
    assert len(again.rows["episodic"]) == 50 and again.has_text("melanie likes green  TEA", "s:chunk-4") and not again.has_text("melanie likes green tea", "t")


def test_prepared(spark):
    raw = json.dumps({"action": "store", "memory": {"content": "Ada saw Paris yesterday", "type": "episodic"}, "reasoning": "r"})
    df = spark.createDataFrame([("u", 1, "1", "Ada saw Paris yesterday", raw, "", "2024-05-08"), ("u", 2, "2", "other words here", raw, "", None), ("u", 3, "3", "x", "{", "no", None)], "user_id string, seq int, request_id string, text string, raw string, repaired string, source_timestamp string")
    got = {r.request_id: r for r in rm.prepared(df.withColumn("extra_tags", F.array(F.lit("t"))), "raw", "repaired", "text").collect()}
    assert (got["1"].held, got["1"].resolved_time, got["1"].tags, got["1"].source_id) == (None, "7 May 2024", ["t"], "llm-response")
    assert got["2"].held == "grounding_reject" and got["3"].held == "parse_error_noop"


class State:
    """A group's state, as Spark hands it in."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, n):
        self.timeout = n


def test_idle_state_is_dropped():
    one = lambda seq: iter([pd.DataFrame([request("a", seq, "green tea")])])
    route = lambda out: [r for p in out for r in p["route"]]
    state, fold = State(), rm._fold(judge, None, 500)
    assert route(fold(("a",), one(1), state)) == ["episodic_insert"] and state.timeout == 500
    assert route(fold(("a",), one(2), state)) == ["dedupe_skip"]
    state.hasTimedOut = True
    assert route(fold(("a",), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert route(fold(("a",), one(3), state)) == ["episodic_insert"]


def test_only_memories_in_common_are_scored(monkeypatch):
    """A question meets the memories that share something with it; the others' scores are known."""
    known, seen = rm.Known(), []
    for i in range(80):
        row = {"id": str(i), "content": f"alpha{i} beta{i} gamma{i % 7}", "strength": None, "confidence": i / 80, "tags": ["turn"]}
        known.write(rm.TABLES[i % 2], row | dict.fromkeys(rm.FIELDS))
    plain_scores = lambda text: [plain.Question(text).score(m) for t in rm.TABLES for m in known.memories[t]]
    for text in ("alpha3 of old", "Gamma5 in 2024?", "when was nothing", "turn"):
        assert known.nearest(text)[1] == max(plain_scores(text))
    monkeypatch.setattr(plain.Question, "scored", lambda *a, own=plain.Question.scored: seen.append(a) or own(*a))
    known.nearest("alpha3 of old")
    assert len(seen) == 1


def test_folds_are_not_put_together(spark):
    """Few bytes may be much work: tasks stay as many as cores can use."""
    rows = spark.range(400).selectExpr("cast(id % 50 AS string) AS user_id", "id AS seq", "cast(id AS string) AS request_id", "'x' AS raw", "'' AS repaired", "'a text' AS text")
    assert rm.remembered(rm.prepared(rows, "raw", "repaired", "text")).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
