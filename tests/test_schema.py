"""Validators compiled from schemas: each case is a good row with one thing changed."""

import copy
import json

import pytest

from quarrylight.operators import schema as sc

DECISION = {
    "action": "promote_semantic",
    "memory": {"content": "The user prefers SQLite for local prototypes.", "type": "semantic", "strength": 0.8, "decay_rate": 0.02, "emotional_weight": 0.1, "confidence": 0.9, "tags": ["preference", "sqlite"]},
    "facts": [{"subject": "user", "predicate": "prefers", "value": "SQLite", "confidence": 0.9, "inference_kind": "explicit", "evidence_text": "I prefer SQLite for local prototypes."}],
    "reasoning": "The user stated a durable preference.",
}
ROW = {"id": "row-1", "input": {"conversation": "User: I migrated the cache store to Redis."}, "expected": DECISION, "source": "unit", "split": "train"}
EXAMPLE = {
    "instruction": "Remember.", "input": {"current_turn": {"speaker": "Ada", "text": "x"}},
    "output": {
        "action": "store_episodic", "memory": {"content": "Ada likes tea", "type": "episodic", "strength": 1, "decay_rate": 0, "emotional_weight": 0.5, "confidence": 0.5, "tags": []},
        "facts": [{"subject": "Ada", "predicate": "likes", "value": "tea", "evidence_text": "tea", "inference_kind": "explicit", "confidence": 1}],
        "indexables": [{"kind": "mnemonic", "key": "ada-tea", "target_type": "memory", "reconstructive_hint": "h", "evidence_text": "e", "salience": 0.5, "tags": []}],
        "updates": [], "conflicts": [], "recall": None, "reasoning": "",
    },
}
GONE = object()


def changed(row, path, value):
    row = copy.deepcopy(row)
    at = row
    for key in path[:-1]:
        at = at[key]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return row


def found(spark, rows, make):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "i int, raw string")
    out = sc.judged(df, "raw", make).select("i", "issues").orderBy("i").collect()
    return [[(x.path, x.message) for x in r.issues] for r in out]


CASES = [
    ((), None, []),
    (("action",), "store", [("$.action", "unsupported action: store")]),
    (("action",), GONE, [("$.action", "required non-empty string")]),
    (("action",), 4, [("$.action", "required non-empty string")]),
    (("action",), "ignore", [("$.memory", "ignore decisions must use null memory")]),
    (("memory",), None, [("$.memory", "promote_semantic decisions require memory")]),
    (("memory",), "text", [("$.memory", "memory must be an object or null"), ("$.memory", "promote_semantic decisions require memory")]),
    (("memory", "content"), " \n", [("$.memory.content", "required non-empty string")]),
    (("memory", "type"), "odd", [("$.memory.type", "unsupported memory type: odd")]),
    (("memory", "tags"), ["preference", 42], [("$.memory.tags", "tags must be a list of non-empty strings")]),
    (("memory", "tags"), None, [("$.memory.tags", "tags must be a list of non-empty strings")]),
    (("memory", "tags"), GONE, []),
    (("memory", "strength"), "high", [("$.memory.strength", "must be a finite number when present")]),
    (("memory", "strength"), True, [("$.memory.strength", "must be a finite number when present")]),
    (("memory", "resolved_time"), "", [("$.memory.resolved_time", "must be a non-empty string when present")]),
    (("memory", "resolved_time"), None, []),
    (("facts",), {}, [("$.facts", "facts must be a list")]),
    (("facts",), [3, DECISION["facts"][0]], [("$.facts[0]", "fact must be an object")]),
    (("facts", 0, "evidence_text"), GONE, [("$.facts[0].evidence_text", "required non-empty string")]),
    (("facts", 0, "evidence_text"), "From the Extraction guidance", [("$.facts[0].evidence_text", "evidence text is not from the current turn")]),
    (("facts", 0, "predicate"), "Prefers Database", [("$.facts[0].predicate", "predicate must be snake_case")]),
    (("facts", 0, "inference_kind"), "inferred", [("$.facts[0].inference_kind", "only explicit facts are accepted")]),
    (("facts", 0, "value"), GONE, [("$.facts[0].value", "fact requires value")]),
    (("facts", 0, "value"), None, []),
    (("indexables",), "x", [("$.indexables", "indexables must be a list when present")]),
    (("indexables",), [{"key": "k"}, {"kind": "odd", "key": "k"}, {"kind": "workflow", "key": "k", "steps": ["a", " "]}], [("$.indexables[1].kind", "unsupported indexable kind: odd"), ("$.indexables[2].steps", "steps must be a list of non-empty strings")]),
    (("indexables",), [{"kind": "odd", "steps": 3}, {"kind": 4, "salience": "x", "tags": [1]}, {"kind": " ", "key": "k", "salience": "x", "tags": [1]}], [("$.indexables[0].kind", "unsupported indexable kind: odd"), ("$.indexables[1].kind", sc.PRESENT), ("$.indexables[1].key", "required non-empty string"), ("$.indexables[2].kind", sc.PRESENT), ("$.indexables[2].tags", "tags must be a list of non-empty strings"), ("$.indexables[2].salience", "must be a finite number when present")]),
    (("reasoning",), "", [("$.reasoning", "required non-empty string")]),
    (("confidence",), [], [("$.confidence", "must be a finite number when present")]),
]


def test_decisions_and_training_rows(spark):
    rows = [changed(DECISION, p, v) if p else DECISION for p, v, _ in CASES]
    got = found(spark, [*rows, "not json", "[1]", {}], sc.decision_issues)
    assert got[: len(CASES)] == [want for *_, want in CASES]
    assert got[-3:-1] == [[("$", "invalid JSON")], [("$", "storage decision must be a JSON object")]] and [p for p, _ in got[-1]] == ["$.action", "$.reasoning"]
    # the same as the expected value of training rows
    got = found(spark, [changed(ROW, ("expected",), r) for r in rows], sc.training_issues)
    assert got == [[(p.replace("$", "$.expected"), m) for p, m in want] for *_, want in CASES]


def test_training_rows(spark):
    plan = {"intent": "recall", "target_tables": [], "top_k": 3}
    ask = ROW | {"input": {"operation": "recall_plan", "question": "q?"}}
    cases = [
        (ROW, []), (ROW | {"input": {}}, ["$.input"]), (ROW | {"input": 3}, ["$.input"]), (ROW | {"id": 3}, ["$.id"]), (ROW | {"input": {"conversation": []}}, ["$.input"]), (ROW | {"input": {"conversation": [1]}}, []),
        (ROW | {"split": "dev"}, ["$.split"]), (ROW | {"split": None, "source": " "}, ["$.source"]), (ask | {"expected": plan}, []), (ask | {"expected": plan | {"top_k": 21, "intent": "", "filters": 2}}, ["$.expected"] * 3),
        (ask | {"expected": None}, ["$.expected"]), (ROW | {"task": " recall_plan ", "expected": plan | {"temporal_intent": ""}}, ["$.expected"]), (ROW | {"expected": None}, ["$.expected"]), ("3", ["$"]), ("{", ["$"]),
    ]
    got = found(spark, [r for r, _ in cases], sc.training_issues)
    assert [[p for p, _ in x] for x in got] == [want for _, want in cases]
    assert got[9] == [("$.expected", "intent must be a non-empty string"), ("$.expected", "filters must be an object"), ("$.expected", "top_k must be between 1 and 20")]


@pytest.mark.parametrize(
    ("path", "value", "want"),
    [
        ((), None, []), (("instruction",), " ", ["instruction is required"]), (("input",), [], ["input object is required"]), (("output",), 3, ["output object is required"]),
        (("output", "extra"), 1, ["unexpected output key: extra"]), (("output", "operation"), "x", ["unexpected output key: operation", "legacy output key operation is forbidden"]),
        (("output", "action"), "odd", ["invalid action: odd"]), (("output", "action"), GONE, ["invalid action: undefined"]), (("output", "facts"), None, ["facts must be an array"]), (("output", "reasoning"), 3, ["reasoning must be a string"]),
        (("output", "action"), "ignore", ["ignore action must use memory:null"]), (("output", "memory"), None, ["non-ignore action requires memory object"]),
        (("output", "memory", "content"), "User likes tea", ["memory.content uses generic User even though speaker is known"]), (("output", "memory", "content"), "Previous context: x", ["memory.content leaks wrapper text"]),
        (("output", "memory", "strength"), 1.5, ["memory.strength must be 0..1"]), (("output", "memory", "strength"), GONE, ["memory.strength must be 0..1"]), (("output", "memory", "type"), None, ["invalid memory.type: null"]), (("output", "memory", "tags"), "x", ["memory.tags must be an array"]),
        (("output", "facts", 0, "predicate"), "Likes It", ["facts[0].predicate must be snake_case"]), (("output", "facts", 0), 1, ["facts[0] must be an object"]), (("output", "facts", 0, "inference_kind"), GONE, ["facts[0].inference_kind must be explicit"]),
        (("output", "indexables", 0, "key"), "A b", ["indexables[0].key must be lowercase hyphenated tokens"]), (("output", "indexables", 0, "salience"), "x", ["indexables[0].salience must be 0..1"]),
    ],
)
def test_examples(path, value, want):
    EXAMPLES.append((changed(EXAMPLE, path, value) if path else EXAMPLE, want))


EXAMPLES: list = []


def test_examples_all_at_once(spark):
    recall = changed(changed(EXAMPLE, ("output", "action"), "recall_context"), ("output", "memory"), None)
    EXAMPLES.append((recall, ["recall_context action requires recall object"]))
    EXAMPLES.append((changed(recall, ("output", "recall"), {"query_intent": "q", "selected_memory_ids": [], "selected_indexable_keys": 1, "max_items": -1, "reasoning": "r"}), ["recall.selected_indexable_keys must be an array", "recall.max_items must be a non-negative number"]))
    got = found(spark, [r for r, _ in EXAMPLES], sc.example_issues)
    assert [[m for _, m in x] for x in got] == [w for _, w in EXAMPLES]


def test_gate(spark):
    rows = [ROW, ROW, changed(ROW, ("input",), {}) | {"id": "bad"}, ROW | {"id": "row-2"}]
    got = sc.dataset_gate(spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string"), "raw").first()
    assert (got.total, got.valid, got.actions, got.types, got.tasks, got.duplicates, got.ok) == (4, 3, {"promote_semantic": 3}, {"semantic": 3}, {"storage": 3}, ["row-1"], False)
    assert sc.dataset_gate(spark.createDataFrame([], "raw string"), "raw").first().total == 0
