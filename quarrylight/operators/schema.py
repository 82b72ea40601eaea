"""Validators of nested JSON, compiled from declared schemas to column expressions.

A schema is a tree of the rules below. ``compiled`` turns it into one expression over
a VARIANT that gives the issues of a row, in the order of the declaration, as
array<struct(path, message)>; lists are walked by ``transform``, so paths have their
indexes, and nothing leaves the JVM. In messages ``{at}`` stands for the path and
``{value}`` for the value. A key that is absent and one that is null differ only
where a rule says so."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.decisions import BAD_EVIDENCE, STRICT_ACTIONS

ISSUES = "array<struct<path:string,message:string>>"
PRESENT = "must be a non-empty string when present"


@dataclass(frozen=True)
class Text:
    """A text that is not blank. ``one_of``: allowed values, else ``other``;
    ``pattern``: what a good value matches, else ``mismatch``; ``not_like``: what it
    must not contain in any case, else ``unlike``."""

    message: str = "required non-empty string"
    optional: bool = False
    blank_ok: bool = False
    one_of: tuple[str, ...] = ()
    other: str = ""
    pattern: str = ""
    mismatch: str = ""
    not_like: str = ""
    unlike: str = ""


@dataclass(frozen=True)
class Number:
    """A number, within ``least`` and ``most`` if they are given."""

    message: str = "must be a finite number when present"
    optional: bool = True
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Present:
    """Any value, null included."""

    message: str


@dataclass(frozen=True)
class Listed:
    """A list; of texts that are not blank (``texts``), or of ``of``."""

    message: str
    optional: bool = False
    null_ok: bool = True
    texts: bool = False
    of: Obj | None = None


@dataclass(frozen=True)
class Obj:
    """An object. ``checks``: functions of a getter and the path that give (bad,
    path, message); ``only``: the message for keys that are not declared; ``after``:
    the key after whose rule the checks come (else last). ``stops``: keys of which an
    issue that begins so ends the object, as what follows would only repeat it."""

    fields: dict[str, object]
    message: str
    nullable: bool = False
    only: str = ""
    known: tuple[str, ...] = ()
    checks: tuple[Callable, ...] = ()
    after: str = ""
    stops: tuple[tuple[str, str], ...] = ()


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def absent(v: Column) -> Column:
    """No such key, or null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def as_text(v: Column) -> Column:
    """The value of a text, null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_number(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def below(path: Column | None, key: str) -> Column:
    return F.lit(key) if path is None else F.concat(path, F.lit(f".{key}"))


def issue(bad: Column, path: Column | None, message: str, value: Column | None = None) -> Column:
    """An array of the issue, or an empty one."""
    at = F.lit("") if path is None else path
    shown = F.lit("undefined") if value is None else F.when(value.isNull(), "undefined").when(F.is_variant_null(value), "null").otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
    parts = [at if p == "{at}" else shown if p == "{value}" else F.lit(p) for p in re.split(r"(\{at\}|\{value\})", message) if p]
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("path"), F.concat(*parts).alias("message")))).otherwise(F.array().cast(ISSUES))


def _begins(start: str) -> Callable[[Column], Column]:
    return lambda x: x.message.startswith(start)


def compiled(rule: object, v: Column, path: Column | None) -> Column:
    """The issues of the value ``v`` at ``path`` (None: no path)."""
    match rule:
        case Text():
            text = as_text(v)
            usable = text.isNotNull() if rule.blank_ok else ~blank(text)
            bad = ~usable if not rule.optional else ~absent(v) & ~usable
            found = [issue(bad, path, rule.message, v)] if rule.message else []
            if rule.one_of:
                known = F.coalesce(text.isin(*rule.one_of), F.lit(False))
                found.append(issue(usable & ~known if rule.message else ~known, path, rule.other, v))
            if rule.pattern:
                matches = F.coalesce(text.rlike(rule.pattern), F.lit(False))
                found.append(issue(usable & ~matches if rule.message and "required" not in rule.mismatch else ~matches, path, rule.mismatch, v))
            if rule.not_like:
                found.append(issue(usable & F.lower(text).rlike(rule.not_like), path, rule.unlike, v))
            return F.concat(*found)
        case Number():
            n = as_number(v)
            bad = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
            for edge, beyond in ((rule.least, lambda: n < rule.least), (rule.most, lambda: n > rule.most)):
                bad = bad | beyond() if edge is not None else bad
            return issue(~absent(v) & bad if rule.optional else bad, path, rule.message, v)
        case Present():
            return issue(v.isNull(), path, rule.message)
        case Listed():
            rows = as_list(v)
            missing = absent(v) if rule.null_ok else v.isNull()
            bad = rows.isNull() if not rule.optional else ~missing & rows.isNull()
            if rule.texts:
                bad = bad | F.coalesce(F.exists(rows, lambda x: blank(as_text(x))), F.lit(False))
            found = issue(bad, path, rule.message)
            if rule.of is None:
                return found
            each = F.transform(F.coalesce(rows, F.array().cast("array<variant>")), lambda x, i: compiled(rule.of, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.concat(found, F.flatten(each))
        case Obj():
            inner = []
            checks = [issue(*c) for make in rule.checks for c in make(lambda k: get(v, k), path)]
            if rule.only:
                extra = F.filter(F.map_keys(as_object(v)), lambda k: ~k.isin(*rule.fields, *rule.known))
                inner.append((F.transform(extra, lambda k: F.struct((F.lit("") if path is None else path).alias("path"), F.concat(F.lit(rule.only), k).alias("message"))), None))
            stops = dict(rule.stops)
            for key, own in rule.fields.items():
                inner.append((compiled(own, get(v, key), below(path, key)), stops.get(key)))
                if key == rule.after:
                    inner += [(c, None) for c in checks]
            inner += [] if rule.after else [(c, None) for c in checks]
            told = F.array().cast(ISSUES)
            for found, stop in reversed(inner):
                if stop is not None:
                    told = F.when(F.exists(found, _begins(stop)), F.array().cast(ISSUES)).otherwise(told)
                told = F.concat(found, told)
            whole = as_object(v).isNotNull()
            bad = ~whole & ~absent(v) if rule.nullable else ~whole
            return F.when(whole, told).otherwise(issue(bad, path, rule.message, v))
    raise TypeError(rule)


def judged(df: DataFrame, raw: str, issues: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``parsed``, the JSON text ``raw`` parsed once (null if it is none),
    and its ``issues``."""
    return df.withColumn("parsed", F.try_parse_json(raw)).withColumn("issues", issues(F.col("parsed")))


def decision_issues(v: Column) -> Column:
    """the issues of a storage decision."""
    return F.when(v.isNull(), issue(F.lit(True), F.lit("$"), "invalid JSON")).otherwise(compiled(DECISION, v, F.lit("$")))


_OPTIONAL = Text(PRESENT, optional=True)
_LISTED = Listed("tags must be a list of non-empty strings", optional=True, texts=True)
SNAKE = "^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"


def _memory_fits(get_: Callable, path: Column | None) -> list[tuple]:
    action, memory = as_text(get_("action")), get_("memory")
    has = as_object(memory).isNotNull()
    return [
        (has & (action == "ignore"), below(path, "memory"), "ignore decisions must use null memory"),
        (~has & ~blank(action) & (action != "ignore"), below(path, "memory"), "{value} decisions require memory", get_("action")),
    ]


MEMORY = Obj(
    {"content": Text(), "type": Text(one_of=("episodic", "semantic"), other="unsupported memory type: {value}"), "tags": Listed("tags must be a list of non-empty strings", optional=True, null_ok=False, texts=True)}
    | dict.fromkeys(("strength", "decay_rate", "emotional_weight", "confidence"), Number()) | dict.fromkeys(("temporal_expression", "resolved_time"), _OPTIONAL) | {"resolved_time_confidence": Number()},
    "memory must be an object or null", nullable=True,
)
FACT = Obj(
    {"subject": Text(), "predicate": Text(pattern=SNAKE, mismatch="predicate must be snake_case"), "value": Present("fact requires value"), "inference_kind": Text(one_of=("explicit",), other="only explicit facts are accepted")}
    | {"evidence_text": Text(not_like=BAD_EVIDENCE, unlike="evidence text is not from the current turn"), "confidence": Number()}
    | dict.fromkeys(("object", "value_text", "fact_type", "temporal_expression", "resolved_time"), _OPTIONAL) | {"resolved_time_confidence": Number()},
    "fact must be an object",
)
INDEXABLE = Obj(
    {"kind": Text(PRESENT, optional=True, one_of=("mnemonic", "fact_anchor", "workflow"), other="unsupported indexable kind: {value}"), "key": Text(), "steps": Listed("steps must be a list of non-empty strings", optional=True, texts=True), "tags": _LISTED}
    | dict.fromkeys(("target_memory_table", "target_memory_id"), _OPTIONAL) | {"salience": Number()} | dict.fromkeys(("reconstructive_hint", "evidence_text"), _OPTIONAL),
    "indexable must be an object", stops=(("kind", "unsupported"), ("key", "")),
)
#: A storage decision.
DECISION = Obj(
    {"action": Text(one_of=tuple(STRICT_ACTIONS), other="unsupported action: {value}"), "memory": MEMORY, "facts": Listed("facts must be a list", optional=True, null_ok=False, of=FACT)}
    | {"indexables": Listed("indexables must be a list when present", optional=True, of=INDEXABLE), "reasoning": Text()} | dict.fromkeys(("confidence", "emotional_weight", "contradiction_score"), Number()),
    "storage decision must be a JSON object", checks=(_memory_fits,), after="memory",
)
#: A recall plan, as the expected value of a training row: issues have no path of their own.
PLAN = Obj(
    {"intent": Text("intent must be a non-empty string"), "filters": Obj({}, "filters must be an object", nullable=True), "temporal_intent": Text(f"temporal_intent {PRESENT}", optional=True)},
    "expected object", checks=(lambda get_, path: [(~F.coalesce(F.floor(as_number(get_("top_k"))), F.lit(5)).between(1, 20), path, "top_k must be between 1 and 20")],),
)
PROMPTS = ("conversation", "source", "context", "prompt", "question", "user_prompt")


def _prompted(get_: Callable, path: Column | None) -> list[tuple]:
    given = F.coalesce(F.size(as_list(get_("conversation"))) > 0, F.lit(False))
    for key in PROMPTS:
        given = given | ~blank(as_text(get_(key)))
    return [(~given, path, "input must include conversation, question, user_prompt, source, context, or prompt")]


def task_of(v: Column) -> Column:
    """The task that a row names, or its input's operation implies."""
    named, operation = as_text(get(v, "task")), as_text(F.try_variant_get(v, "$.input.operation", "variant"))
    return F.when(~blank(named), F.trim(named)).when(operation.isin("recall_plan", "context_plan", "consolidate"), operation).otherwise("storage")


def training_issues(v: Column) -> Column:
    """the issues of a training row of the form id, task, input, expected."""
    root = F.lit("$")
    head = Obj({"id": Text(), "input": Obj({}, "input must be an object", checks=(_prompted,))}, "training row must be a JSON object")
    tail = Obj({"source": _OPTIONAL, "split": Text(PRESENT, optional=True, one_of=("train", "validation", "test", "probe"), other="split must be train, validation, test, or probe")}, "")
    expected = get(v, "expected")
    plan = F.transform(compiled(PLAN, expected, F.lit("$.expected")), lambda x: F.struct(F.lit("$.expected").alias("path"), x.message.alias("message")))
    body = F.when(task_of(v) == "storage", compiled(DECISION, expected, F.lit("$.expected"))).otherwise(plan)
    whole = as_object(v).isNotNull()
    return F.when(v.isNull(), issue(F.lit(True), root, "invalid JSON")).when(~whole, issue(F.lit(True), root, head.message)).otherwise(F.concat(compiled(head, v, root), body, compiled(tail, v, root)))


_UNIT = {"least": 0.0, "most": 1.0, "optional": False, "message": "{at} must be 0..1"}
_NEEDED = Text("{at} is required")


def _example_checks(get_: Callable, path: Column | None) -> list[tuple]:
    out, speaker = get_("output"), as_text(F.try_variant_get(get_("input"), "$.current_turn.speaker", "variant"))
    action, memory = as_text(get(out, "action")), get(out, "memory")
    quiet = F.coalesce(action.isin("ignore", "recall_context"), F.lit(False))
    content = as_text(get(memory, "content"))
    has = as_object(memory).isNotNull() & ~quiet
    return [
        (quiet & (memory.isNull() | ~F.is_variant_null(memory)), F.lit("memory"), "{value} action must use memory:null", get(out, "action")),
        (~quiet & as_object(out).isNotNull() & as_object(memory).isNull(), F.lit("memory"), "non-ignore action requires memory object"),
        (has & content.rlike(r"^\s*User(?![A-Za-z0-9_])") & (speaker != "") & (speaker != "User"), F.lit("memory.content"), "memory.content uses generic User even though speaker is known"),
        (has & (content.contains("Current utterance:") | content.contains("Previous context:")), F.lit("memory.content"), "memory.content leaks wrapper text"),
    ]


_ROWS = {
    "facts": Obj(dict.fromkeys(("subject", "value", "evidence_text"), _NEEDED) | {"predicate": Text("{at} is required", pattern="^[a-z][a-z0-9_]*$", mismatch="{at} must be snake_case"), "inference_kind": Text("", one_of=("explicit",), other="{at} must be explicit"), "confidence": Number(**_UNIT)}, "{at} must be an object"),
    "indexables": Obj(dict.fromkeys(("kind", "target_type", "reconstructive_hint", "evidence_text"), _NEEDED) | {"key": Text("{at} is required", pattern="^[a-z0-9]+(?:-[a-z0-9]+)*$", mismatch="{at} must be lowercase hyphenated tokens"), "salience": Number(**_UNIT), "tags": Listed("{at} must be an array")}, "{at} must be an object"),
}
_OUTPUT = Obj(
    {"action": Text("", one_of=(*STRICT_ACTIONS, "recall_context"), other="invalid action: {value}")} | {k: Listed("{at} must be an array", null_ok=False, of=_ROWS.get(k)) for k in ("facts", "indexables", "updates", "conflicts")} | {"reasoning": Text("reasoning must be a string", blank_ok=True)},
    "output object is required", only="unexpected output key: ", known=("memory", "recall"),
    checks=(lambda get_, path: [(get_(k).isNotNull(), F.lit(k), f"legacy output key {k} is forbidden") for k in ("operation", "assistant_response")],),
)
_EXAMPLE_MEMORY = Obj({"content": _NEEDED, "type": Text("", one_of=("episodic", "semantic"), other="invalid memory.type: {value}")} | dict.fromkeys(("strength", "decay_rate", "emotional_weight", "confidence"), Number(**_UNIT)) | {"tags": Listed("{at} must be an array")}, "")
_EXAMPLE_RECALL = Obj({"query_intent": _NEEDED, "selected_memory_ids": Listed("{at} must be an array"), "selected_indexable_keys": Listed("{at} must be an array"), "max_items": Number("{at} must be a non-negative number", False, 0.0), "reasoning": _NEEDED}, "recall_context action requires recall object")


def example_issues(v: Column) -> Column:
    """the issues of a row of the form instruction, input, output. Messages name
    their place; they come object by object, as declared."""
    out = get(v, "output")
    action, none = as_text(get(out, "action")), F.array().cast(ISSUES)
    quiet = F.coalesce(action.isin("ignore", "recall_context"), F.lit(False))
    stored = as_object(get(out, "memory")).isNotNull() & ~quiet
    row = Obj({"instruction": Text("instruction is required"), "input": Obj({}, "input object is required")}, "")
    body = F.concat(
        compiled(_OUTPUT, out, None),
        F.flatten(F.array(*[issue(*c) for c in _example_checks(lambda k: get(v, k), None)])),
        F.when(stored, compiled(_EXAMPLE_MEMORY, get(out, "memory"), F.lit("memory"))).otherwise(none),
        F.when(action == "recall_context", compiled(_EXAMPLE_RECALL, get(out, "recall"), F.lit("recall"))).otherwise(none),
    )
    parts = F.concat(compiled(row, v, None), F.when(as_object(out).isNotNull(), body).otherwise(compiled(_OUTPUT, out, None)))
    return F.when(v.isNull(), issue(F.lit(True), None, "invalid JSONL row")).when(as_object(v).isNull(), issue(F.lit(True), None, "row must be an object")).otherwise(parts)


def dataset_gate(rows: DataFrame, raw: str) -> DataFrame:
    """A4: one row: total, valid, the counts of valid rows by action, memory type and
    task as maps, duplicate ids (of valid rows, a repeated id once, in order), and ok."""
    v = F.col("parsed")
    text = lambda p: as_text(F.try_variant_get(v, p, "variant"))
    seen = judged(rows, raw, training_issues).select((F.size("issues") == 0).alias("valid"), text("$.id").alias("id"), text("$.expected.action").alias("action"), text("$.expected.memory.type").alias("type"), task_of(v).alias("task"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("action", "type", "task", "id")])
    counts = seen.filter("valid").select(F.explode(kinds).alias("x")).filter("x.value IS NOT NULL").groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    kept = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("kind") == kind), F.struct("value", "n")))))
    # ids that come once are dropped before anything is gathered
    maps = counts.filter("kind != 'id' OR n > 1").agg(kept("action").alias("actions"), kept("type").alias("types"), kept("task").alias("tasks"), F.sort_array(F.collect_list(F.when(F.col("kind") == "id", F.col("value")))).alias("duplicates"))
    totals = seen.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"))
    return totals.join(maps, F.lit(True)).select("total", "valid", "actions", "types", "tasks", "duplicates", ((F.col("total") == F.col("valid")) & (F.size("duplicates") == 0)).alias("ok"))
