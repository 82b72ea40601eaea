"""The tagged line format of decisions: encoding, strict parsing, lenient repair.

Encoding is native. Parsing folds lines into a record by a table of tags; it has
no native form and runs on Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.decisions import STRICT_ACTIONS

SCORES = ("strength", "decay_rate", "emotional_weight", "confidence")
SNAKE, NUMBER = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*"), re.compile(r"-?\d*\.?\d+(?:[eE]-?\d+)?")
#: The escapes of the format.
ESCAPES = {"n": "\n", "p": "|", "c": ","}
#: Fixed value: what is stored where nothing can be saved.
FAILSAFE = {"action": "ignore", "memory": None, "facts": [], "indexables": [], "reasoning": "Model output unparseable; storing nothing."}


def escaped(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("|", "\\p"), (",", "\\c")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), x, flags=re.S)


def encoded(action: Column, memory: Column, facts: Column, reasoning: Column) -> Column:
    """A decision as tagged lines, END last. ``memory``: a struct with type,
    content, scores, tags and temporal fields, or null."""
    def number(c: Column) -> Column:
        return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(""))

    def optional(tag: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}:"), escaped(c)))

    body = F.concat_ws(
        "\n", F.concat(F.lit("T:"), memory.type), F.concat(F.lit("C:"), escaped(memory.content)), F.concat(F.lit("Q:"), F.concat_ws(",", *[number(memory[s]) for s in SCORES])),
        F.when(F.size(memory.tags) > 0, F.concat(F.lit("G:"), F.array_join(F.transform(memory.tags, escaped), ","))), optional("TE", memory.temporal_expression), optional("RT", memory.resolved_time),
    )
    lines = F.transform(facts, lambda f: F.concat(F.lit("F:"), F.concat_ws("|", escaped(f.subject), escaped(f.predicate), escaped(f.value_text), number(f.confidence), F.coalesce(f.inference_kind, F.lit("explicit")), escaped(f.evidence_text))))
    return F.concat_ws("\n", F.concat(F.lit("A:"), action), F.when(memory.isNull(), F.lit("M:-")).otherwise(body), F.when(F.size(lines) > 0, F.array_join(lines, "\n")), F.concat(F.lit("R:"), escaped(reasoning)), F.lit("END"))


class _Reader:
    """One pass over the lines; ``lenient`` mends or drops, else problems are issues."""

    def __init__(self, lenient: bool):
        self.lenient, self.notes = lenient, []
        self.action, self.memory, self.none, self.reasoning = None, None, False, None
        self.facts, self.indexables = [], []

    def field(self, name: str, value) -> None:
        self.memory = {**(self.memory or {}), name: value}

    def number(self, raw: str, label: str) -> float | None:
        try:
            return float(raw)
        except ValueError:
            found = NUMBER.search(raw) if self.lenient else None
            self.notes.append(("coerced_" if found else "dropped_" if self.lenient else "bad_number_") + label)
            return float(found[0]) if found else None

    def fact(self, value: str) -> None:
        parts = value.split("|", 5) if self.lenient else value.split("|")
        if len(parts) != 6:
            self.notes.append("dropped_malformed_fact")
            return
        subject, predicate, what, confidence, kind, evidence = map(unescape, parts)
        if self.lenient:
            if not SNAKE.fullmatch(predicate):
                predicate = re.sub(r"[^a-z0-9]+", "_", predicate.lower()).strip("_")
                if SNAKE.fullmatch(predicate):
                    self.notes.append("snake_cased_predicate")
            if not (subject.strip() and what.strip() and evidence.strip() and SNAKE.fullmatch(predicate)):
                self.notes.append("dropped_malformed_fact")
                return
            if kind != "explicit":
                self.notes.append("forced_explicit_kind")
                kind = "explicit"
        score = self.number(confidence, "fact_confidence") if confidence.strip() else None
        self.facts.append({"subject": subject, "predicate": predicate, "value": what, "confidence": score, "inference_kind": kind, "evidence_text": evidence})

    def scores(self, value: str) -> None:
        parts = value.split(",")
        if len(parts) > 4:
            self.notes.append("truncated_q_quad") if self.lenient else None
        for name, raw in zip(SCORES, parts):
            if raw.strip() and (n := self.number(raw.strip(), f"q_{name}")) is not None:
                self.field(name, n)

    def kind(self, value: str) -> None:
        if value.strip() in ("episodic", "semantic"):
            self.field("type", value.strip())
        else:
            self.notes.append("dropped_bad_memory_type")

    def indexable(self, value: str) -> None:
        if not self.lenient:  # repair drops these lines
            self.indexables.append([unescape(p) for p in value.split("|")])

    def tags(self) -> dict[str, Callable[[str], None]]:
        return {
            "A": lambda v: setattr(self, "action", v.strip() if v.strip() in STRICT_ACTIONS else self.action),
            "M": lambda v: setattr(self, "none", v.strip() == "-"),
            "T": self.kind,
            "C": lambda v: self.field("content", unescape(v)) if v.strip() else None,
            "Q": self.scores,
            "G": lambda v: self.field("tags", [unescape(x) for x in v.split(",") if x.strip()]),
            "TE": lambda v: self.field("temporal_expression", unescape(v)),
            "RT": lambda v: self.field("resolved_time", unescape(v)),
            "F": self.fact,
            "X": self.indexable,
            "R": lambda v: setattr(self, "reasoning", unescape(v) if v.strip() else self.reasoning),
        }

    def read(self, text: str) -> dict:
        known = self.tags()
        for line in filter(None, (x.strip() for x in text.splitlines())):
            if line == "END":
                break
            tag, colon, value = line.partition(":")
            if not colon:
                self.notes.append("dropped_untagged_line")
            elif tag not in known or (tag == "X" and self.lenient):
                self.notes.append("dropped_unknown_tag")
            else:
                known[tag](value)
        if self.none:
            self.memory = None
        return {"action": self.action, "memory": self.memory, "facts": self.facts, "indexables": self.indexables, "reasoning": self.reasoning}


def problems(d: dict) -> list[str]:
    """What a strict decision may not have."""
    m, out = d["memory"], []
    if d["action"] not in STRICT_ACTIONS:
        out.append("$.action")
    if m is None and d["action"] not in ("ignore", "flag_conflict", None):
        out.append("$.memory")
    if m is not None:
        out += [f"$.memory.{k}" for k in ("type", "content") if not str(m.get(k) or "").strip()]
        out += [f"$.memory.{k}" for k in SCORES if not 0 <= m.get(k, 0) <= 1]
        if d["action"] == "ignore":
            out.append("$.memory")
    out += ["$.facts.predicate" for f in d["facts"] if not SNAKE.fullmatch(f["predicate"])]
    if not (d["reasoning"] or "").strip():
        out.append("$.reasoning")
    return out


def repaired(text: str) -> tuple[str, dict, list[str]]:
    """(status, decision, repairs): parsed, repaired or failed_safe."""
    strict = _Reader(False)
    d = strict.read(text or "")
    if not strict.notes and not problems(d):
        return "parsed", d, []
    reader = _Reader(True)
    d = reader.read(text or "")
    notes = reader.notes
    if d["reasoning"] is None:
        content = (d["memory"] or {}).get("content")
        if content:
            d["reasoning"] = f"Stored: {content}"
            notes.append("synthesized_reasoning_from_content")
        elif d["action"] == "ignore":
            d["reasoning"] = "Nothing durable to store."
            notes.append("synthesized_reasoning_generic")
    if d["action"] == "ignore" and d["memory"] is not None:
        d["memory"] = None
        notes.append("cleared_ignore_memory")
    return ("failed_safe", dict(FAILSAFE), notes) if problems(d) else ("repaired", d, notes)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [repaired(x) for x in batch.column("x").to_pylist()]
        yield pa.record_batch(
            [batch.column("k"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1]["action"] for f in found], pa.string()), pa.array([json.dumps(f[1], sort_keys=True) for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.string()))],
            ["key", "status", "action", "decision", "repairs"],
        )


def repair_decisions(df: DataFrame, key: Column, text: str) -> DataFrame:
    """(key, status, action, decision as JSON, repairs) of each row."""
    return df.select(key.cast("string").alias("k"), F.col(text).alias("x")).mapInArrow(_scan, "key string, status string, action string, decision string, repairs array<string>")


def complete_objects(text: str) -> list[str]:
    """the complete JSON objects of a text, by brace depth outside strings."""
    out, depth, start, quoted, skip = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out
