"""Lean formats of decisions: @tag blocks, compact arrays, minimal and binary lines.

All are column expressions, readers too; only the texts of numbers come from Python. An @tag text is folded line by line with a
state of the open fact block, what was read and the issues; text is not escaped, so a
value ends with its line. Decisions are structs as ``operators.decisions`` makes them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarrylight.operators import schema as sc

#: Tags of the memory's scores and texts, and keys of a fact's lines.
SCORES = {"@s": "strength", "@d": "decay_rate", "@e": "emotional_weight", "@p": "confidence"}
TEXTS = {"@t": "type", "@c": "content", "@te": "temporal_expression", "@rt": "resolved_time"}
FACT = {"sub": "subject", "pred": "predicate", "val": "value", "conf": "confidence", "kind": "inference_kind", "ev": "evidence_text", "fte": "temporal_expression", "frt": "resolved_time"}
MEMORY_TAGS = [*TEXTS, *SCORES, "@g"]
#: What a stored minimal line stands for.
MINIMAL = {"strength": 0.86, "decay_rate": 0.02, "emotional_weight": 0.22, "confidence": 0.92}
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_ENTRY, _ISSUE = "struct<block:int,key:string,value:string>", "struct<path:string,message:string>"


@F.arrow_udf(ArrayType(StringType()))
def _number_texts(xs: pa.Array) -> pa.Array:
    return pa.array([x and [None if v is None else f"{v:g}" for v in x] for x in xs.to_pylist()], pa.list_(pa.string()))


def number_texts(xs: Column) -> Column:
    """``number_text`` of each number of an array. In Python: a double halfway between
    two texts, or next to that, is rounded by its exact value, half to even, but Java
    rounds its decimal digits half up."""
    return F.transform(_number_texts(xs.cast("array<double>")), lambda x: F.coalesce(x, F.lit("")))


def number_text(x: Column) -> Column:
    """Six significant digits without trailing zeros, as ``%g``; empty for null."""
    return F.get(number_texts(F.array(x)), F.lit(0))


def _given(x: Column) -> Column:
    return F.when(x != "", x)


def at_tag(action: Column, memory: Column, facts: Column, reasoning: Column) -> Column:
    """a decision as @tag lines."""
    line = lambda tag, x: F.concat(F.lit(f"{tag} "), x)
    scores = number_texts(F.array(*[memory[c].cast("double") for c in SCORES.values()]))
    body = F.concat_ws(
        "\n", line("@t", memory.type), line("@c", memory.content), *[F.when(memory[c].isNotNull(), line(tag, F.get(scores, F.lit(i)))) for i, (tag, c) in enumerate(SCORES.items())],
        F.when(F.size(memory.tags) > 0, line("@g", F.array_join(memory.tags, " "))), line("@te", _given(memory.temporal_expression)), line("@rt", _given(memory.resolved_time)),
    )
    block = lambda f, confidence: F.concat_ws(
        "\n", F.lit("@f"), F.concat(F.lit("sub="), f.subject), F.concat(F.lit("pred="), f.predicate), F.concat(F.lit("val="), f.value_text), F.concat(F.lit("conf="), confidence),
        F.concat(F.lit("kind="), F.coalesce(_given(f.inference_kind), F.lit("explicit"))), F.concat(F.lit("ev="), f.evidence_text), F.concat(F.lit("fte="), _given(f.temporal_expression)), F.concat(F.lit("frt="), _given(f.resolved_time)), F.lit("@ef"),
    )
    blocks = F.zip_with(facts, number_texts(F.transform(facts, lambda f: f.confidence.cast("double"))), block)
    return F.concat_ws("\n", line("@a", action), F.when(memory.isNull(), F.lit("@m none")).otherwise(body), F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")), line("@r", reasoning), F.lit("@end"))


def compact(action: Column, memory: Column, facts: Column, reasoning: Column) -> Column:
    """a decision as nested JSON arrays, equal as JSON to the reference form."""
    shown = lambda x: F.coalesce(F.to_json(F.struct(x.alias("x"))), F.lit("{}"))
    value = lambda x: F.when(x.isNull(), F.lit("null")).otherwise(F.regexp_replace(shown(x), r'^\{"x":|\}$', ""))
    row = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    tags = F.coalesce(F.to_json(memory.tags), F.lit("[]"))
    own = row(value(memory.type), value(memory.content), *[value(memory[c]) for c in SCORES.values()], tags, value(memory.temporal_expression), value(memory.resolved_time))
    each = F.transform(facts, lambda f: row(value(f.subject), value(f.predicate), value(f.value_text), value(f.confidence), value(F.coalesce(f.inference_kind, F.lit("explicit"))), value(f.evidence_text), value(f.temporal_expression), value(f.resolved_time)))
    return row(value(action), F.when(memory.isNull(), F.lit("null")).otherwise(own), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")), value(reasoning))


def _ignores(action: Column) -> Column:
    return F.lower(F.trim(F.coalesce(_given(action), F.lit("ignore")))).isin("ignore", "ignore_noise")


def minimal(action: Column, content: Column) -> Column:
    """``ignore`` or ``store: text``; null where a store has no text."""
    text = trimmed(F.coalesce(content, F.lit("")))
    return F.when(_ignores(action), "ignore").when(text != "", F.concat(F.lit("store: "), text))


def binary(action: Column) -> Column:
    """``ignore`` or ``store``."""
    return F.when(_ignores(action), "ignore").otherwise("store")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^{_BLANK}+", ""), f"{_BLANK}+$", "")


def lines(text: Column) -> Column:
    """array<struct(no, line)>: the trimmed lines that are not blank, numbered from 1."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), _END, -1), lambda x, i: F.struct((i + 1).alias("no"), trimmed(x).alias("line")))
    return F.filter(every, lambda x: x.line != "")


def parse_minimal(text: Column) -> Column:
    """struct(action, content, issue) of the first line that is not blank."""
    first = F.get(lines(text), F.lit(0)).line
    content = trimmed(F.substring(first, F.lit(7), F.length(first)))
    stores = F.lower(first).startswith("store:")
    return F.struct(
        F.when(first == "ignore", "ignore").when(stores & (content != ""), "store_episodic").alias("action"),
        F.when(stores & (content != ""), content).alias("content"),
        F.when(first.isNull(), "empty minimal output").when(first == "ignore", F.lit(None)).when(stores & (content == ""), "store line missing content").when(~stores, F.concat(F.lit("unsupported minimal line: "), F.substring(first, 1, 80))).alias("issue"),
    )


def parse_binary(text: Column) -> Column:
    """struct(action, issue) of the first line that is not blank."""
    first = F.lower(F.get(lines(text), F.lit(0)).line)
    return F.struct(
        F.when(first == "ignore", "ignore").when(first.startswith("store"), "store_episodic").alias("action"),
        F.when(first.isNull(), "empty binary output").when((first != "ignore") & ~first.startswith("store"), F.concat(F.lit("unsupported binary line: "), F.substring(first, 1, 80))).alias("issue"),
    )


def _after(line: Column, mark: str) -> Column:
    """What follows the first ``mark``; empty if there is none."""
    at = F.position(F.lit(mark), line)
    return F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise("")


def _step(s: Column, x: Column) -> Column:
    """The state after one line: inside (a fact block is open), block (its number),
    closed (numbers of closed blocks), entries and issues."""
    opens, closes = x.line == "@f", x.line == "@ef"
    key, tag = F.substring_index(x.line, "=", 1), F.substring_index(x.line, " ", 1)
    field, value = _after(x.line, "="), _after(x.line, " ")
    plain = ~opens & ~closes
    in_fact = plain & s.inside
    known = (tag.isin("@a", "@r", *MEMORY_TAGS)) | ((tag == "@m") & (value == "none"))
    number = F.when(in_fact & (key == "conf") & (field != ""), field).when(plain & ~s.inside & tag.isin(*SCORES), value)
    where = F.concat(F.lit("$.line["), x.no.cast("string"), F.lit("]"))
    path = F.when(in_fact, F.concat(F.lit("$.facts["), F.size(s.closed).cast("string"), F.lit("].confidence"))).otherwise(F.concat(F.lit("$.memory."), F.try_element_at(F.create_map(*[F.lit(y) for p in SCORES.items() for y in p]), tag)))
    issue = (
        F.when(opens & s.inside, F.struct(where.alias("path"), F.lit("nested fact block").alias("message")))
        .when(closes & ~s.inside, F.struct(where.alias("path"), F.lit("fact block close without open").alias("message")))
        .when(in_fact & ~x.line.contains("="), F.struct(where.alias("path"), F.lit("fact field missing '=' separator").alias("message")))
        .when(in_fact & ~key.isin(*FACT), F.struct(where.alias("path"), F.concat(F.lit("unknown fact field: "), key).alias("message")))
        .when(plain & ~s.inside & ~known, F.struct(where.alias("path"), F.concat(F.lit("unknown tag: "), tag).alias("message")))
        .when(number.isNotNull() & number.try_cast("double").isNull(), F.struct(path.alias("path"), F.lit("must be a number").alias("message")))
        .when(plain & ~s.inside & (tag == "@a") & ~value.isin(*sc.STRICT_ACTIONS), F.struct(F.lit("$.action").alias("path"), F.concat(F.lit("unsupported action: "), value).alias("message")))
    )
    entry = F.when(in_fact & key.isin(*FACT) & x.line.contains("="), F.struct(s.block.alias("block"), key.alias("key"), field.alias("value"))).when(plain & ~s.inside & known, F.struct(F.lit(0).alias("block"), tag.alias("key"), value.alias("value")))
    return F.struct(
        F.when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(s.inside).alias("inside"),
        F.when(opens, s.block + 1).otherwise(s.block).alias("block"),
        F.when(closes & s.inside, F.concat(s.closed, F.array(s.block))).otherwise(s.closed).alias("closed"),
        F.when(entry.isNotNull(), F.concat(s.entries, F.array(entry))).otherwise(s.entries).alias("entries"),
        F.when(issue.isNotNull(), F.concat(s.issues, F.array(issue))).otherwise(s.issues).alias("issues"),
    )


def parse_at_tags(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``decision`` (JSON of action, memory, facts, reasoning; null
    if anything is wrong) and ``issues``, those of the lines, then of the schema."""
    empty = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("block"), F.array().cast("array<int>").alias("closed"), F.array().cast(f"array<{_ENTRY}>").alias("entries"), F.array().cast(f"array<{_ISSUE}>").alias("issues"))
    found = lines(F.col(text))
    end = F.array_position(F.transform(found, lambda x: x.line), "@end")
    out = df.withColumn("_lines", F.when(end > 0, F.slice(found, F.lit(1), (end - 1).cast("int"))).otherwise(found)).withColumn("_s", F.aggregate("_lines", empty, _step))
    e = F.col("_s.entries")
    none = F.array_position(F.transform(F.reverse(e), lambda x: x.key), "@m").cast("int")  # from the end; 0: none
    held = F.when(none > 0, F.slice(e, F.size(e) - none + 2, none - 1)).otherwise(e)
    own = F.filter(held, lambda x: (x.block == 0) & x.key.isin(*MEMORY_TAGS))
    last = lambda entries, key, block=0: F.get(F.reverse(F.filter(entries, lambda x: (x.block == block) & (x.key == key))), F.lit(0)).value
    memory = F.struct(*[last(own, tag).alias(c) for tag, c in TEXTS.items()], *[last(own, tag).try_cast("double").alias(c) for tag, c in SCORES.items()], F.filter(F.split(last(own, "@g"), " "), lambda x: x != "").alias("tags"))
    memory = F.when((none > 0) & (F.size(own) == 0), F.lit(None)).otherwise(memory)
    fact = lambda b: F.struct(*[(last(e, k, b).try_cast("double") if k == "conf" else last(e, k, b)).alias(c) for k, c in FACT.items()])
    decision = F.struct(last(e, "@a").alias("action"), memory.alias("memory"), F.transform(F.col("_s.closed"), fact).alias("facts"), last(e, "@r").alias("reasoning"))
    out = out.withColumn("_d", F.to_json(decision)).withColumn("_v", F.try_parse_json("_d"))
    open_ = F.when(F.col("_s.inside"), F.array(F.struct(F.lit("$.facts").alias("path"), F.lit("unclosed fact block").alias("message")))).otherwise(F.array().cast(f"array<{_ISSUE}>"))
    out = out.withColumn("issues", F.concat("_s.issues", open_, sc.decision_issues(F.col("_v"))))
    return out.withColumn("decision", F.when(F.size("issues") == 0, F.col("_d"))).drop("_lines", "_s", "_d", "_v")
