"""Storage decisions: parsing, validation, guards and routing.

Model output is an input column; parsing is ``from_json`` in permissive mode
with the repairs of the contract as expressions on arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as t

FACT = "struct<subject:string,predicate:string,object:string,value:string,value_text:string,fact_type:string,confidence:double,inference_kind:string,evidence_text:string,temporal_expression:string,resolved_time:string,resolved_time_confidence:double>"
INDEXABLE = "struct<kind:string,key:string,target_memory_table:string,target_memory_id:string,steps:array<string>,salience:double,reconstructive_hint:string,evidence_text:string,tags:array<string>>"
MEMORY = "struct<content:string,type:string,strength:double,decay_rate:double,emotional_weight:double,confidence:double,tags:array<string>,source_episodes:array<string>,source_kind:string,source_id:string,source_timestamp:string,source_label:string,temporal_expression:string,resolved_time:string,resolved_time_confidence:double>"
DECISION = f"struct<action:string,memory:string,facts:array<{FACT}>,indexables:array<{INDEXABLE}>,reasoning:string,confidence:double,emotional_weight:double,contradiction_score:double,_corrupt_record:string>"
PLAN = "struct<intent:string,target_tables:array<string>,filters:map<string,string>,ranking_hints:array<string>,temporal_intent:string,top_k:string,_corrupt_record:string>"

#: Action aliases and the routes of actions.
ALIASES = {"ignore_noise": "ignore", "store_semantic": "promote_semantic", "recall_weighting": "rank"}
ROUTES = {
    "ignore": "ignore", "rank": "recall_only", "promote": "semantic_upsert", "promote_semantic": "semantic_upsert", "update": "update_with_supersede", "update_existing": "update_with_supersede",
    "decay": "decay_existing_then_insert", "decay_and_update": "decay_existing_then_insert", "flag_conflict": "conflict_log_and_hold", "flag_and_store": "conflict_log_and_hold",
    "flag_and_update": "conflict_log_and_hold", "detect_interference": "conflict_log_and_hold", "store": "episodic_insert", "store_episodic": "episodic_insert",
}
#: What each route writes to.
TARGETS = {"ignore": [], "recall_only": [], "semantic_upsert": ["semantic"], "update_with_supersede": ["semantic"], "decay_existing_then_insert": ["decay_schedule", "episodic"], "conflict_log_and_hold": ["conflicts"], "episodic_insert": ["episodic"]}
#: Subjects and evidence that make a fact worthless.
GENERIC_SUBJECTS = ["person", "conversation context", "context", "current conversation", "current turn"]
BAD_EVIDENCE = "benchmark dataset|conversation-memory input|extraction guidance|current turn to remember|previous context|source id:"
#: Strict schema vocabulary.
STRICT_ACTIONS = ["ignore", "store_episodic", "promote_semantic", "update_existing", "flag_conflict", "flag_and_store"]


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_action(x: Column | str) -> Column:
    """Aliases resolved, anything unknown stored as an episode."""
    v = F.lower(t.strip(F.coalesce(t.col(x).cast("string"), F.lit(""))))
    v = F.coalesce(F.try_element_at(_map(ALIASES), v), v)
    return F.when(v.isin(*ROUTES), v).otherwise("store_episodic")


def route(action: Column | str) -> Column:
    """C2."""
    return F.coalesce(F.try_element_at(_map(ROUTES), t.col(action)), F.lit("episodic_insert"))


def action_of_operation(x: Column | str) -> Column:
    """The first word that an operation's name holds."""
    v = F.lower(t.col(x))
    has = v.contains
    return (
        F.when(has("ignore"), "ignore").when(has("interference") | has("conflict"), "detect_interference").when(has("promote"), "promote").when(has("update"), "update_existing")
        .when(has("rank") | has("recall"), "rank").when(has("decay"), "decay").otherwise("store_episodic")
    )


def _some(x: Column) -> Column:
    """The text if it holds more than blanks, else null."""
    return F.when(t.strip(x) != "", x)


def clean_facts(facts: Column) -> Column:
    """normalised facts that have all they need."""
    facts = F.coalesce(facts, F.array().cast(f"array<{FACT}>"))
    made = F.transform(
        facts,
        lambda f: F.struct(
            _some(f.subject).alias("subject"), t.predicate(_some(f.predicate)).alias("predicate"), _some(f.object).alias("object"), F.coalesce(_some(f.value_text), _some(f.value)).alias("value_text"), _some(f.fact_type).alias("fact_type"),
            f.confidence.alias("confidence"), F.coalesce(_some(f.inference_kind), F.lit("explicit")).alias("inference_kind"), _some(f.evidence_text).alias("evidence_text"),
            _some(f.temporal_expression).alias("temporal_expression"), _some(f.resolved_time).alias("resolved_time"), f.resolved_time_confidence.alias("resolved_time_confidence"),
        ),
    )
    return F.filter(
        made,
        lambda f: f.subject.isNotNull() & f.predicate.isNotNull() & f.value_text.isNotNull() & f.evidence_text.isNotNull() & ~F.lower(t.strip(f.subject)).isin(GENERIC_SUBJECTS) & (f.inference_kind == "explicit") & ~F.lower(f.evidence_text).rlike(BAD_EVIDENCE),
    )


def clean_indexables(rows: Column) -> Column:
    """known kinds with a key."""
    rows = F.coalesce(rows, F.array().cast(f"array<{INDEXABLE}>"))
    made = F.transform(
        rows,
        lambda r: F.struct(
            F.lower(t.strip(r.kind)).alias("kind"), t.slug(r.key, keep="a-z0-9-").alias("key"), _some(r.target_memory_table).alias("target_memory_table"), _some(r.target_memory_id).alias("target_memory_id"),
            F.filter(F.transform(r.steps, t.strip), lambda x: x != "").alias("steps"), r.salience.alias("salience"), _some(r.reconstructive_hint).alias("reconstructive_hint"), _some(r.evidence_text).alias("evidence_text"), F.filter(F.transform(r.tags, t.strip), lambda x: x != "").alias("tags"),
        ),
    )
    return F.filter(made, lambda r: r.kind.isin("mnemonic", "fact_anchor", "workflow") & (F.coalesce(r.key, F.lit("")) != ""))


def broken(raw: Column | str) -> Column:
    """a text that holds no JSON object of a decision."""
    body = F.coalesce(t.json_object(raw), t.strip(raw))
    p = F.from_json(body, DECISION, {"mode": "PERMISSIVE"})
    return p.isNull() | p["_corrupt_record"].isNotNull() | ~body.startswith("{")


def parse_decision(df: DataFrame, raw: str, fallback: str) -> DataFrame:
    """adds action, memory, facts, indexables, reasoning, confidence and
    parse_error. Text that is no JSON object becomes a fallback episode."""
    body = F.coalesce(t.json_object(raw), t.strip(raw))
    out = df.withColumn("_body", body).withColumn("_p", F.from_json("_body", DECISION, {"mode": "PERMISSIVE"}))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull() | ~F.col("_body").startswith("{")
    inner = F.col("_p.memory")
    parsed = F.from_json(inner, MEMORY)
    plain = F.struct(inner.alias("content"), *[F.lit(None).cast(x.split(":", 1)[1]).alias(x.split(":", 1)[0]) for x in MEMORY[7:-1].replace("array<string>", "array<string>").split(",")[1:]])
    memory = F.when(_some(inner).isNull(), F.lit(None)).when(inner.startswith("{"), F.when(_some(parsed.content).isNotNull(), parsed)).otherwise(plain)
    spare = F.struct(F.col(fallback).alias("content"), *[(F.lit("episodic") if n == "type" else F.lit(0.5) if n == "confidence" else F.lit(0.1) if n == "emotional_weight" else F.array(F.lit("parse_fallback")) if n == "tags" else F.lit(None).cast(k)).alias(n) for n, k in (x.split(":", 1) for x in MEMORY[7:-1].split(",")[1:])])
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(bad, F.lit("store_episodic")).otherwise(normalize_action(F.coalesce("_p.action", F.lit("store_episodic")))).alias("action"),
        F.when(bad, spare).otherwise(memory).alias("memory"),
        F.when(bad, clean_facts(F.lit(None))).otherwise(clean_facts(F.col("_p.facts"))).alias("facts"),
        F.when(bad, clean_indexables(F.lit(None))).otherwise(clean_indexables(F.col("_p.indexables"))).alias("indexables"),
        F.when(bad, F.lit("Model returned invalid JSON; stored fallback content.")).otherwise(F.coalesce(_some(F.col("_p.reasoning")), F.lit("Model output missing explicit reasoning; applied parser defaults."))).alias("reasoning"),
        F.when(bad, F.lit(0.5)).otherwise(F.col("_p.confidence")).alias("confidence"),
        bad.alias("parse_error"),
    )


def parse_plan(df: DataFrame, raw: str, question: str, top_k: int = 5) -> DataFrame:
    """Recall plans; tables kept in order, an empty list or no JSON falls back."""
    body = F.coalesce(t.json_object(raw), t.strip(raw))
    out = df.withColumn("_body", body).withColumn("_p", F.from_json("_body", PLAN, {"mode": "PERMISSIVE"}))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull() | ~F.col("_body").startswith("{")
    tables = F.filter(F.coalesce("_p.target_tables", F.array().cast("array<string>")), lambda x: x.isin("semantic", "episodic", "archival"))
    fall = bad | (F.size(tables) == 0)
    k = F.try_to_number(F.col("_p.top_k"), F.lit("99999")).cast("int")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns], F.when(bad, "recall").otherwise(F.coalesce(_some(F.col("_p.intent")), F.lit("recall"))).alias("intent"),
        F.when(fall, F.array(F.lit("semantic"), F.lit("episodic"))).otherwise(tables).alias("target_tables"),
        F.when(bad, t.keywords(question)).otherwise(F.coalesce("_p.ranking_hints", F.array().cast("array<string>"))).alias("ranking_hints"),
        F.when(~bad, _some(F.col("_p.temporal_intent"))).alias("temporal_intent"), F.when(bad | k.isNull() | (k <= 0), F.lit(top_k)).otherwise(F.least(k, F.lit(top_k))).alias("top_k"), fall.alias("plan_fallback"),
    )


def stored_text(content: Column, facts: Column) -> Column:
    """Content and the facts' texts, as the guards read them."""
    parts = F.flatten(F.transform(facts, lambda f: F.array(f.subject, f.predicate, f.value_text, F.coalesce(f.evidence_text, F.lit("")))))
    return F.array_join(F.filter(F.concat(F.array(t.strip(F.coalesce(content, F.lit("")))), parts), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def grounding(a: Column, b: Column) -> Column:
    """struct(overlap, required, grounded) of the significant tokens of the
    target and of what is stored."""
    n = F.size(a)
    overlap = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    required = F.when(n == 0, 0).otherwise(F.least(F.lit(2), F.greatest(F.lit(1), F.ceil(n * F.lit(0.1)).cast("int"))))
    # two different tokens in common are enough, so seldom all are counted for that
    enough = F.when(F.size(F.array_intersect(a, b)) >= required, True).otherwise(overlap >= required)
    return F.struct(F.when(n == 0, 0).otherwise(overlap).alias("overlap"), required.alias("required"), enough.alias("grounded"))


def guarded(df: DataFrame, target: str, stored: str, action: str, parse_error: str) -> DataFrame:
    """guard_route is null, grounding_reject_bleed or grounding_reject."""
    persists = ~F.col(parse_error) & ~route(action).isin("ignore", "recall_only") & (t.strip(stored) != "")
    # tokens are columns of their own, so that each text is taken apart once
    out = df.withColumns({"_target": t.significant_tokens(target), "_stored": F.array_distinct(t.significant_tokens(stored))})
    out = out.withColumn("grounding", grounding(F.col("_target"), F.col("_stored"))).drop("_target", "_stored")
    return out.withColumn("guard_route", F.when(persists & t.has_bleed(stored), "grounding_reject_bleed").when(persists & ~F.col("grounding.grounded"), "grounding_reject"))


def routed(df: DataFrame, action: str, content: str, duplicate: str) -> DataFrame:
    """One row for each target written: decisions always, then what
    the route writes; duplicates and empty content write nothing else."""
    r = route(action)
    targets = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))]), r), F.array(F.lit("episodic")))
    targets = F.when(F.col(action) == "flag_and_store", F.array(F.lit("conflicts"), F.lit("episodic"))).otherwise(targets)
    nothing = F.col(duplicate) | (t.strip(F.coalesce(F.col(content), F.lit(""))) == "")
    targets = F.when(nothing, F.array().cast("array<string>")).otherwise(targets)
    return df.withColumn("route", r).withColumn("target", F.explode(F.concat(F.array(F.lit("decisions")), targets)))


def indexables_for(text: Column, content: Column, tags: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """workflow, or mnemonic with a fact anchor if its key differs, as
    array<struct(kind, key, steps, salience, hint)>."""
    key, steps = t.workflow_key(text, tags), t.workflow_steps(text)
    clean = t.squeeze(F.when(t.strip(content) != "", content).otherwise(text))
    mnemonic, anchor = t.mnemonic_key(clean, tags), t.fact_key(subject, predicate, value)
    sal = t.salience(clean, tags)
    none = F.array().cast("array<string>")

    def row(kind: str, k: Column, s: Column, score: Column, h: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k.alias("key"), s.alias("steps"), score.cast("double").alias("salience"), h.alias("hint"))

    flow = key.isNotNull() & (F.size(steps) >= 2)
    plain = F.array_compact(F.array(row("mnemonic", mnemonic, none, sal, t.hint(clean)), F.when((anchor != "") & (anchor != mnemonic), row("fact_anchor", anchor, none, F.greatest(sal, F.lit(0.82)), t.hint(clean)))))
    return F.when(t.strip(F.concat(text, content)) == "", F.filter(plain, lambda x: F.lit(False))).when(flow, F.array(row("workflow", key, steps, F.lit(0.95), t.hint(text)))).otherwise(plain)


def strict_issues(df: DataFrame) -> Column:
    """(path, message) of what a strict decision breaks. Columns: action,
    memory (struct), facts, reasoning."""
    def issue(bad: Column, path: str, message: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))

    m = F.col("memory")
    stores = F.col("action").isin("store_episodic", "promote_semantic", "update_existing", "flag_and_store")
    unit = lambda c: c.isNotNull() & ~c.between(0.0, 1.0)
    return F.array_compact(
        F.array(
            issue(~F.col("action").isin(STRICT_ACTIONS), "$.action", "must be one of the strict actions"),
            issue(stores & (m.isNull() | (t.strip(F.coalesce(m.content, F.lit(""))) == "")), "$.memory.content", "must be a non-empty text"),
            issue(m.isNotNull() & m.type.isNotNull() & ~m.type.isin("episodic", "semantic"), "$.memory.type", "must be episodic or semantic"),
            *[issue(m.isNotNull() & unit(m[c]), f"$.memory.{c}", "must be from 0 to 1") for c in ("strength", "decay_rate", "emotional_weight", "confidence")],
            issue(F.exists(F.coalesce("facts", F.array().cast(f"array<{FACT}>")), lambda f: ~F.coalesce(f.predicate.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.lit(False))), "$.facts.predicate", "must be snake case"),
            issue((F.col("action") == "ignore") & m.isNotNull(), "$.memory", "must be null for ignore"),
            issue(t.strip(F.coalesce("reasoning", F.lit(""))) == "", "$.reasoning", "must be a non-empty text"),
        )
    )


def consolidated(df: DataFrame, action: str, verdict: str, near_score: str, cosine: str, old: str, merged: str) -> DataFrame:
    """The verdict counts where the nearest memory is near enough (0.3, cosine
    0.5 if known); a merge must keep half of the old significant tokens."""
    applies = (F.col(near_score) >= 0.3) & (F.coalesce(F.col(cosine), F.lit(1.0)) >= 0.5)
    kept = F.array_distinct(t.significant_tokens(old))
    held = F.size(F.filter(kept, lambda x: F.array_contains(t.significant_tokens(merged), x)))
    safe = held >= F.ceil(F.size(kept) * F.lit(0.5))
    return df.withColumn("final_action", F.when(~applies | F.col(verdict).isNull(), F.col(action)).when((F.col(verdict) == "update_existing") & ~safe, F.col(action)).otherwise(normalize_action(verdict)))
