"""Validators and label audits: each gives a row's issues as an array of structs,
so that a dataset is judged in one pass and reported by ``audit.issue_counts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as t
from quarrylight.operators import decisions as dc

#: Terms of the label audit.
SEMANTIC = ["always", "default", "future", "likes", "prefers", "preference", "remember that", "rule", "use ", "want future"]
EPISODIC = ["attended", "created", "finished", "met ", "ran ", "reviewed", "today", "validated", "visited", "yesterday"]
NOISE = ["haha", "okay thanks", "please continue", "sounds good", "terminal is still running", "weather outside"]
CONFLICT = ["different from", "not ", "wrong"]
UPDATE = ["actually", "correction", "instead", "outdated"]
RULE_LIKE = ["always", "future", "rule", "for future", "prefer", "prefers"]
DATE_LIKE = r"20[0-9]{2}-[0-9]{2}-[0-9]{2}|today|yesterday|friday|monday|tuesday|wednesday|thursday"
#: Actions that build on what is known, and those that need a memory.
PRIOR_ACTIONS = ["update_existing", "flag_conflict", "flag_and_store"]
MEMORY_ACTIONS = ["store_episodic", "promote_semantic", "update_existing"]
#: What must not be in a stored memory.
WRAPPER_LEAK = r"(?i)Current utterance:|Previous context:|Return JSON|target schema"
TRIVIAL = r"(?i)^(ok|thanks|thank you|hello|hi)[.! ]*$"
WEAK_KEYS = ["memory", "user", "local", "tools", "project", "system", "thing"]
INGEST_WRAPPER = r"(?i)current utterance:|source id:|extraction guidance:"
INGEST_BLEED = r"(?i)checkpoint|powershell|gate datasets|nvidia-smi|direct probe|token budget|runpod"
#: Phrases by which a stored text shows that it is a prompt.
WRAPPERS = ["normal conversation-memory input", "rendered from the benchmark dataset", "store only durable memories", "current turn to remember:", "current utterance:", "previous context:", "extraction guidance:", "do not store", "preserve source ids", " user "]
#: Stop words of the utterance tokens, and of question hints.
UTTERANCE_STOPWORDS = ["the", "and", "but", "you", "your", "for", "with", "that", "this", "what", "have", "been", "said", "asked", "mentioned", "about", "from", "into", "they", "them", "their", "good", "really"]
HINT_STOPWORDS = ["what", "which", "who", "whom", "whose", "when", "where", "why", "how", "did", "does", "do", "is", "are", "was", "were", "the", "a", "an", "to", "of", "in", "on", "for", "and", "or", "with", "about", "would", "could", "should", "have", "has", "had", "his", "her", "their", "both", "any", "at", "from", "that", "this"]
UNPARSEABLE = "(?i)model output unparseable|storing nothing"


def issue(bad: Column, severity: str, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _blank(x: Column) -> Column:
    return F.coalesce(t.strip(x), F.lit("")) == ""


def memory_issues(content: Column, speaker: Column) -> Column:
    """F60, memories."""
    n = F.length(content)
    return issues(
        issue(n > 260, "warning", "memory_too_long"), issue(n < 16, "warning", "memory_too_short"), issue(content.rlike(WRAPPER_LEAK), "failure", "wrapper_text_leak"),
        issue(content.rlike(TRIVIAL), "failure", "trivial_memory"), issue(content.rlike(r"^\s*User(?![A-Za-z0-9_])") & (speaker != "") & (speaker != "User"), "failure", "generic_user_with_named_speaker"),
    )


def fact_issues(fact: Column) -> Column:
    """F60, facts: a struct with evidence_text, confidence and inference_kind."""
    evidence = F.coalesce(fact.evidence_text, F.lit(""))
    return issues(
        issue(evidence == "", "failure", "fact_missing_evidence"), issue((evidence != "") & (F.length(evidence) < 8), "warning", "fact_weak_evidence"),
        issue(fact.confidence < 0.5, "warning", "fact_low_confidence"), issue(~fact.inference_kind.eqNullSafe("explicit"), "failure", "fact_not_explicit"),
    )


def indexable_issues(row: Column) -> Column:
    """F60, indexables: a missing or weak key ends the audit of a row."""
    key = F.coalesce(row.key, F.lit(""))
    parts = F.split(key, "-")
    weak = ~F.size(parts).between(2, 5) | key.isin(WEAK_KEYS) | F.exists(parts, lambda p: (F.length(p) < 3) & ~p.rlike("^[0-9]+$"))
    rest = issues(issue(F.coalesce(row.evidence_text, F.lit("")) == "", "failure", "indexable_missing_evidence"), issue(F.length(F.coalesce(row.reconstructive_hint, F.lit(""))) < 20, "warning", "indexable_weak_hint"))
    return F.when(key == "", issues(issue(F.lit(True), "failure", "indexable_missing_key"))).when(weak, issues(issue(F.lit(True), "warning", "weak_indexable_key"))).otherwise(rest)


def recall_issues(store: Column, selected: Column) -> Column:
    """F60, recall rows: candidate ids and selected ids (arrays, null if missing)."""
    some = F.coalesce(F.size(store) > 0, F.lit(False))
    return issues(issue(~some, "failure", "recall_missing_memory_store"), issue(selected.isNull(), "failure", "recall_missing_selected_ids"), issue((F.coalesce(F.size(selected), F.lit(0)) <= 0) & some, "warning", "empty_recall_selection"))


def unknown_selected(selected: Column, store: Column) -> Column:
    """Selected ids that are not among the candidates."""
    return F.array_except(selected, store)


def _has(x: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | x.contains(term)
    return out


def label_issues(df: DataFrame, local_kind: str = "local_db") -> DataFrame:
    """``df`` (action, memory_type, conversation, context, source_kind) with
    ``issues``. ``local_kind``: the source kind of rows from a memory store."""
    hay = F.lower(F.concat_ws(" ", t.squeeze(F.coalesce("conversation", F.lit(""))), t.squeeze(F.coalesce("context", F.lit("")))))
    out = df.withColumn("_x", hay)
    dates = F.size(F.regexp_extract_all("_x", F.lit(t.word(DATE_LIKE)), F.lit(0)))
    out = out.withColumns({"_s": t.count_terms("_x", SEMANTIC), "_e": t.count_terms("_x", EPISODIC) + dates})
    x, s, e, action, kind = (F.col(c) for c in ("_x", "_s", "_e", "action", "memory_type"))
    prior, noise = _has(x, ["memory_store", "prior", "existing"]), _has(x, NOISE)
    found = issues(
        issue((action == "store_episodic") & (s > e), "high", "semantic_wording_labeled_store_episodic"),
        issue((action == "promote_semantic") & (e > s) & ~_has(x, RULE_LIKE), "high", "episodic_wording_labeled_promote_semantic"),
        issue((action != "ignore") & noise & (s == 0) & (e == 0), "medium", "noise_wording_not_labeled_ignore"),
        issue((action == "ignore") & ((s > 0) | (e > 0)) & ~noise, "medium", "durable_wording_labeled_ignore"),
        issue(prior & ~action.isin(PRIOR_ACTIONS), "medium", "prior_context_without_update_or_conflict_action"),
        issue(_has(x, CONFLICT) & prior & ~action.isin("flag_conflict", "flag_and_store"), "medium", "conflict_wording_not_labeled_flag_conflict"),
        issue(_has(x, UPDATE) & prior & ~action.isin(PRIOR_ACTIONS), "medium", "update_wording_without_update_or_conflict_action"),
        issue(action.isin(MEMORY_ACTIONS) & (kind == "none"), "high", "memory_action_missing_memory_payload"),
        issue((action == "ignore") & (kind != "none"), "high", "ignore_action_has_memory_payload"),
        issue((F.col("source_kind") == local_kind) & (action == "store_episodic") & (s > 0) & (e == 0), "high", "local_semantic_signal_labeled_store_episodic"),
    )
    return out.withColumn("issues", found).drop("_x", "_s", "_e")


def at_least(found: Column, severity: str) -> Column:
    """Issues of a severity or worse: low, medium, high."""
    order = ["low", "medium", "high"]
    return F.filter(found, lambda i: i.severity.isin(order[order.index(severity) :]))


def recall_plan_issues(plan: Column) -> Column:
    """messages of a plan (struct intent, temporal_intent, top_k; an absent
    top_k is 5). An empty list of tables falls back and is no issue."""
    k = F.coalesce(plan.top_k, F.lit(5)).cast("int")
    return F.array_compact(
        F.array(
            F.when(plan.isNull(), F.lit("expected object")),
            F.when(plan.isNotNull() & _blank(plan.intent), F.lit("intent must be a non-empty string")),
            F.when(plan.temporal_intent.isNotNull() & _blank(plan.temporal_intent), F.lit("temporal_intent must be a non-empty string when present")),
            F.when(plan.isNotNull() & ~k.between(1, 20), F.lit("top_k must be between 1 and 20")),
        )
    )


def production_error(df: DataFrame, target: str, label: str, action: str, schema_issues: Column) -> DataFrame:
    """``df`` with ``error``, the first thing that keeps a row from training:
    the schema, bleed in its labels, or labels not grounded in the target."""
    out = df.withColumns({"_a": t.significant_tokens(target), "_b": F.array_distinct(t.significant_tokens(label))})
    grounded = dc.grounding(F.col("_a"), F.col("_b")).grounded
    error = (
        F.when(F.size(schema_issues) > 0, "invalid storage decision").when(t.has_bleed(label), "curriculum bleed in labels")
        .when((F.col(action) != "ignore") & ~_blank(F.col(target)) & ~grounded, "labels not grounded in remember_target")
    )
    return out.withColumn("error", error).drop("_a", "_b")


def grounding_case(df: DataFrame) -> DataFrame:
    """effective_stored, content_grounded and curriculum_bleed of a case.
    Columns: source_text, stored, action, parse_error, key_tokens."""
    out = dc.guarded(df, "source_text", "stored", "action", "parse_error")
    would = ~F.col("parse_error") & ~dc.route(F.col("action")).isin("ignore", "recall_only") & (t.strip("stored") != "")
    low = F.lower("stored")
    hits = F.size(F.filter("key_tokens", lambda k: low.contains(F.lower(k))))
    keyed = (F.size("key_tokens") > 0) & (hits >= F.least(F.lit(2), F.size("key_tokens")))
    out = out.withColumns({"model_would_store": would, "guard_rejected": F.col("guard_route").isNotNull()})
    out = out.withColumn("effective_stored", F.col("model_would_store") & ~F.col("guard_rejected"))
    return out.withColumns({"content_grounded": F.col("effective_stored") & (keyed | F.col("grounding.grounded")), "curriculum_bleed": F.col("effective_stored") & t.has_bleed("stored")})


def consolidation_score(expected_action: Column, expected_target: Column, action: Column, target: Column, merged: Column, parsed: Column) -> Column:
    """struct(action_match, target_memory_id_match, merged_content_grounded)."""
    same = F.when(expected_target.isNull(), F.coalesce(target, F.lit("")) == "").otherwise(F.coalesce(target == expected_target, F.lit(False)))
    grounded = (expected_action != "update_existing") | (F.length(F.coalesce(merged, F.lit(""))) > 10)
    return F.struct((parsed & action.eqNullSafe(expected_action)).alias("action_match"), (parsed & same).alias("target_memory_id_match"), (parsed & grounded).alias("merged_content_grounded"))


def ingest_issues(memories: DataFrame, ingested: DataFrame, probes: list[tuple[str, str]], tag: str) -> DataFrame:
    """(source, check) of memories (id, source_id, content, tags) and of the
    probes (id of a turn, pattern) whose turn is among ``ingested`` (id)."""
    own = F.coalesce(F.nullif(t.tag_value("tags", tag), F.lit("")), F.col("source_id"), F.col("id").cast("string"))
    rows = memories.withColumns({"source": own, "_c": t.strip(F.coalesce("content", F.lit("")))})
    check = lambda bad, name: F.when(bad, F.lit(name))
    c = F.col("_c")
    found = F.when(c == "", F.array(F.lit("empty_content"))).otherwise(
        F.array_compact(F.array(check(c.startswith("{") | c.rlike(INGEST_WRAPPER), "wrapper_or_json"), check(c.rlike(INGEST_BLEED), "curriculum_bleed"), check(c.rlike(r"(?i)^user prefers(?![A-Za-z0-9_])"), "generic_user_pref")))
    )
    out = rows.select("source", F.explode(found).alias("check"))
    spark = memories.sparkSession
    empty = memories.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("db").alias("source"), F.lit("no_memories").alias("check"))
    asked = spark.createDataFrame(probes, "probe string, pattern string").join(ingested.select(F.col("id").cast("string").alias("probe")).distinct(), "probe")
    held = rows.select(F.col("source").alias("probe"), F.concat_ws(" ", "content", F.array_join("tags", " ")).alias("_text"))
    judged = asked.join(held, "probe", "left").groupBy("probe").agg(F.count("_text").alias("n"), F.max(F.regexp_like("_text", F.col("pattern"))).alias("hit"))
    probed = judged.select(F.col("probe").alias("source"), F.when(F.col("n") == 0, "missing_gold_memory").when(~F.col("hit"), "gold_fact_missing").alias("check")).filter("check IS NOT NULL")
    return out.unionByName(empty).unionByName(probed)


def fail_safe(route: Column, reasoning: Column) -> Column:
    """The model's output was given up."""
    return F.coalesce(route == "parse_error_noop", F.lit(False)) | F.coalesce(reasoning, F.lit("")).rlike(UNPARSEABLE)


def rendered_grounded(content: Column, source: Column) -> Column:
    """A rendered text shares two tokens, or all, with its source. Both are
    token arrays, that of the source with its id and times."""
    return (F.size(content) > 0) & (F.size(F.filter(content, lambda x: F.array_contains(source, x))) >= F.least(F.lit(2), F.size(content)))


def utterance_tokens(x: Column | str) -> Column:
    """F8."""
    return F.filter(F.regexp_extract_all(F.lower(t.col(x)), F.lit("[a-z0-9+]{3,}"), F.lit(0)), lambda w: ~w.isin(UTTERANCE_STOPWORDS))


def grounded_in_utterance(content: Column, utterance: Column) -> Column:
    """Two tokens in common, or all, or a quotation of four characters."""
    a, b = utterance_tokens(utterance), utterance_tokens(content)
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x))) >= F.least(F.lit(2), F.size(a))
    quoted = F.exists(F.regexp_extract_all(content, F.lit('"([^"]{4,})"'), F.lit(1)), lambda q: utterance.contains(q))
    return (F.size(a) > 0) & (F.size(b) > 0) & (shared | quoted)


def wrapper_content(x: Column, more: tuple[str, ...] = ()) -> Column:
    """A prompt or JSON in place of a memory. ``more``: phrases of a benchmark."""
    low = F.lower(x)
    return x.startswith("{") | low.startswith("user ") | _has(low, [*WRAPPERS, *more])


def json_like(x: Column) -> Column:
    """struct(json_like, empty)."""
    return F.struct(x.startswith("{").alias("json_like"), _blank(x).alias("empty"))


def question_hints(x: Column | str, most: int = 4) -> Column:
    """the first words that say something, as written, one of each."""
    words = F.filter(F.regexp_extract_all(t.col(x), F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(HINT_STOPWORDS))
    low = F.transform(words, F.lower)
    first = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


def answerable(questions: DataFrame, ingested: DataFrame, only: bool = False) -> DataFrame:
    """Questions (qid, evidence) with evidence; with ``only``, those of whose
    evidence some was ingested (id)."""
    some = questions.filter(F.size("evidence") > 0)
    if not only:
        return some
    held = some.select("qid", F.explode("evidence").alias("id")).join(ingested.select("id").distinct(), "id", "left_semi")
    return some.join(held.select("qid").distinct(), "qid", "left_semi")


def gated(total: int, stages: list[tuple[str, Column]], df: DataFrame) -> DataFrame:
    """(stage, checked, failed, ran) of stages in order; those after the first
    with failures did not run. ``stages``: name and the flag of a sound row."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"f{i}") for i, (_, ok) in enumerate(stages)])
    before, rows = F.lit(True), []
    for i, (name, _) in enumerate(stages):
        rows.append(F.struct(F.lit(name).alias("stage"), F.when(before, F.lit(total)).otherwise(0).cast("long").alias("checked"), F.when(before, F.col(f"f{i}")).otherwise(0).cast("long").alias("failed"), before.alias("ran")))
        before = before & (F.col(f"f{i}") == 0)
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
