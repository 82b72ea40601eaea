"""Queries of the validators, the service and the remaining audits. Their SQL is
written from the rules' text, not from the columns of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as t
from quarrylight.operators import decisions as dc
from quarrylight.operators import evaluation as e
from quarrylight.operators import service as sv
from quarrylight.operators import validation as v
from quarrylight.plans import sqltext as s
from quarrylight.plans.ranking_queries import HYBRID_SQL, document_memories, questions, read
from quarrylight.plans.store_queries import MADE, ROUTE_SQL, parsed, raw_decisions, sig

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits(words: list[str], x: str = "x") -> str:
    return f"len(list_filter({quoted(words)}, lambda w: contains({x}, w)))"


ACTIONS = ["store_episodic", "promote_semantic", "ignore", "update_existing", "flag_conflict", "flag_and_store"]
SAID = ["I always use tabs", "Met Anna today, haha", "okay thanks", "actually wrong, prior memory_store", "plain words", "on 2024-05-01 we validated it"]


@query(f"""WITH b AS (SELECT conv_id, turn, {quoted(ACTIONS)}[(turn + conv_id) % 6 + 1] AS action, CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'episodic' END AS kind, CASE WHEN turn % 2 = 0 THEN 'local_db' ELSE 'chat' END AS src,
lower({s.squeeze(quoted(SAID) + "[(turn * 7 + conv_id) % 6 + 1] || ' ' || text")} || ' ' || CASE WHEN turn % 4 = 0 THEN 'existing' ELSE '' END) AS x FROM conversations),
k AS (SELECT *, {hits(v.SEMANTIC)} AS sem, {hits(v.EPISODIC)} + len(regexp_extract_all(x, '\\b(?:20\\d{{2}}-\\d{{2}}-\\d{{2}}|today|yesterday|friday|monday|tuesday|wednesday|thursday)\\b')) AS epi, {hits(v.NOISE)} AS noi, {hits(v.CONFLICT)} AS con, {hits(v.UPDATE)} AS upd,
{hits(["memory_store", "prior", "existing"])} > 0 AS pri, {hits(v.RULE_LIKE)} > 0 AS rul FROM b)
SELECT conv_id, turn, array_to_string(list_sort(list_filter([
CASE WHEN action = 'store_episodic' AND sem > epi THEN 'high:semantic_wording_labeled_store_episodic' END, CASE WHEN action = 'promote_semantic' AND epi > sem AND NOT rul THEN 'high:episodic_wording_labeled_promote_semantic' END,
CASE WHEN action <> 'ignore' AND noi > 0 AND sem = 0 AND epi = 0 THEN 'medium:noise_wording_not_labeled_ignore' END, CASE WHEN action = 'ignore' AND sem + epi > 0 AND noi = 0 THEN 'medium:durable_wording_labeled_ignore' END,
CASE WHEN pri AND action NOT IN ('update_existing', 'flag_conflict', 'flag_and_store') THEN 'medium:prior_context_without_update_or_conflict_action' END, CASE WHEN con > 0 AND pri AND action NOT IN ('flag_conflict', 'flag_and_store') THEN 'medium:conflict_wording_not_labeled_flag_conflict' END,
CASE WHEN upd > 0 AND pri AND action NOT IN ('update_existing', 'flag_conflict', 'flag_and_store') THEN 'medium:update_wording_without_update_or_conflict_action' END, CASE WHEN action IN ('store_episodic', 'promote_semantic', 'update_existing') AND kind = 'none' THEN 'high:memory_action_missing_memory_payload' END,
CASE WHEN action = 'ignore' AND kind <> 'none' THEN 'high:ignore_action_has_memory_payload' END, CASE WHEN src = 'local_db' AND action = 'store_episodic' AND sem > 0 AND epi = 0 THEN 'high:local_semantic_signal_labeled_store_episodic' END], lambda i: i IS NOT NULL)), ',') AS found FROM k""")
def label_risks(spark, d):
    """F61 over turns with made labels."""
    c = read(spark, d, "conversations")
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("turn") * 7 + F.col("conv_id")) % 6).cast("int"))
    rows = c.select(
        "conv_id", "turn", F.get(F.array(*map(F.lit, ACTIONS)), ((F.col("turn") + F.col("conv_id")) % 6).cast("int")).alias("action"), F.when(F.col("turn") % 3 == 0, "none").otherwise("episodic").alias("memory_type"),
        F.when(F.col("turn") % 2 == 0, "local_db").otherwise("chat").alias("source_kind"), F.concat_ws(" ", said, "text").alias("conversation"), F.when(F.col("turn") % 4 == 0, "existing").otherwise("").alias("context"),
    )
    out = v.label_issues(rows)
    return out.select("conv_id", "turn", F.array_join(F.sort_array(F.transform("issues", lambda i: F.concat_ws(":", i.severity, i.reason))), ",").alias("found"))


KEYS = ["blue-harbour", "memory", "", "a-bc", "one-two-three-four-five-six", "river-2024", "user"]


@query(f"""WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Thanks!' WHEN 1 THEN 'Previous context: ' || text WHEN 2 THEN 'User likes it' ELSE text END AS c, CASE WHEN doc_id % 3 = 0 THEN 'Anna' ELSE 'User' END AS sp, {quoted(KEYS)}[doc_id % 7 + 1] AS key,
CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE 'long enough' END AS ev, doc_id % 10 / 10.0::DOUBLE AS conf, CASE WHEN doc_id % 4 = 0 THEN 'inferred' ELSE 'explicit' END AS kind, left(text, doc_id % 40) AS hint, doc_id % 6 AS n_store, doc_id % 4 AS n_sel FROM documents),
w AS (SELECT *, string_split(key, '-') AS p FROM b)
SELECT doc_id, array_to_string(list_filter([CASE WHEN length(c) > 260 THEN 'memory_too_long' END, CASE WHEN length(c) < 16 THEN 'memory_too_short' END, CASE WHEN contains(c, 'Previous context:') THEN 'wrapper_text_leak' END, CASE WHEN c = 'Thanks!' AND false THEN '' END, CASE WHEN starts_with(c, 'User ') AND sp <> 'User' THEN 'generic_user_with_named_speaker' END], lambda i: i IS NOT NULL), ',') AS memory,
array_to_string(list_filter([CASE WHEN ev = '' THEN 'fact_missing_evidence' END, CASE WHEN ev = 'short' THEN 'fact_weak_evidence' END, CASE WHEN conf < 0.5 THEN 'fact_low_confidence' END, CASE WHEN kind <> 'explicit' THEN 'fact_not_explicit' END], lambda i: i IS NOT NULL), ',') AS fact,
CASE WHEN key = '' THEN 'indexable_missing_key' WHEN key IN ('memory', 'user') OR len(p) < 2 OR len(p) > 5 OR len(list_filter(p, lambda z: length(z) < 3 AND NOT regexp_matches(z, '^\\d+$'))) > 0 THEN 'weak_indexable_key' ELSE array_to_string(list_filter([CASE WHEN ev = '' THEN 'indexable_missing_evidence' END, CASE WHEN length(hint) < 20 THEN 'indexable_weak_hint' END], lambda i: i IS NOT NULL), ',') END AS indexable,
array_to_string(list_filter([CASE WHEN n_store = 0 THEN 'recall_missing_memory_store' END, CASE WHEN n_sel = 3 THEN 'recall_missing_selected_ids' END, CASE WHEN n_sel IN (0, 3) AND n_store > 0 THEN 'empty_recall_selection' END], lambda i: i IS NOT NULL), ',') AS recall,
CASE WHEN n_sel = 3 THEN NULL ELSE greatest(0, n_sel - n_store) END::INT AS n_unknown FROM w""".replace("CASE WHEN c = 'Thanks!' AND false THEN '' END", "CASE WHEN regexp_matches(c, '(?i)^(ok|thanks|thank you|hello|hi)[.! ]*$') THEN 'trivial_memory' END"))
def quality_audit(spark, d):
    """F60, J17 over made memories, facts, indexables and recalls."""
    k = F.col("doc_id")
    x = read(spark, d, "documents").select(
        "doc_id", F.when(k % 5 == 0, F.lit("Thanks!")).when(k % 5 == 1, F.concat(F.lit("Previous context: "), "text")).when(k % 5 == 2, F.lit("User likes it")).otherwise(F.col("text")).alias("c"), F.when(k % 3 == 0, "Anna").otherwise("User").alias("sp"),
        F.get(F.array(*map(F.lit, KEYS)), (k % 7).cast("int")).alias("key"), F.when(k % 3 == 0, "").when(k % 3 == 1, "short").otherwise("long enough").alias("ev"), ((k % 10) / 10).alias("conf"), F.when(k % 4 == 0, "inferred").otherwise("explicit").alias("kind"),
        F.substring("text", F.lit(1), (k % 40).cast("int")).alias("hint"), F.expr("slice(sequence(1, 6), 1, cast(doc_id % 6 AS int))").alias("store"), F.expr("CASE WHEN doc_id % 4 < 3 THEN slice(sequence(1, 6), 1, cast(doc_id % 4 AS int)) END").alias("selected"),
    )
    fact, row = F.struct(F.col("ev").alias("evidence_text"), F.col("conf").alias("confidence"), F.col("kind").alias("inference_kind")), F.struct("key", F.col("ev").alias("evidence_text"), F.col("hint").alias("reconstructive_hint"))
    x = x.withColumns({"fact_": fact, "row_": row})
    names = lambda found: F.array_join(F.transform(found, lambda i: i.reason), ",")
    return x.select(
        "doc_id", names(v.memory_issues(F.col("c"), F.col("sp"))).alias("memory"), names(v.fact_issues(F.col("fact_"))).alias("fact"), names(v.indexable_issues(F.col("row_"))).alias("indexable"), names(v.recall_issues(F.col("store"), F.col("selected"))).alias("recall"),
        F.size(v.unknown_selected(F.col("selected"), F.col("store"))).alias("n_unknown"),
    ).withColumn("n_unknown", F.when(F.col("n_unknown") >= 0, F.col("n_unknown")))


@query("""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'expected object' ELSE array_to_string(list_filter([CASE WHEN item_id % 2 = 0 THEN 'intent must be a non-empty string' END, CASE WHEN item_id % 3 = 0 THEN 'temporal_intent must be a non-empty string when present' END,
CASE WHEN item_id % 30 NOT BETWEEN 1 AND 20 THEN 'top_k must be between 1 and 20' END], lambda i: i IS NOT NULL), '; ') END AS issues FROM benchmark""")
def recall_plan_validation(spark, d):
    """F55 over made plans."""
    k = F.col("item_id")
    plan = F.when(k % 5 != 0, F.struct(F.when(k % 2 == 0, " ").otherwise("recall").alias("intent"), F.when(k % 3 == 0, "").when(k % 3 == 1, "past").alias("temporal_intent"), (k % 30).alias("top_k")))
    return read(spark, d, "benchmark").withColumn("p", plan).select("item_id", F.array_join(v.recall_plan_issues(F.col("p")), "; ").alias("issues"))


STORED = f"{s.strip('content')} || CASE WHEN fact_text = '' THEN '' ELSE ' ' || fact_text END"
BLEED = "regexp_matches(stored, '(?i)checkpoint|powershell|gate datasets|nvidia-smi|direct probe|token budget|runpod|fact parser|malformed parser|constoursated|gate6|expanded probe|gate-?\\d')"
GROUND = f"""WITH {MADE}, g AS (SELECT *, CASE n % 3 WHEN 0 THEN 'other words entirely' WHEN 1 THEN {STORED} || ' checkpoint' ELSE {STORED} END AS stored, {ROUTE_SQL} AS route FROM parsed),
k AS (SELECT *, {sig('text')} AS a, {sig('stored')} AS b FROM g), o AS (SELECT *, len(a) = 0 OR {s.hits('a', 'b')} >= least(2, greatest(1, ceil(len(a) * 0.1::DOUBLE)::INT)) AS grounded FROM k)"""


def judged_turns(spark, d):
    """Parsed turns, a third of them with other words, a third with bleed."""
    n = F.col("turn") + F.col("conv_id")
    rows = parsed(spark, d).withColumn("_stored", dc.stored_text(F.col("memory.content"), F.col("facts")))
    return rows.withColumn("stored", F.when(n % 3 == 0, "other words entirely").when(n % 3 == 1, F.concat("_stored", F.lit(" checkpoint"))).otherwise(F.col("_stored"))).withColumn("n", n)


@query(f"""{GROUND} SELECT conv_id, turn, CASE WHEN n % 11 = 0 THEN 'invalid storage decision' WHEN {BLEED} THEN 'curriculum bleed in labels' WHEN action <> 'ignore' AND NOT grounded THEN 'labels not grounded in remember_target' END AS error FROM o""")
def production_rows(spark, d):
    """F62."""
    found = F.when(F.col("n") % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return v.production_error(judged_turns(spark, d), "source_text", "stored", "action", found).select("conv_id", "turn", "error")


@query(f"""{GROUND}, e AS (SELECT *, NOT parse_error AND route NOT IN ('ignore', 'recall_only') AS would FROM o), f AS (SELECT *, would AND NOT {BLEED} AND grounded AS effective FROM e)
SELECT conv_id, turn, would AS model_would_store, would AND (NOT grounded OR {BLEED}) AS guard_rejected, effective AS effective_stored, effective AND {BLEED} AS curriculum_bleed, effective AS content_grounded FROM f""")
def grounding_cases(spark, d):
    """E16."""
    rows = judged_turns(spark, d).withColumn("key_tokens", F.array(F.col("role"), F.lit("nowhere")))
    return v.grounding_case(rows).select("conv_id", "turn", "model_would_store", "guard_rejected", "effective_stored", "curriculum_bleed", "content_grounded")


@query("""SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS action_match, doc_id % 3 <> 0 AND CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 = 0 ELSE doc_id % 5 = 1 END AS target_memory_id_match, doc_id % 3 <> 0 AND length(left(text, doc_id % 21)) > 10 AS merged_content_grounded FROM documents""")
def consolidation_scores(spark, d):
    """E11 over made cases."""
    k = F.col("doc_id")
    want, got = F.when(k % 4 != 0, F.lit("m1")), F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("m1")).otherwise(F.lit("m2"))
    score = v.consolidation_score(F.lit("update_existing"), want, F.when(k % 2 == 0, "update_existing").otherwise("ignore"), got, F.substring("text", F.lit(1), (k % 21).cast("int")), k % 3 != 0)
    return read(spark, d, "documents").select("doc_id", score.alias("s")).select("doc_id", "s.*")


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN ' ' WHEN 2 THEN 'User prefers tea' WHEN 3 THEN text || ' direct probe' ELSE text END AS c FROM documents), k AS (SELECT 'D' || doc_id AS source, regexp_replace(regexp_replace(c, '^\\s+', ''), '\\s+$', '') AS c FROM m)
SELECT source, unnest(CASE WHEN c = '' THEN ['empty_content'] ELSE list_filter([CASE WHEN starts_with(c, '{') OR regexp_matches(c, '(?i)current utterance:|source id:|extraction guidance:') THEN 'wrapper_or_json' END, CASE WHEN regexp_matches(c, '(?i)checkpoint|powershell|gate datasets|nvidia-smi|direct probe|token budget|runpod') THEN 'curriculum_bleed' END,
CASE WHEN regexp_matches(c, '(?i)^user prefers\\b') THEN 'generic_user_pref' END], lambda i: i IS NOT NULL) END) AS check_name FROM k UNION ALL SELECT 'X1', 'missing_gold_memory' UNION ALL SELECT 'D8', 'gold_fact_missing'""")
def ingest_check(spark, d):
    """E12 over documents as memories, with three probes."""
    k = F.col("doc_id")
    content = F.when(k % 6 == 0, F.lit('{"a": 1}')).when(k % 6 == 1, F.lit(" ")).when(k % 6 == 2, F.lit("User prefers tea")).when(k % 6 == 3, F.concat("text", F.lit(" direct probe"))).otherwise(F.col("text"))
    m = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("source_id"), content.alias("content"), F.array(F.concat(F.lit("turn:D"), k.cast("string"))).alias("tags"))
    ingested = spark.createDataFrame([("D8",), ("D2",), ("X1",)], "id string")
    return v.ingest_issues(m, ingested, [("D8", "(?i)no such fact"), ("D2", "(?i)prefers tea"), ("X1", "x"), ("X2", "x")], "turn").select("source", F.col("check").alias("check_name"))


UT = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9+]{{3,}}'), lambda w: NOT list_contains(" + quoted(v.UTTERANCE_STOPWORDS) + ", w))"
HINTS = "list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'), lambda w: length(w) >= 3 AND NOT list_contains(" + quoted(v.HINT_STOPWORDS) + ", lower(w)))"


@query(f"""WITH b AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN left(text, 30) WHEN 1 THEN 'He said "' || substr(text, 5, 12) || '"' WHEN 2 THEN 'nothing alike here' ELSE 'Do not store this' END AS c FROM conversations),
k AS (SELECT *, {UT.format('text')} AS a, {UT.format('c')} AS b, {s.tokens('c')} AS ct, {s.tokens("text || ' ' || conv_id")} AS st, {HINTS} AS h FROM b), u AS (SELECT *, list_filter(h, lambda w, i: list_position(list_transform(h, lambda z: lower(z)), lower(w)) = i) AS hh FROM k)
SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AND (len(list_filter(a, lambda x: list_contains(b, x))) >= least(2, len(a)) OR len(list_filter(regexp_extract_all(c, '"([^"]{{4,}})"', 1), lambda q: contains(text, q))) > 0) AS utterance,
len(ct) > 0 AND len(list_filter(ct, lambda x: list_contains(st, x))) >= least(2, len(ct)) AS rendered, starts_with(c, '{{') OR starts_with(lower(c), 'user ') OR {hits(v.WRAPPERS, 'lower(c)')} > 0 AS wrapper, array_to_string(list_slice(hh, 1, 4), ' ') AS hints, turn % 3 = 0 OR turn % 3 = 1 AS gave_up FROM u""")
def grounding_predicates(spark, d):
    """P7, P8, P13, P14, F8, F26 over turns."""
    k = F.col("turn") % 4
    made = F.when(k == 0, F.substring("text", 1, 30)).when(k == 1, F.concat(F.lit('He said "'), F.substring("text", 5, 12), F.lit('"'))).when(k == 2, F.lit("nothing alike here")).otherwise(F.lit("Do not store this"))
    c = read(spark, d, "conversations").withColumn("c", made).withColumns({"ct": t.tokens("c"), "st": t.tokens(F.concat_ws(" ", "text", "conv_id"))})
    route, why = F.when(F.col("turn") % 3 == 0, "parse_error_noop"), F.when(F.col("turn") % 3 == 1, "Storing nothing.")
    return c.select(
        "conv_id", "turn", v.grounded_in_utterance(F.col("c"), F.col("text")).alias("utterance"), v.rendered_grounded(F.col("ct"), F.col("st")).alias("rendered"), v.wrapper_content(F.col("c")).alias("wrapper"), F.array_join(v.question_hints("text"), " ").alias("hints"), v.fail_safe(route, why).alias("gave_up")
    )


@query(f"""WITH {MADE}, z AS (SELECT p.*, turn % 2 = 0 AS fixed FROM parsed p), y AS (SELECT *, CASE WHEN n % 7 = 0 AND fixed THEN 'promote_semantic' WHEN n % 7 = 0 THEN 'ignore' ELSE action END AS act, CASE WHEN n % 7 = 0 AND fixed THEN 'repaired ' || text WHEN n % 7 = 0 THEN text ELSE content END AS body FROM z),
r AS (SELECT *, n % 7 = 0 AND NOT fixed AS bad, {ROUTE_SQL.replace('CASE action', 'CASE act')} AS route FROM y), k AS (SELECT *, {sig('text')} AS a, {sig("body || CASE WHEN fact_text = '' THEN '' ELSE ' ' || fact_text END")} AS b FROM r),
g AS (SELECT *, NOT bad AND route NOT IN ('ignore', 'recall_only') AND len(a) > 0 AND {s.hits('a', 'b')} < least(2, greatest(1, ceil(len(a) * 0.1::DOUBLE)::INT)) AS rejected FROM k)
SELECT conv_id, turn, act AS action, CASE WHEN bad THEN 'parse_error_noop' WHEN rejected THEN 'grounding_reject' ELSE route END AS route, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 3 = 0 THEN 'r' ELSE 'model' END AS source,
CASE WHEN bad OR rejected THEN '' WHEN act = 'flag_and_store' THEN 'conflicts,episodic' ELSE CASE route WHEN 'semantic_upsert' THEN 'semantic' WHEN 'update_with_supersede' THEN 'semantic' WHEN 'decay_existing_then_insert' THEN 'decay_schedule,episodic' WHEN 'conflict_log_and_hold' THEN 'conflicts' WHEN 'episodic_insert' THEN 'episodic' ELSE '' END END AS targets FROM g""")
def remember_batch(spark, d):
    """Requests with a first output, a repair, and sources."""
    n = F.col("turn") + F.col("conv_id")
    fixed = F.to_json(F.struct(F.lit("promote_semantic").alias("action"), F.struct(F.concat(F.lit("repaired "), "source_text").alias("content"), F.lit("semantic").alias("type")).alias("memory")))
    rows = raw_decisions(spark, d).withColumns({"repaired": F.when(F.col("turn") % 2 == 0, fixed).otherwise("still not json"), "source_kind": F.when(n % 3 == 0, F.lit("r"))})
    rows = rows.withColumn("raw", F.regexp_replace("raw", '"type":"episodic"', '"type":"episodic","source_kind":"model"')).withColumn("repaired", F.regexp_replace("repaired", '"type":"semantic"', '"type":"semantic","source_kind":"model"'))
    out = sv.remember(rows, "raw", "repaired", "source_text")
    return out.select("conv_id", "turn", "action", "route", "attempts", F.coalesce("memory.source_kind", F.when(n % 3 == 0, "r").otherwise("model")).alias("source"), F.array_join("targets", ",").alias("targets"))


@query("""WITH b AS (SELECT doc_id, text, doc_id % 4 AS k FROM documents) SELECT doc_id AS qid, 0 AS place, doc_id::VARCHAR AS id, CASE WHEN k = 1 THEN 'semantic' ELSE 'memory' END AS "table", text AS content FROM b WHERE k IN (1, 2) AND len(""" + s.tokens("text") + """) > 0""")
def context_render(spark, d):
    """Rendered items that name their candidate and keep to it."""
    k, own = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    item = F.struct(own.alias("id"), F.when(k == 1, "semantic").otherwise("nowhere").alias("table"), F.when(k == 3, F.lit("unrelated zebra quartz")).otherwise(F.col("text")).alias("content"))
    strange = F.struct(F.lit("gone").alias("id"), F.lit("semantic").alias("table"), F.col("text").alias("content"))
    raw = F.when(k == 0, F.lit("{broken")).otherwise(F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(item, strange).alias("context_items"), F.array(own).alias("selected_ids")))))
    docs = read(spark, d, "documents")
    renders = sv.parse_render(docs.select(F.col("doc_id").alias("qid"), raw.alias("raw")), "raw")
    return sv.rendered(renders, docs.select(F.col("doc_id").alias("qid"), own.alias("id"), F.col("text").alias("content"), "source"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN lang END AS memory_content, CASE WHEN doc_id % 2 = 0 THEN 'm' || doc_id END AS attached_to FROM documents""")
def linked_memories(spark, d):
    """Indexables with their memory, and rows attached to the first one written."""
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    x = docs.select("doc_id", F.when(k % 3 == 0, "semantic").otherwise("nowhere").alias("target_memory_table"), k.cast("string").alias("target_memory_id"))
    m = docs.filter("doc_id % 5 != 0").select(F.lit("semantic").alias("table"), F.col("doc_id").alias("id"), F.col("lang").alias("content"))
    ref = lambda i: F.struct(F.lit("episodic").alias("table"), i.alias("id"))
    refs = F.when(k % 2 == 0, F.array(ref(F.concat(F.lit("m"), k.cast("string"))), ref(F.lit("later")))).otherwise(F.array().cast("array<struct<table:string,id:string>>"))
    own = sv.attached(docs.select("doc_id", refs.alias("refs"), F.array(F.struct(F.lit("key").alias("kind"))).alias("rows")), "rows")
    return sv.linked(x, m).select("doc_id", "memory_content").join(own.select("doc_id", F.col("memory_id").alias("attached_to")), "doc_id", "left")


@query(f"""SELECT qid, "table", id, score AS near_score FROM ({HYBRID_SQL.replace("CASE WHEN tbl = 'semantic' THEN 0.08::DOUBLE ELSE 0::DOUBLE END + ", "").replace('score >= 0.35', 'score >= 0.3')}) WHERE rank = 1""")
def nearest_memory(spark, d):
    """The nearest known memory of each new text."""
    new = questions(spark, d).drop("preferred")
    return sv.nearest_known(new, document_memories(spark, d)).drop("user_id")


PLANNED_SQL = HYBRID_SQL.replace("CASE WHEN tbl = 'semantic' THEN 0.08::DOUBLE", "CASE WHEN tbl = 'semantic' OR qid % 3 = 0 THEN 0.08::DOUBLE").replace(
    "FROM benchmark", "FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), 1, 12), ' ') || ' ' ELSE '' END || text AS text FROM benchmark)"
)


@query(f"""WITH h AS ({PLANNED_SQL}), p AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 5 ELSE least(5, item_id % 9) END AS most, item_id % 3 = 0 AS plan_fallback FROM benchmark)
SELECT qid, rank, "table", id, score, plan_fallback FROM h JOIN p ON item_id = qid WHERE rank <= most""")
def recall_batch(spark, d):
    """Recall with plans: sound ones prefer semantic memories; a third is broken and
    falls back to both tables and the call's top_k."""
    body = F.to_json(F.struct(F.lit("recall").alias("intent"), F.array(F.lit("semantic")).alias("target_tables"), (F.col("qid") % 9).cast("string").alias("top_k")))
    asked = questions(spark, d).drop("preferred").withColumn("raw", F.when(F.col("qid") % 3 == 0, F.lit("{bad")).otherwise(body))
    return sv.recall(asked, document_memories(spark, d), "raw").drop("user_id")


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'recall_context' ELSE CASE WHEN doc_id % 2 = 0 THEN 'ignore' ELSE 'store' END END AS action, doc_id % 4 AS n FROM documents), r AS (SELECT count(*) AS n, avg((action = 'ignore')::INT) AS i, avg((action = 'recall_context')::INT) AS c, avg((n > 2)::INT) AS x FROM a)
SELECT unnest(list_filter([CASE WHEN i > 0.45 THEN 'ignore_overrepresented' END, CASE WHEN c < 0.05 THEN 'recall_underrepresented' END, CASE WHEN x < 0.35 THEN 'indexables_underrepresented' END], lambda w: w IS NOT NULL)) AS warning FROM r WHERE n >= 100""")
def dataset_warnings(spark, d):
    """A7."""
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(F.when(k % 10 == 0, "recall_context").when(k % 2 == 0, "ignore").otherwise("store").alias("action"), F.greatest(F.lit(0), k % 4 - 2).alias("n"))
    return e.dataset_warnings(rows, "action", "n")


@query("""WITH r AS (SELECT event_type, round(value, 2) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 2)) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(avg(v), 3) AS mean, round(median(v), 3) AS p50, round(max(v) FILTER (p = greatest(0, floor(n * 0.95::DOUBLE)::BIGINT - 1)), 3) AS p95 FROM r GROUP BY event_type""")
def latency_summary(spark, d):
    """A9 by event type."""
    return e.latency_summary(read(spark, d, "events").select("event_type", F.round("value", 2).alias("v")), ["event_type"], "v")


@query("""SELECT count(*) FILTER (coalesce(text, '') <> '') AS text, count(*) FILTER (doc_id % 3 = 0) AS source, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 2 <> 0) AS lang FROM documents""")
def filled_counts(spark, d):
    """A18."""
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select("text", F.when(k % 3 == 0, F.col("source")).alias("source"), F.when(k % 4 != 0, F.when(k % 2 == 0, "").otherwise(F.col("lang"))).alias("lang"))
    return e.filled_counts(rows, ["text", "source", "lang"])


@query("""WITH r AS (SELECT source, CASE WHEN length(text) < 300 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents) SELECT source, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY source, reason UNION ALL SELECT NULL, reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def skip_histogram(spark, d):
    """A20."""
    return e.skip_histogram(read(spark, d, "documents").select("source", F.when(F.length("text") < 300, "short").when(F.col("lang") != "en", "language").alias("reason")), "source", "reason")


@query("""WITH r AS (SELECT source, doc_id % 3 AS f, regexp_matches(text, '\\b\\d{4}\\b') AS y FROM documents), q AS (SELECT source, count(*) AS n FROM r GROUP BY source ORDER BY n DESC, source LIMIT 6)
SELECT 'rows' AS measure, '' AS key, count(*) AS n FROM r UNION ALL SELECT 'with_facts', '', count(*) FILTER (f > 0) FROM r UNION ALL SELECT 'with_temporal', '', count(*) FILTER (y) FROM r UNION ALL SELECT 'source', source, n FROM q""")
def curriculum_audit(spark, d):
    """The six largest sources are the report."""
    rows = read(spark, d, "documents").select("source", (F.col("doc_id") % 3).alias("f"), F.col("text").rlike(t.word("[0-9]{4}")).alias("y"))
    return e.curriculum_audit(rows, "source", "f", "y")


@query("""SELECT role AS task, conv_id::VARCHAR AS prefix, count(*) AS n FROM conversations GROUP BY role, conv_id""")
def mix_counts(spark, d):
    """A28."""
    return e.mix_counts(read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn", "role").alias("id"), "role"), "id", "role")


@query("""SELECT lang AS model, count(*) AS n, avg((doc_id % 7 <> 0)::INT::DOUBLE) AS valid_rate, avg((doc_id % 3 = 0)::INT::DOUBLE) AS store_rate, avg(n_chars) AS mean_tokens, round(avg(n_chars) * 50000 * CASE lang WHEN 'en' THEN 2.5::DOUBLE WHEN 'de' THEN 1::DOUBLE ELSE 0::DOUBLE END / 1e6::DOUBLE, 4) AS cost FROM documents GROUP BY lang""")
def teacher_comparison(spark, d):
    """A30 with languages as models."""
    rows = read(spark, d, "documents").select(F.col("lang").alias("model"), (F.col("doc_id") % 7 != 0).alias("valid"), (F.col("doc_id") % 3 == 0).alias("stored"), F.col("n_chars").alias("tokens"))
    return e.teacher_comparison(rows, "model", 50_000, {"en": 2.5, "de": 1.0})


@query("""WITH m AS (SELECT avg((doc_id % 11 <> 0)::INT::DOUBLE) AS p, avg((doc_id % 40 <> 0)::INT::DOUBLE) AS q FROM documents)
SELECT p >= 0.95 AND q >= 0.95 AND false AS passed, array_to_string(list_sort(list_filter([CASE WHEN p < 0.95 THEN 'storage:parse_valid_rate' END, CASE WHEN q < 0.95 THEN 'recall:parse_valid_rate' END, 'storage:schema_valid_rate', 'storage:action_accuracy', 'storage:memory_type_accuracy', 'storage:memory_content_exact_rate', 'storage:fact_count_accuracy', 'storage:facts_exact_rate',
'recall:schema_valid_rate', 'recall:target_tables_exact_rate', 'recall:target_tables_primary_rate', 'recall:ranking_hints_score', 'recall:top_k_exact_rate'], lambda x: x IS NOT NULL)), ',') AS failed FROM m""")
def dual_gate(spark, d):
    """Metrics that are missing fail."""
    docs = read(spark, d, "documents")
    one, two = (docs.agg(e.rate(F.col("doc_id") % k != 0).alias("parse_valid_rate")) for k in (11, 40))
    return e.dual_gate(e.gate(one, "expanded"), e.gate(two, "recall")).withColumn("failed", F.array_join("failed", ","))


@query("""SELECT stage, checked, failed, ran FROM (SELECT 'schema' AS stage, count(*) AS checked, 0 AS failed, true AS ran FROM documents UNION ALL SELECT 'runtime', count(*), count(*) FILTER (length(text) < 200), true FROM documents
UNION ALL SELECT 'quality', CASE WHEN count(*) FILTER (length(text) < 200) = 0 THEN count(*) ELSE 0 END, 0, count(*) FILTER (length(text) < 200) = 0 FROM documents)""")
def gate_stages(spark, d):
    """Schema, runtime and quality, in that order."""
    docs = read(spark, d, "documents")
    return v.gated(docs.count(), [("schema", F.col("doc_id").isNotNull()), ("runtime", F.length("text") >= 200), ("quality", F.col("lang").isNotNull())], docs)


@query("""WITH u AS (SELECT 'a' AS dataset, 'train' AS split, 0 AS o, 0 AS part, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'b', 'train', 0, 2, doc_id FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'a', 'validation', 1, 1, doc_id FROM documents WHERE doc_id % 3 = 2)
SELECT dataset, split, doc_id, row_number() OVER (ORDER BY o, part, doc_id) AS line FROM u""")
def merged_datasets(spark, d):
    """A concatenation with names; lines are numbered for the comparison only."""
    from pyspark.sql import Window

    docs = read(spark, d, "documents").select("doc_id")
    parts = [("a", "train", docs.filter("doc_id % 3 = 0")), ("a", "validation", docs.filter("doc_id % 3 = 2")), ("b", "train", docs.filter("doc_id % 3 = 1"))]
    return sv.concatenated(parts, "doc_id").select("dataset", "split", "doc_id", F.row_number().over(Window.orderBy("place")).cast("long").alias("line"))


@query("""SELECT d.doc_id, quality, (SELECT string_agg(c.role || ':' || c.turn, ',' ORDER BY c.role || ':' || c.turn) FROM conversations c WHERE c.conv_id = d.doc_id) AS facts FROM documents d JOIN labels USING (doc_id)""")
def memories_with_facts(spark, d):
    """Gold rows of labelled documents, with facts grouped by source."""
    gold = sv.gold_rows(read(spark, d, "labels").select("doc_id", "quality"), read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    facts = read(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.concat_ws(":", "role", "turn").alias("fact"))
    out = sv.with_facts(gold.withColumn("source_id", F.col("doc_id")), facts)
    return out.select("doc_id", "quality", F.nullif(F.array_join("facts", ","), F.lit("")).alias("facts"))


@query("""WITH e AS (SELECT conv_id AS qid, count(*) FILTER (turn % 3 = 0) AS n, bool_or(turn % 3 = 0 AND turn % 2 = 0) AS ingested FROM conversations GROUP BY conv_id) SELECT qid, ingested FROM e WHERE n > 0""")
def evidence_gate(spark, d):
    """Questions with evidence, and those with some that was ingested."""
    c = read(spark, d, "conversations")
    name = F.concat_ws(":", "conv_id", "turn")
    asked = c.groupBy(F.col("conv_id").alias("qid")).agg(F.collect_list(F.when(F.col("turn") % 3 == 0, name)).alias("evidence"))
    ingested = c.filter("turn % 2 = 0").select(name.alias("id"))
    only = v.answerable(asked, ingested, True).select("qid", F.lit(True).alias("ingested"))
    return v.answerable(asked, ingested).select("qid").join(only, "qid", "left").withColumn("ingested", F.coalesce("ingested", F.lit(False)))


QUERIES, ORACLE_SQL = Q, SQL
