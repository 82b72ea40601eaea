"""Queries over the stateful service and its judges, row validators and calibration."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylight.functions import lean, plain
from quarrylight.functions import text as t
from quarrylight.operators import curation as cu
from quarrylight.operators import evaluation as e
from quarrylight.operators import schema as sc
from quarrylight.plans import sqltext as s
from quarrylight.operators import service as sv
from quarrylight.plans.ranking_queries import FACTS_SQL, HYBRID_SQL, conversation_facts, document_memories, questions, read
from quarrylight.plans.store_queries import raw_decisions
from quarrylight.plans.stream_queries import scratch
from quarrylight.sources import sqlite
from quarrylight.streaming import remember as rm

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def overlap_judge(new: str, near_id: str, old: str) -> str | None:
    """A stand-in for the consolidator: texts that share most words are merged, of
    those that share half one is in conflict; every fifth answer is broken."""
    a, b = set(plain.significant_tokens(new)), set(plain.significant_tokens(old))
    shared = len(a & b) / max(1, len(a))
    if len(new) % 5 == 0:
        return "no answer"
    if shared >= 0.8:
        merged = old if len(new) % 3 == 0 else f"{old} {new}"
        return "Merge: " + json.dumps({"action": "UPDATE_existing", "target_memory_id": near_id, "merged_content": merged})
    return json.dumps({"action": "flag_conflict" if shared >= 0.5 else "store_episodic"})


def requests(spark, d):
    """Turns as requests of a few users each, in order, with sources in chunks."""
    rows = raw_decisions(spark, d)
    seq = F.col("conv_id") * 1000 + F.col("turn")
    source = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("log:chunk-"), "turn")).when(F.col("turn") % 3 == 1, F.lit("log"))
    own = rows.withColumns({"user_id": (F.col("conv_id") % 40).cast("string"), "seq": seq, "request_id": F.concat_ws(":", "conv_id", "turn"), "repaired": F.lit("still not json"), "source_id": source, "source_timestamp": F.lit("2024-05-08"), "extra_tags": F.array(F.lit("turn"))})
    return rm.prepared(own, "raw", "repaired", "source_text")


@query()
def remember_in_order(spark, d):
    """C11, C10, C5, F51, 2.12a: each turn meets what earlier ones of its user wrote."""
    return rm.remembered(requests(spark, d), overlap_judge).drop("seq")


@query()
def remember_as_stream(spark, d):
    """C11 as a stream, with the state of each user kept by Spark."""
    root = scratch(spark)
    requests(spark, d).repartition(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rm.PREPARED).parquet(f"{root}/in")
    out = rm.remember_stream(stream, overlap_judge)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rm.OUT).parquet(f"{root}/out").drop("seq")


SEARCHED = "FROM (SELECT item_id, CASE WHEN item_id % 2 = 1 THEN 'river ' ELSE '' END || text AS text FROM benchmark)"


@query(f"""WITH facts AS (SELECT qid, rank, id, score FROM ({FACTS_SQL.replace('FROM benchmark', SEARCHED).replace('rank <= 5', 'rank <= 20').replace('AS confidence, text FROM conversations', 'AS confidence, text FROM conversations ORDER BY pos LIMIT 200')})),
mems AS (SELECT qid, rank, "table", id, score FROM ({HYBRID_SQL.replace('FROM benchmark', SEARCHED).replace('rank <= 5', 'rank <= 20').replace('score >= 0.35', 'score >= 0.15')})),
both_ AS (SELECT qid, rank, 'memory_fact' AS "table", id, score, 0 AS prio FROM facts UNION ALL SELECT qid, rank, "table", id, score, 1 FROM mems),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prio, rank) AS place FROM both_) SELECT qid, place, "table", id, false AS rendered FROM placed WHERE place <= 3""")
def context_batch(spark, d):
    """2.13a, R13, R14: a context for each question, from plans with hints; renderings
    that name nothing known fall back to the exact rows."""
    plan = F.to_json(F.struct(F.array(F.lit("semantic")).alias("target_tables"), F.when(F.col("qid") % 2 == 1, F.array(F.lit("river"))).alias("ranking_hints"), F.lit("3").alias("top_k")))
    render = F.when(F.col("qid") % 3 == 0, F.lit("no render")).otherwise(F.lit('{"context_items": [{"id": "nowhere", "content": "river"}]}'))
    asked = questions(spark, d).drop("preferred").withColumns({"plan": plan, "render": render})
    facts = conversation_facts(spark, d).withColumn("content", F.col("value_text"))
    return sv.context(asked, document_memories(spark, d), facts, "plan", "render").select("qid", "place", "table", "id", "rendered")


@query()
def remember_chunked(spark, d):
    """C13, 2.13a: long texts remembered by segments, each with its own source, in order."""
    docs = read(spark, d, "documents")
    asked = docs.select((F.col("doc_id") % 50).cast("string").alias("user_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("request_id"), "text", F.col("source").alias("source_id"))
    chunks = rm.chunk_requests(asked, "text", 300, 50)
    raw = F.to_json(F.struct(F.when(F.col("chunk") % 4 == 3, "ignore").otherwise("store_episodic").alias("action"), F.struct(F.col("text").alias("content")).alias("memory"), F.lit("r").alias("reasoning")))
    chunks = chunks.withColumns({"raw": raw, "repaired": F.lit("")})
    return rm.chunked(chunks, rm.remembered(rm.prepared(chunks, "raw", "repaired", "text"), overlap_judge), "text")


SCORED_SQL = "SELECT doc_id, len(regexp_replace(text, '[^a-z]', '', 'g')) / len(text)::DOUBLE AS p, quality = 1 AS y, doc_id % 5 AS fold FROM documents JOIN labels USING (doc_id) WHERE text <> ''"


@query(f"""WITH r AS ({SCORED_SQL}), k AS (SELECT fold, floor(p * 100 + 1e-9)::INT AS cent, y FROM r), m AS (SELECT i::INT AS mark FROM range(5, 96) t(i)),
s AS (SELECT mark, fold, sum(((cent >= mark) = y)::INT)::BIGINT AS own FROM k, m GROUP BY mark, fold), t AS (SELECT *, sum(own) OVER (PARTITION BY mark) AS every FROM s),
c AS (SELECT fold, arg_max(mark, (every - own) * 1000 - mark) AS mark, arg_max(own, (every - own) * 1000 - mark) AS own FROM t GROUP BY fold), w AS (SELECT mark, any_value(every) AS every FROM t GROUP BY mark), n AS (SELECT count(*) AS n FROM r)
SELECT n::BIGINT AS n, (SELECT every FROM w WHERE mark = 50) / n AS accuracy_half, (SELECT arg_max(mark, every * 1000 - mark) FROM w) / 100 AS threshold, (SELECT max(every) FROM w) / n AS accuracy_fit, (SELECT string_agg((mark / 100)::VARCHAR, ',' ORDER BY fold) FROM c) AS fold_thresholds, (SELECT sum(own) FROM c) / n AS accuracy_held_out FROM n""")
def calibrated_threshold(spark, d):
    """A threshold on the share of small letters that tells good texts, by five folds."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    share = F.length(F.regexp_replace("text", "[^a-z]", "")) / F.length("text")
    rows = docs.filter("text != ''").join(labels, "doc_id").select(share.alias("p"), (F.col("quality") == 1).alias("y"), (F.col("doc_id") % 5).alias("fold"))
    out = e.calibrated(rows, "p", "y", "fold")
    return out.withColumn("fold_thresholds", F.array_join("fold_thresholds", ","))


def training_rows(spark, d):
    """Turns as training rows in JSON, most of them with one thing broken."""
    k = (F.col("turn") + F.col("conv_id")) % 10
    none = F.lit(None).cast("string")
    memory = F.struct(F.col("text").alias("content"), F.when(F.col("role") == "user", "episodic").otherwise(F.when(F.col("role") == "assistant", "semantic").otherwise(F.col("role"))).alias("type"), F.when(k == 6, F.lit("high")).alias("strength"), F.array(F.lit("turn"), F.when(k == 7, F.lit(" ")).otherwise(F.lit("x"))).alias("tags"))
    fact = F.struct(F.col("role").alias("subject"), F.when(k == 2, F.lit("Said In")).otherwise(F.lit("said_in")).alias("predicate"), F.col("text").alias("value"), F.lit("explicit").alias("inference_kind"), F.when(k != 3, F.lit("turn text")).alias("evidence_text"))
    decision = F.struct(F.when(k == 0, F.lit("store")).otherwise(F.lit("store_episodic")).alias("action"), F.when(k != 1, memory).alias("memory"), F.array(fact).alias("facts"), F.lit("r").alias("reasoning"))
    payload = F.struct(F.when(k != 4, F.concat(F.lit("User: "), "text")).otherwise(none).alias("conversation"))
    row = F.struct(F.col("conv_id").cast("string").alias("id"), payload.alias("input"), decision.alias("expected"), F.when(k == 5, F.lit("dev")).otherwise(F.lit("train")).alias("split"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.when(k == 8, F.lit("{broken")).otherwise(F.to_json(row)).alias("raw"))


ROWS_SQL = r"""r AS (SELECT conv_id, turn, text, role, (turn + conv_id) % 10 AS k FROM conversations),
i AS (SELECT conv_id, turn, k, unnest([
  CASE WHEN k = 8 THEN ['$', 'invalid JSON'] END, CASE WHEN k = 4 THEN ['$.input', 'input must include conversation, question, user_prompt, source, context, or prompt'] END,
  CASE WHEN k = 0 THEN ['$.expected.action', 'unsupported action: store'] END,
  CASE WHEN k NOT IN (1, 8) AND NOT regexp_matches(text, '\S') THEN ['$.expected.memory.content', 'required non-empty string'] END,
  CASE WHEN k NOT IN (1, 8) AND role NOT IN ('user', 'assistant') THEN ['$.expected.memory.type', 'unsupported memory type: ' || role] END,
  CASE WHEN k = 7 THEN ['$.expected.memory.tags', 'tags must be a list of non-empty strings'] END, CASE WHEN k = 6 THEN ['$.expected.memory.strength', 'must be a finite number when present'] END,
  CASE WHEN k = 1 THEN ['$.expected.memory', 'store_episodic decisions require memory'] END, CASE WHEN k = 2 THEN ['$.expected.facts[0].predicate', 'predicate must be snake_case'] END,
  CASE WHEN k = 3 THEN ['$.expected.facts[0].evidence_text', 'required non-empty string'] END, CASE WHEN k = 5 THEN ['$.split', 'split must be train, validation, test, or probe'] END]) AS x FROM r)"""


@query(f"WITH {ROWS_SQL} SELECT conv_id, turn, x[1] AS path, x[2] AS message FROM i WHERE x IS NOT NULL")
def training_row_issues(spark, d):
    """the issues of training rows, with their paths."""
    rows = sc.judged(training_rows(spark, d), "raw", sc.training_issues)
    return rows.select("conv_id", "turn", F.explode("issues").alias("x")).select("conv_id", "turn", "x.path", "x.message")


@query(f"""WITH {ROWS_SQL}, v AS (SELECT conv_id, role FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE x IS NOT NULL AND i.conv_id = r.conv_id AND i.turn = r.turn)),
t AS (SELECT count(*) AS n, (SELECT count(*) FROM r) AS total FROM v), y AS (SELECT string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM (SELECT CASE role WHEN 'user' THEN 'episodic' ELSE 'semantic' END AS type, count(*) AS n FROM v GROUP BY 1)),
u AS (SELECT string_agg(id, ',' ORDER BY id) AS duplicates FROM (SELECT conv_id::VARCHAR AS id FROM v GROUP BY conv_id HAVING count(*) > 1))
SELECT total, n AS valid, 'store_episodic:' || n AS actions, types, 'storage:' || n AS tasks, coalesce(duplicates, '') AS duplicates, total = n AND duplicates IS NULL AS ok FROM t, y, u""")
def training_row_gate(spark, d):
    """A4: totals and counts by action, memory type and task, and duplicate ids."""
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws(":", x.key, x.value)), ",").alias(c)
    return sc.dataset_gate(training_rows(spark, d), "raw").select("total", "valid", flat("actions"), flat("types"), flat("tasks"), F.array_join("duplicates", ",").alias("duplicates"), "ok")


def lean_decisions(spark, d):
    """Turns as decisions: conv_id, turn, and the structs of a decision."""
    k, said = F.col("turn") + F.col("conv_id"), t.squeeze("text")
    none = F.lit(None).cast("string")
    memory = F.struct(
        F.lit("episodic").alias("type"), said.alias("content"), (F.col("turn") / 7).alias("strength"), F.when(k % 3 == 0, F.lit(0.00002)).alias("decay_rate"), F.lit(None).cast("double").alias("emotional_weight"), F.lit(1.0).alias("confidence"),
        F.array(F.lit("turn"), F.col("role")).alias("tags"), F.when(k % 2 == 0, F.lit("last week")).alias("temporal_expression"), none.alias("resolved_time"),
    )
    fact = F.struct(F.col("role").alias("subject"), F.lit("said_in").alias("predicate"), said.alias("value_text"), (F.col("conv_id") * 1000.5).alias("confidence"), none.alias("inference_kind"), F.lit("turn = text").alias("evidence_text"), none.alias("temporal_expression"), F.lit("2024").alias("resolved_time"))
    rows = read(spark, d, "conversations").filter(said != "")
    return rows.select("conv_id", "turn", F.when(k % 4 == 0, "ignore").otherwise("store_episodic").alias("action"), F.when(k % 4 != 0, memory).alias("memory"), F.when(k % 4 == 1, F.array(fact)).otherwise(F.filter(F.array(fact), lambda x: F.lit(False))).alias("facts"), F.lit("why").alias("reasoning"))


@query(rf"""WITH r AS (SELECT conv_id, turn, role, turn + conv_id AS k, {s.squeeze('text')} AS said FROM conversations), x AS (SELECT *, chr(10) AS n FROM r WHERE said <> '')
SELECT conv_id, turn, CASE WHEN k % 4 = 0 THEN '@a ignore' || n || '@m none' ELSE '@a store_episodic' || n || '@t episodic' || n || '@c ' || said || n || '@s ' || printf('%g', turn / 7.0::DOUBLE) || CASE WHEN k % 3 = 0 THEN n || '@d 2e-05' ELSE '' END || n || '@p 1' || n || '@g turn ' || role || CASE WHEN k % 2 = 0 THEN n || '@te last week' ELSE '' END
  || CASE WHEN k % 4 = 1 THEN n || '@f' || n || 'sub=' || role || n || 'pred=said_in' || n || 'val=' || said || n || 'conf=' || printf('%g', conv_id * 1000.5::DOUBLE) || n || 'kind=explicit' || n || 'ev=turn = text' || n || 'frt=2024' || n || '@ef' ELSE '' END END || n || '@r why' || n || '@end' AS at_tag,
CASE WHEN k % 4 = 0 THEN 'ignore' ELSE 'store: ' || said END AS minimal, CASE WHEN k % 4 = 0 THEN 'ignore' ELSE 'store' END AS binary, 0 AS n_issues, CASE WHEN k % 4 <> 0 THEN said END AS content, CASE WHEN k % 4 <> 0 THEN said END AS minimal_content, CASE WHEN k % 4 = 0 THEN 'ignore' ELSE 'store_episodic' END AS binary_action FROM x""")
def lean_formats(spark, d):
    """decisions as @tag blocks, minimal and binary lines, and read back."""
    rows = lean_decisions(spark, d)
    made = rows.select("conv_id", "turn", lean.at_tag(F.col("action"), F.col("memory"), F.col("facts"), F.col("reasoning")).alias("at_tag"), lean.minimal(F.col("action"), F.col("memory.content")).alias("minimal"), lean.binary(F.col("action")).alias("binary"))
    back = lean.parse_at_tags(made, "at_tag")
    return back.select("conv_id", "turn", "at_tag", "minimal", "binary", F.size("issues").alias("n_issues"), F.get_json_object("decision", "$.memory.content").alias("content"), lean.parse_minimal(F.col("minimal")).content.alias("minimal_content"), lean.parse_binary(F.col("binary")).action.alias("binary_action"))


@query("SELECT doc_id, lang, text FROM documents WHERE n_chars >= 200 AND lang <> 'en'")
def sqlite_source(spark, d):
    """Documents written to SQLite files and read back by ranges, with a filter."""
    root = f"{scratch(spark)}/db"
    sqlite.write_sqlite(read(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), root, "documents")
    rows = sqlite.read_sqlite(spark, root, "documents", "doc_id long, lang string, n_chars long, text string", rows=500)
    return rows.filter("n_chars >= 200 AND lang != 'en'").select("doc_id", "lang", "text")


def _matches(pattern: str) -> str:
    return "regexp_matches(low, '" + pattern.replace("'", "''") + "')"


OPENINGS = ["It failed: ", "You must see: ", "Validation of ", "I''m on ", "", "Results: the score of "]


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS pos, [{', '.join(f"'{x}'" for x in OPENINGS)}][(conv_id + turn) % 6 + 1] || text AS text, role = 'assistant' AS a FROM conversations), m AS (SELECT *, lower(text) AS low FROM t),
b AS (SELECT *, CASE WHEN {_matches(cu.BUCKETS[0][1])} THEN 'correction' WHEN {_matches(cu.BUCKETS[1][1])} THEN 'rule' WHEN {_matches(cu.TOPICS + '|' + cu.MILESTONES)} THEN 'milestone' WHEN a AND {_matches(cu.NARRATION)} THEN 'transient' WHEN {_matches(cu.REPLIES)} THEN 'transient' END AS bucket,
  CASE WHEN {_matches(cu.TOPICS)} THEN 3 ELSE 0 END + CASE WHEN length(text) < 30 THEN -2 ELSE 0 END + {' + '.join(f'CASE WHEN {_matches(p)} THEN {n} ELSE 0 END' for p, n in cu.POINTS)} AS points FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY points DESC, pos) AS k FROM b WHERE bucket IS NOT NULL),
q AS (SELECT *, k <= CASE bucket WHEN 'correction' THEN 13 WHEN 'rule' THEN 16 WHEN 'milestone' THEN 20 ELSE 9 END AS own FROM r),
p AS (SELECT *, CASE WHEN own THEN 0 ELSE row_number() OVER (PARTITION BY own ORDER BY points DESC, pos) END AS spare FROM q), f AS (SELECT * FROM p WHERE own OR spare <= 60 - (SELECT count(*) FROM q WHERE own)),
d AS (SELECT *, row_number() OVER (PARTITION BY left(lower(text), 160) ORDER BY pos) AS first FROM f) SELECT pos, bucket, points FROM d WHERE first = 1 ORDER BY pos LIMIT 60""")
def mined_candidates(spark, d):
    """Sixty turns worth labelling, by quotas of buckets; turns open in several ways."""
    text, opening = F.col("text"), F.get(F.array(*[F.lit(x.replace("''", "'")) for x in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    rows = read(spark, d, "conversations").withColumn("text", F.concat(opening, "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text", cu.candidate_bucket(text, F.col("role") == "assistant").alias("bucket"), cu.candidate_points(text).alias("points"))
    return cu.mined_candidates(rows, 60).select("pos", "bucket", "points")


QUERIES, ORACLE_SQL = Q, SQL
