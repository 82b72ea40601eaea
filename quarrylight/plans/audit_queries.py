"""Audit and calibration queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from quarrylight.operators import audit as a
from quarrylight.operators import evaluation as e
from quarrylight.operators import ranking as r
from quarrylight.operators.curation import phrase_matches
from quarrylight.plans import sqltext as s
from quarrylight.plans.ranking_queries import HYBRID_SQL, document_memories, questions, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH ev AS (SELECT item_id AS qid, list(doc_id::VARCHAR) AS ids FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id), sel AS (SELECT qid, list(id ORDER BY rank) AS ids FROM ({HYBRID_SQL}) GROUP BY qid)
SELECT count(*) AS questions, avg(list_has_any(ev.ids, sel.ids[1:1])::INT::DOUBLE) AS hit_at_1, avg(list_has_any(ev.ids, sel.ids[1:5])::INT::DOUBLE) AS hit_at_5 FROM ev JOIN sel USING (qid)""")
def retrieval_evaluation(spark, d):
    """Whether ranking finds documents that hold a question's text."""
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    held = phrase_matches(docs.select(F.col("doc_id").alias("_k"), F.col("text").alias("norm")), b.select(F.col("text").alias("phrase")))
    evidence = held.join(b.select("item_id", F.col("text").alias("phrase")), "phrase").groupBy(F.col("item_id").alias("qid")).agg(F.collect_list(F.col("_k").cast("string")).alias("evidence"))
    found = r.hybrid_rank(questions(spark, d), document_memories(spark, d), 5, 0.35).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("ids"))
    both = evidence.join(found, "qid")
    return both.agg(F.count("*").alias("questions"), *[e.rate(e.hit_at(F.col("evidence"), F.col("ids"), k)).alias(f"hit_at_{k}") for k in (1, 5)])


@query("SELECT label, count(*) AS n, min(len(embedding))::INT AS least, max(len(embedding))::INT AS most FROM embeddings GROUP BY label")
def embedding_sizes(spark, d):
    """A16."""
    return read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def top_kinds(spark, d):
    """A17."""
    return e.count_by(read(spark, d, "events"), "event_type").orderBy(F.col("n").desc(), "key").limit(10).select(F.col("key").alias("event_type"), "n")


CONV = "(SELECT conv_id, turn, role, text, lower(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ ', ''), ' $', '')) AS x FROM conversations)"


def _sql_any(words: list[str]) -> str:
    return "(" + " OR ".join("contains(x, '" + w.replace("'", "''") + "')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN {_sql_any(a.NOISE)} AND NOT {_sql_any(a.DURABLE)} THEN 'ignore' WHEN {_sql_any(a.CONFLICTS)} AND turn % 2 = 0 AND {_sql_any(a.REPLACEMENTS)} THEN 'flag_and_store' WHEN {_sql_any(a.CONFLICTS)} AND turn % 2 = 0 THEN 'flag_conflict'
WHEN {_sql_any(a.UPDATES)} AND turn % 2 = 0 THEN 'update_existing' WHEN {_sql_any(a.RULES)} THEN 'promote_semantic' WHEN regexp_matches(x, '\\b(?:{a.EVENT_TIME})\\b') OR {_sql_any(a.EVENTS)} THEN 'store_episodic' ELSE role END AS action FROM {CONV}""")
def calibrated_actions(spark, d):
    """C14 over turns; even turns have context, the role stands for the model's action."""
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", a.calibrated_action(F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit("known"))).alias("action"))


SAID = """CASE turn % 5 WHEN 0 THEN '# Tools ' WHEN 1 THEN '{"status": "in_progress"} ' ELSE '' END || text"""


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{a.TRANSIENT.replace("'", "''")}') THEN 'transient' WHEN regexp_matches(lower(text), '{a.CORRECTION.replace("'", "''")}') THEN 'correction' WHEN regexp_matches(lower(text), '{a.RULE.replace("'", "''")}') THEN 'rule' WHEN regexp_matches(lower(text), 'harbour|{a.MILESTONE}') THEN 'milestone' ELSE 'other' END AS kind,
length(text) BETWEEN 16 AND 5000 AND NOT regexp_matches(text, '(?i)^<permissions instructions>|^<environment_context>|# Tools|base_instructions|developer instructions') AND NOT regexp_matches(text, '(?i)^\\{{ ?"status": ?"in_progress"') AS usable FROM (SELECT conv_id, turn, {SAID} AS text FROM conversations)""")
def message_classes(spark, d):
    """C15, P11."""
    opening = F.when(F.col("turn") % 5 == 0, "# Tools ").when(F.col("turn") % 5 == 1, '{"status": "in_progress"} ').otherwise("")
    said = F.concat(opening, F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", a.message_class(said, ("harbour",)).alias("kind"), a.usable(said).alias("usable"))


@query("""WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 200 THEN 'low:short' END, CASE WHEN text LIKE '%|%' THEN 'high:bars' END, CASE WHEN n_chars <> length(text) THEN 'medium:size' END], lambda x: x IS NOT NULL)) AS k FROM documents),
c AS (SELECT k, count(*) AS n FROM i GROUP BY k), f AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM i)
SELECT split_part(c.k, ':', 1) AS severity, split_part(c.k, ':', 2) AS reason, n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM c JOIN f USING (k) WHERE rn <= 20 GROUP BY c.k, n""")
def issue_report(spark, d):
    """A19, A61-like rules over documents."""
    rule = lambda c, sev, why: F.when(c, F.struct(F.lit(sev).alias("severity"), F.lit(why).alias("reason")))
    issues = F.array_compact(F.array(rule(F.length("text") < 200, "low", "short"), rule(F.col("text").contains("|"), "high", "bars"), rule(F.col("n_chars") != F.length("text"), "medium", "size")))
    return a.issue_counts(read(spark, d, "documents"), "doc_id", issues).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("SELECT count(*) AS total, count(*) FILTER (length(text) >= 200) AS valid, count(*) FILTER (length(text) >= 200)::DOUBLE / count(*) AS valid_rate, (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1)) AS duplicate_ids FROM conversations")
def dataset_gate(spark, d):
    """A4."""
    return a.dataset_gate(read(spark, d, "conversations"), "conv_id", F.length("text") >= 200)


@query("""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS i FROM documents), p AS (SELECT i[k] || ' ' || i[k + 1] AS pair FROM (SELECT i, unnest(range(1, len(i))) AS k FROM w WHERE len(i) >= 2))
SELECT pair, count(*) AS n FROM p GROUP BY pair ORDER BY n DESC, length(pair) DESC, pair LIMIT 50""")
def word_pairs(spark, d):
    """The fifty most frequent pairs of neighbours (a report)."""
    return a.top_pairs(read(spark, d, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 50)


@query("""WITH ev AS (SELECT conv_id AS sample, conv_id * 10 AS qid, unnest([0, 3, 99]) AS id FROM (SELECT DISTINCT conv_id FROM conversations)), mine AS (SELECT sample, qid, ev.id FROM ev JOIN conversations c ON c.conv_id = sample AND c.turn = ev.id),
want AS (SELECT sample, qid, greatest(4, 2 * count(*)) AS want FROM mine GROUP BY ALL), rest AS (SELECT sample, qid, turn AS id, want, row_number() OVER (PARTITION BY sample, qid ORDER BY turn) AS rn FROM want JOIN conversations c ON c.conv_id = sample WHERE turn NOT IN (0, 3, 99))
SELECT sample, qid, id, 'evidence' AS kind FROM mine UNION ALL SELECT sample, qid, id, 'distractor' FROM rest WHERE rn <= want""")
def evidence_and_distractors(spark, d):
    """Turns 0 and 3 as evidence, others as distractors."""
    c = read(spark, d, "conversations")
    evidence = c.select(F.col("conv_id").alias("sample"), (F.col("conv_id") * 10).alias("qid")).distinct().withColumn("ids", F.array(*[F.lit(x).cast("long") for x in (0, 3, 99)]))
    return a.distractors(evidence, c.select(F.col("conv_id").alias("sample"), F.col("turn").cast("long").alias("id"), F.col("turn").alias("pos")))


@query("""SELECT n_name, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderkey LIMIT 1200""")
def three_way_join(spark, d):
    """An inner join of three, ordered, the first 1200 (the operator's own limit)."""
    o, c, n = (read(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).orderBy("o_orderkey").limit(1200).select("n_name", "o_orderkey", "c_name")  # 25 nations


@query("""WITH x AS (SELECT doc_id, lang, doc_id % 3 <> 0 AS model_would_store, doc_id % 5 <> 0 AS effective_stored, doc_id % 7 <> 0 AS content_grounded, doc_id % 11 = 0 AS curriculum_bleed, doc_id % 13 = 0 AS guard_rejected, doc_id % 2 = 0 AS action_match FROM documents)
SELECT lang, count(*) AS cases, count(*) FILTER (model_would_store) AS model_stored, count(*) FILTER (effective_stored) AS effective, round(coalesce(avg(content_grounded::INT::DOUBLE) FILTER (effective_stored), 0), 4) AS content_grounding_rate,
round(coalesce(avg(curriculum_bleed::INT::DOUBLE) FILTER (effective_stored), 0), 4) AS curriculum_bleed_rate, round(avg(guard_rejected::INT::DOUBLE), 4) AS guard_reject_rate, round(avg(action_match::INT::DOUBLE), 4) AS action_match_rate FROM x GROUP BY lang""")
def grounding_by_suite(spark, d):
    """A10, A11."""
    rows = read(spark, d, "documents").selectExpr("lang", "doc_id % 3 != 0 AS model_would_store", "doc_id % 5 != 0 AS effective_stored", "doc_id % 7 != 0 AS content_grounded", "doc_id % 11 = 0 AS curriculum_bleed", "doc_id % 13 = 0 AS guard_rejected", "doc_id % 2 = 0 AS action_match")
    return e.grounding_metrics(rows, ["lang"])


@query("""SELECT source, count(*) AS n_rows, max(c) AS most, max(c) >= 3 AS collapsed FROM (SELECT source, count(*) OVER (PARTITION BY source, left(text, 40)) AS c FROM documents) GROUP BY source""")
def collapsed_prefixes(spark, d):
    """The most frequent 40-character opening of each source."""
    counts = read(spark, d, "documents").groupBy("source", F.substring("text", 1, 40).alias("p")).agg(F.count("*").alias("c"))
    return counts.groupBy("source").agg(F.sum("c").alias("n_rows"), F.max("c").alias("most"), (F.max("c") >= 3).alias("collapsed"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(source, 3) || '.' WHEN 1 THEN 'C. D.' WHEN 2 THEN 'yes' ELSE 'plain ' || source END AS answer, doc_id % 3 = 0 OR doc_id % 3 = 2 AS correct FROM documents""")
def answers_and_verdicts(spark, d):
    """Made answers and verdicts."""
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>hm</think> Final answer: "), F.substring("source", 1, 3), F.lit("."))).when(k == 1, F.lit("A. B. C. D.")).when(k == 2, F.lit("Analysis: long\nAnswer: yes")).otherwise(F.concat(F.lit(" plain "), F.col("source")))
    )
    v = F.col("doc_id") % 3
    verdict = F.when(v == 0, F.lit('text {"correct": true, "reasoning": "r"}')).when(v == 1, F.lit("true or false")).otherwise(F.lit("It is TRUE."))
    return read(spark, d, "documents").select("doc_id", a.clean_answer(raw).alias("answer"), a.judged_correct(verdict).alias("correct"))


@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'ChatGPT can make mistakes.' WHEN 1 THEN 'Why so?' || chr(10) || ' And when? ' || chr(10) || text || chr(10) || 'Where?' ELSE text END AS t FROM documents),
k AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM x), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda v: ends_with(regexp_replace(v, '\s+$', ''), '?')) AS q FROM k)
SELECT doc_id, length(t) < 80 OR contains(lower(t), 'chatgpt can make mistakes') OR length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 40 OR (len(q) >= 3 AND len(q) * 2 >= len(string_split(t, chr(10)))) AS noise FROM l""")
def assistant_noise(spark, d):
    """P10 over documents, some of them exported pages or mostly questions."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat("text", F.lit("\nChatGPT can make mistakes."))).when(k == 1, F.concat(F.lit("Why so?\n And when? \n"), F.col("text"), F.lit("\nWhere?"))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", a.assistant_noise(said).alias("noise"))


QUERIES, ORACLE_SQL = Q, SQL
