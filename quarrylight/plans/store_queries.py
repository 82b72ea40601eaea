"""Text, temporal, decision and store queries over the driver tables. No table
holds model output, so decisions are made from conversations by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import temporal as tm
from quarrylight.functions import text as t
from quarrylight.operators import decisions as dc
from quarrylight.operators import segment as sg
from quarrylight.operators import store as st
from quarrylight.operators.audit import likely_noise, recall_metrics
from quarrylight.operators.evaluation import failure_bucket
from quarrylight.plans import sqltext as s
from quarrylight.plans.ranking_queries import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def slug(x: str, joiner: str = "-", keep: str = "a-z0-9") -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^{keep}]+', '{joiner}', 'g'), '^{joiner}+', ''), '{joiner}+$', '')"


HEAD = "text"
FIRST = rf"CASE WHEN regexp_matches({HEAD}, '^(.+?[.!?])(?:\s|$)') THEN regexp_extract({HEAD}, '^(.+?[.!?])(?:\s|$)', 1) ELSE {HEAD} END"


@query(f"""SELECT doc_id, array_to_string({s.tokens(HEAD)}, ' ') AS tokens, array_to_string({s.numbers(HEAD)}, ' ') AS numbers, array_to_string({s.entities(HEAD)}, ' ') AS entities,
array_to_string({s.meaningful(s.squeeze(HEAD))}, ' ') AS meaningful, array_to_string(list_slice(regexp_extract_all(lower({HEAD}), '[a-z0-9]{{3,}}'), 1, 12), ' ') AS keywords,
{slug(HEAD)} AS recall_key, nullif({slug(s.strip(HEAD), '_')}, '') AS predicate, {s.squeeze(HEAD)} AS squeezed, ceil(length({s.strip('text')}) / 4.0)::INT AS n_tokens,
{FIRST} AS statement, {s.temporal_signal('text')} AS temporal FROM documents""")
def text_functions(spark, d):
    """F1-F13, F15, F19, R5 over documents."""
    h = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", F.array_join(t.tokens(h), " ").alias("tokens"), F.array_join(t.numbers(h), " ").alias("numbers"), F.array_join(t.entity_tokens(h), " ").alias("entities"), F.array_join(t.meaningful_tokens(h), " ").alias("meaningful"),
        F.array_join(t.keywords(h), " ").alias("keywords"), t.recall_key(h).alias("recall_key"), t.predicate(h).alias("predicate"), t.squeeze(h).alias("squeezed"), t.estimated_tokens("text").alias("n_tokens"), t.first_statement(h).alias("statement"), t.temporal_signal("text").alias("temporal"),
    )


@query(f"""SELECT doc_id, {s.squeeze(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'hf_[A-Za-z0-9_=-]{16,}', '[REDACTED_HF_TOKEN]', 'g'), 'sk-[A-Za-z0-9_-]{8,}', '[REDACTED_API_KEY]', 'gi'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), '[A-Za-z]:\\[^ \n\r\t''\"`]+', '[LOCAL_PATH]', 'g'), '/content/[^ \n\r\t''\"`]+', '[COLAB_PATH]', 'gi')")} AS clean FROM documents""")
def redact(spark, d):
    """F21 over documents."""
    return read(spark, d, "documents").select("doc_id", t.redacted("text").alias("clean"))


@query("""SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(source || doc_id, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, ch: ((xor(h, ch)) * 16777619) & 4294967295) AS fnv, sha256(source || doc_id) AS sha FROM documents""")
def content_hashes(spark, d):
    """FNV-1a and sha256."""
    x = F.concat("source", F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", t.fnv1a(x).alias("fnv"), F.sha2(x, 256).alias("sha"))


WORDS = ["today", "yesterday", "tomorrow", "last week", "next week", "last month", "next month", "last year", "next year", "this week", "this month", "this year", "someday"]
DAY = "strftime({0}, '%-d %B %Y')"


@query(f"""WITH w AS (SELECT unnest({s.literals(WORDS)}) AS word), e AS (SELECT event_id, ts::DATE AS a FROM events)
SELECT event_id, word, CASE word WHEN 'today' THEN {DAY.format('a')} WHEN 'yesterday' THEN {DAY.format("a - INTERVAL 1 DAY")} WHEN 'tomorrow' THEN {DAY.format("a + INTERVAL 1 DAY")}
WHEN 'last week' THEN 'week before ' || {DAY.format('a')} WHEN 'next week' THEN 'week after ' || {DAY.format('a')} WHEN 'last month' THEN strftime(date_trunc('month', a) - INTERVAL 1 MONTH, '%B %Y') WHEN 'next month' THEN strftime(date_trunc('month', a) + INTERVAL 1 MONTH, '%B %Y')
WHEN 'last year' THEN (year(a) - 1)::VARCHAR WHEN 'next year' THEN (year(a) + 1)::VARCHAR WHEN 'this week' THEN 'week of ' || {DAY.format('a')} WHEN 'this month' THEN strftime(a, '%B %Y') WHEN 'this year' THEN year(a)::VARCHAR END AS resolved FROM e, w""")
def temporal_resolution(spark, d):
    """F32-F34 with event times as anchors."""
    e = read(spark, d, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = e.select("event_id", tm.source_date("stamp").alias("anchor"), F.explode(F.array(*map(F.lit, WORDS))).alias("word"))
    return rows.select("event_id", "word", tm.resolve_relative("word", F.col("anchor"), extended=True).alias("resolved"))


def raw_decisions(spark, d) -> DataFrame:
    """Model outputs made from turns: nine actions, some broken, some fenced."""
    c = read(spark, d, "conversations")
    names = F.array(*map(F.lit, ["store_episodic", "promote_semantic", "ignore_noise", "UPDATE_existing ", "flag_conflict", "flag_and_store", "recall_weighting", "decay", "mystery"]))
    n = F.col("turn") + F.col("conv_id")
    memory = F.struct(F.col("text").alias("content"), F.lit("episodic").alias("type"), (F.col("turn") / 10).alias("confidence"))
    fact = F.struct(F.when(n % 4 == 0, F.lit("person")).otherwise(F.col("role")).alias("subject"), F.lit("Said In Turn").alias("predicate"), F.col("text").alias("value_text"), F.when(n % 5 == 0, F.lit("Source ID: x")).otherwise(F.lit("turn text")).alias("evidence_text"))
    body = F.to_json(F.struct(F.get(names, (n % 9).cast("int")).alias("action"), memory.alias("memory"), F.array(fact).alias("facts"), F.lit("r").alias("reasoning"), (F.col("turn") / 10).alias("confidence")))
    raw = F.when(n % 7 == 0, F.lit("not json")).when(n % 7 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.select("conv_id", "turn", "role", F.col("text").alias("source_text"), raw.alias("raw"))


MADE = """made AS (SELECT conv_id, turn, role, text, turn + conv_id AS n, ['store_episodic', 'promote_semantic', 'ignore', 'update_existing', 'flag_conflict', 'flag_and_store', 'rank', 'decay', 'store_episodic'][((turn + conv_id) % 9) + 1] AS act FROM conversations),
parsed AS (SELECT conv_id, turn, n, text, CASE WHEN n % 7 = 0 THEN 'store_episodic' ELSE act END AS action, text AS content, n % 7 = 0 AS parse_error,
CASE WHEN n % 7 = 0 OR n % 4 = 0 OR n % 5 = 0 THEN 0 ELSE 1 END AS n_facts, CASE WHEN n % 7 = 0 THEN 0.5::DOUBLE ELSE turn / 10.0::DOUBLE END AS confidence,
CASE WHEN n % 7 = 0 OR n % 4 = 0 OR n % 5 = 0 THEN '' ELSE role || ' said_in_turn ' || text || ' turn text' END AS fact_text FROM made)"""


def parsed(spark, d) -> DataFrame:
    return dc.parse_decision(raw_decisions(spark, d), "raw", "source_text")


@query(f"WITH {MADE} SELECT conv_id, turn, action, content, parse_error, n_facts, confidence FROM parsed")
def decision_parsing(spark, d):
    """F45-F48, C1 over made model outputs."""
    return parsed(spark, d).select("conv_id", "turn", "action", F.col("memory.content").alias("content"), "parse_error", F.size("facts").alias("n_facts"), "confidence")


ROUTE_SQL = "CASE action WHEN 'ignore' THEN 'ignore' WHEN 'rank' THEN 'recall_only' WHEN 'promote_semantic' THEN 'semantic_upsert' WHEN 'update_existing' THEN 'update_with_supersede' WHEN 'decay' THEN 'decay_existing_then_insert' WHEN 'flag_conflict' THEN 'conflict_log_and_hold' WHEN 'flag_and_store' THEN 'conflict_log_and_hold' ELSE 'episodic_insert' END"


@query(f"""WITH {MADE}, dup AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower({s.strip('content')}), '\\s+', ' ', 'g') ORDER BY conv_id, turn) > 1 AS duplicate FROM parsed),
r AS (SELECT *, {ROUTE_SQL} AS route FROM dup),
t AS (SELECT conv_id, turn, route, unnest(list_concat(['decisions'], CASE WHEN duplicate THEN [] WHEN action = 'flag_and_store' THEN ['conflicts', 'episodic'] ELSE CASE route WHEN 'ignore' THEN [] WHEN 'recall_only' THEN [] WHEN 'semantic_upsert' THEN ['semantic'] WHEN 'update_with_supersede' THEN ['semantic'] WHEN 'decay_existing_then_insert' THEN ['decay_schedule', 'episodic'] WHEN 'conflict_log_and_hold' THEN ['conflicts'] ELSE ['episodic'] END END)) AS target FROM r)
SELECT conv_id, turn, route, target FROM t""")
def decision_routing(spark, d):
    """The tables that each decision writes to."""
    from pyspark.sql import Window

    rows = parsed(spark, d).withColumn("content", F.col("memory.content"))
    w = Window.partitionBy(F.md5(t.content_key("content"))).orderBy("conv_id", "turn")
    rows = rows.withColumn("duplicate", F.row_number().over(w) > 1)
    return dc.routed(rows, "action", "content", "duplicate").select("conv_id", "turn", "route", "target")


def sig(x: str) -> str:
    return f"list_filter({s.tokens(x)}, lambda v: length(v) >= 3 AND NOT regexp_matches(v, '^[0-9]+$'))"


@query(f"""WITH {MADE}, g AS (SELECT *, {s.strip('content')} || CASE WHEN fact_text = '' THEN '' ELSE ' ' || fact_text END AS stored, {ROUTE_SQL} AS route FROM parsed),
k AS (SELECT *, {sig('text')} AS a, {sig('stored')} AS b FROM g), o AS (SELECT *, CASE WHEN len(a) = 0 THEN 0 ELSE {s.hits('a', 'b')} END AS overlap, CASE WHEN len(a) = 0 THEN 0 ELSE least(2, greatest(1, ceil(len(a) * 0.1::DOUBLE)::INT)) END AS required FROM k)
SELECT conv_id, turn, overlap::INT AS overlap, required::INT AS required, CASE WHEN parse_error OR route IN ('ignore', 'recall_only') OR {s.strip('stored')} = '' THEN NULL
WHEN regexp_matches(stored, '(?i)checkpoint|powershell|gate datasets|nvidia-smi|direct probe|token budget|runpod|fact parser|malformed parser|constoursated|gate6|expanded probe|gate-?\\d') THEN 'grounding_reject_bleed' WHEN overlap < required THEN 'grounding_reject' END AS guard_route FROM o""")
def storage_guards(spark, d):
    """Bleed and grounding guards."""
    rows = parsed(spark, d).withColumn("stored", dc.stored_text(F.col("memory.content"), F.col("facts")))
    out = dc.guarded(rows, "source_text", "stored", "action", "parse_error")
    return out.select("conv_id", "turn", F.col("grounding.overlap").alias("overlap"), F.col("grounding.required").alias("required"), "guard_route")


@query()
def recall_plans(spark, d):
    """Plans made from questions."""
    b = read(spark, d, "benchmark")
    body = F.to_json(F.struct(F.lit("recall").alias("intent"), F.array(F.lit("episodic"), F.lit("Semantic"), F.lit("archival")).alias("target_tables"), (F.col("item_id") % 9).cast("string").alias("top_k")))
    raw = F.when(F.col("item_id") % 3 == 0, F.lit("{bad")).otherwise(body)
    out = dc.parse_plan(b.withColumn("raw", raw), "raw", "text", 5)
    return out.select("item_id", "intent", F.array_join("target_tables", ",").alias("tables"), F.size("ranking_hints").alias("n_hints"), "top_k", "plan_fallback")


SQL["recall_plans"] = "SELECT item_id, 'recall' AS intent, CASE WHEN item_id % 3 = 0 THEN 'semantic,episodic' ELSE 'episodic,archival' END AS tables, CASE WHEN item_id % 3 = 0 THEN len(list_slice(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), 1, 12)) ELSE 0 END::INT AS n_hints, CASE WHEN item_id % 3 = 0 OR item_id % 9 = 0 THEN 5 ELSE least(5, item_id % 9) END::INT AS top_k, item_id % 3 = 0 AS plan_fallback FROM benchmark"

MEAN = s.meaningful(s.squeeze("text"))


@query(f"""WITH k AS (SELECT doc_id, lang, text, list_concat({s.meaningful('lang')}, {MEAN}) AS w FROM documents), u AS (SELECT *, {s.distinct('w')} AS d FROM k)
SELECT doc_id, CASE WHEN len(d) = 0 THEN 'memory-anchor' ELSE array_to_string(list_slice(d, 1, 4), '-') END AS mnemonic,
round(least(0.68::DOUBLE + CASE WHEN regexp_matches(lower(text), '\\b\\d{{4}}\\b|yesterday|last week|workflow|review|procedure') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'decision|prefer|constraint|indexable|mnemonic|recall') THEN 0.12::DOUBLE ELSE 0 END + 0.04::DOUBLE, 0.98::DOUBLE), 2) AS salience FROM u""")
def mnemonic_keys(spark, d):
    """F42, F6, salience."""
    tags = F.array("lang")
    return read(spark, d, "documents").select("doc_id", t.mnemonic_key("text", tags).alias("mnemonic"), t.salience("text", tags).alias("salience"))


@query("""SELECT conv_id, turn, key, n_steps, kind FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'review-pr' ELSE 'grounding-bar' END AS key, 2 AS n_steps, 'workflow' AS kind FROM conversations)""")
def workflow_indexables(spark, d):
    """Workflows from headers and numbered lines."""
    head = F.when(F.col("turn") % 2 == 0, F.lit("# Review the pull request")).otherwise(F.lit("# The grounding bar"))
    text = F.concat(head, F.lit("\n1. Open `diff` first\n2. Check the tests\n3. open diff first\n"), F.col("role"))
    empty = F.lit("")
    x = read(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    rows = x.withColumn("i", F.explode(dc.indexables_for(F.col("text"), empty, F.array().cast("array<string>"), empty, empty, empty)))
    return rows.select("conv_id", "turn", F.col("i.key").alias("key"), F.size("i.steps").alias("n_steps"), F.col("i.kind").alias("kind"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'view'))
SELECT event_id, event_type AS "table" FROM e WHERE rn <= 3""")
def newest_memories(spark, d):
    """The three newest of each table and user."""
    e = read(spark, d, "events").select(F.col("user_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), "event_type")
    return st.select_memories({k: e.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "view")}, 3).select("event_id", "table")


@query("""WITH k AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events)
SELECT user_id, event_type, value, first_id AS id FROM k WHERE rn = 1""")
def upsert_keeps_first_id(spark, d):
    """U4: last value of each key, id of the first."""
    e = read(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("id"), F.col("event_id").alias("seq"))
    return st.upsert_last(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), ["user_id", "event_type"], ["id"]).select("user_id", "event_type", "value", "id")


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN 'new' END AS name, c_custkey % 5 AS note FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL AND b.id % 4 <> 0 THEN b.name ELSE a.name END AS name, a.bal, b.note FROM a FULL JOIN b ON a.id = b.id""")
def upsert_partial_rows(spark, d):
    """Defined columns replace, a defined null too; new ids and columns are added."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    given = F.when(F.col("id") % 4 == 0, F.array(F.lit("note"))).otherwise(F.array(F.lit("name"), F.lit("note")))
    new = c.filter("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, F.lit("new")).alias("name"), (F.col("id") % 5).alias("note"), given.alias("given"))
    return st.upsert_partial(c.filter("id % 2 = 0"), new, defined="given")


@query("WITH m AS (SELECT user_id, max(ts) AS last_accessed FROM events GROUP BY user_id) SELECT c_custkey, last_accessed FROM customer LEFT JOIN m ON c_custkey = user_id")
def last_access(spark, d):
    """Access log, latest on read."""
    c = read(spark, d, "customer").select("c_custkey", F.lit("m").alias("table"), F.col("c_custkey").alias("id"))
    log = read(spark, d, "events").select(F.lit("m").alias("table"), F.col("user_id").alias("id"), "ts")
    return st.last_accessed(c, log).select("c_custkey", "last_accessed")


@query()
def segmented_documents(spark, d):
    """Segmentation of documents of over 300 tokens, merged from 60."""
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("# Title\n"), F.col("text")).alias("text"))
    out = sg.segmented(docs, "doc_id", "text", 300, 60).withColumn("base", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return sg.chunked_sources(out, "base").select("doc_id", "index", "n_segments", "tokens", "reason", "source_id", F.array_join("tags", ",").alias("tags"))


@query(r"""WITH e AS (SELECT event_id, user_id, event_type, ts, value FROM events), ar AS (SELECT event_id, 'archival' AS scan, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'view'),
si AS (SELECT event_id, 'salience' AS scan, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS r FROM e), em AS (SELECT event_id, 'embedding' AS scan, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e),
st AS (SELECT event_id, 'status' AS scan, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM e), pe AS (SELECT event_id, 'pending' AS scan, row_number() OVER (ORDER BY ts, event_id) AS r FROM e WHERE event_type = 'click'),
wh AS (SELECT event_id, 'whole' AS scan, row_number() OVER (ORDER BY event_id DESC) AS r FROM e), ke AS (SELECT event_id, 'key' AS scan, 1 AS r FROM e WHERE event_type = 'view' AND user_id = (SELECT min(user_id) FROM e)), lo AS (SELECT event_id, 'lookup' AS scan, 1 AS r FROM e WHERE event_id % 1000 = 3)
SELECT event_id, scan FROM (SELECT * FROM ar UNION ALL SELECT * FROM si UNION ALL SELECT * FROM em UNION ALL SELECT * FROM st UNION ALL SELECT * FROM pe UNION ALL SELECT * FROM wh UNION ALL SELECT * FROM ke UNION ALL SELECT * FROM lo) WHERE r <= CASE scan WHEN 'pending' THEN 20 WHEN 'whole' THEN 100 ELSE 2 END OR scan IN ('key', 'lookup')""")
def store_scans(spark, d):
    """Scans by user, model, status and key, with each scan's own limit."""
    e = read(spark, d, "events").select("event_id", F.col("user_id"), "event_type", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.col("value").alias("salience"))
    archive = e.filter("event_type = 'view'").select("event_id", "user_id", "seq", F.col("created_at").alias("archived_at"))
    first = e.agg(F.min("user_id")).first()[0]
    wanted = e.filter("event_id % 1000 = 3").select(F.col("event_type").alias("table"), F.col("event_id").alias("id"))
    found = {
        "archival": st.select_memories({"archival": archive}, 2), "salience": st.select_indexables(e, 2), "embedding": st.newest(e, ["user_id", "event_type"], 2), "status": st.newest(e, ["event_type"], 2),
        "pending": st.pending(e.withColumn("status", F.when(F.col("event_type") == "click", "pending").otherwise("done"))), "whole": st.ingested(e), "key": st.by_key(e.withColumn("key", F.initcap("event_type")), first, " vIEW "),
        "lookup": st.lookup(wanted, e.select(F.col("event_type").alias("table"), F.col("event_id").alias("id"), "event_id")),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select("event_id", F.lit(name).alias("scan"))
        out = rows if out is None else out.unionByName(rows)
    return out


SHORT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE " + s.strip("left({0}, {1} - 3)") + " || '...' END"
MARKED = "'[note] ' || lang || ' : ' || text"


@query(rf"""WITH b AS (SELECT doc_id, source, lang, text, {MARKED} AS m, '  ' || source || '--' || lang || ' ' AS k FROM documents), f AS (SELECT *, CASE WHEN regexp_matches(text, '^(.+?[.!?])(?:\s|$)') THEN regexp_extract(text, '^(.+?[.!?])(?:\s|$)', 1) ELSE text END AS first_ FROM b)
SELECT doc_id, {slug(s.strip('k'), '-', 'a-z0-9-')} AS clean_key, {SHORT.format('first_', 160)} AS hint, {s.strip(r"regexp_replace(m, '^\[[^\]]+\]\s*', '')")} AS bare, ' (source=' || source || CASE WHEN doc_id % 2 = 0 THEN '; date=May' ELSE '; source_time=2024' END || ')' AS suffix,
{SHORT.format('text', 420)} AS memory, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) AS n_pieces, CASE WHEN doc_id % 2 = 0 THEN 'a:b' END AS tag, (contains(lower(text), 'the')::INT + contains(lower(text), 'zz')::INT) AS n_terms,
array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)the') THEN 'article' END, CASE WHEN regexp_matches(text, '(?i)de\b') THEN 'of' END], lambda x: x IS NOT NULL), ',') AS topics, 'x_y,' || source AS tags, source || ':chunk-' || doc_id AS chunk, source AS base FROM f""")
def text_shapes(spark, d):
    """F12, F16-F18, F20, F22, F23, F27, F29, F30, F44 over whole texts."""
    k = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "text", F.concat(F.lit("[note] "), "lang", F.lit(" : "), "text").alias("m"), F.concat(F.lit("  "), "source", F.lit("--"), "lang", F.lit(" ")).alias("k"), F.array(F.lit(" x y"), F.col("source"), F.lit(""), F.lit("x y "), F.col("source")).alias("tags"))
    chunk = t.chunk_source(F.col("source"), k)
    return docs.select(
        "doc_id", t.clean_key("k").alias("clean_key"), t.hint("text").alias("hint"), t.without_metadata("m").alias("bare"), t.source_suffix(F.col("source"), F.when(k % 2 == 0, F.lit("May")), F.lit("2024")).alias("suffix"), t.shortened("text", 420).alias("memory"),
        F.size(t.pieces("text")).cast("long").alias("n_pieces"), t.tag_value(F.when(k % 2 == 0, F.array(F.lit("z:1"), F.lit("k:a:b"), F.lit("k:c"))).otherwise(F.array(F.lit("z:1"))), "k").alias("tag"), t.count_terms("text", ["the", "zz"]).alias("n_terms"),
        F.array_join(t.topic_tags("text", [("the", "article"), (r"de(?![A-Za-z0-9_])", "of")]), ",").alias("topics"), F.array_join(t.unique_tags("tags"), ",").alias("tags"), chunk.alias("chunk"), t.base_source(chunk).alias("base"),
    )


@query("""WITH e AS (SELECT event_id, ts::DATE AS a, event_id % 6 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN 'yesterday' WHEN 1 THEN 'last year' WHEN 2 THEN NULL WHEN 3 THEN '2021' WHEN 4 THEN NULL ELSE 'yesterday' END AS temporal_expression,
CASE k WHEN 0 THEN strftime(a - INTERVAL 1 DAY, '%-d %B %Y') WHEN 1 THEN (year(a) - 1)::VARCHAR WHEN 2 THEN NULL WHEN 3 THEN 'old' WHEN 4 THEN 'old' ELSE 'old' END AS resolved_time, CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.95 WHEN 2 THEN NULL ELSE 0.95 END AS resolved_time_confidence FROM e""")
def temporal_fields(spark, d):
    """Words in a text or given, unsupported, absent, without a date."""
    k = F.col("event_id") % 6
    e = read(spark, d, "events").withColumn("stamp", F.when(k != 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    given = F.when(k == 1, F.lit("last year")).when(k == 2, F.lit("someday")).when(k == 3, F.lit("2021")).when(k == 5, F.lit("yesterday"))
    text = F.when(k == 0, F.lit("We met Yesterday and today")).otherwise(F.lit("nothing here"))
    out = tm.normalized(given, text, F.when(k > 1, F.lit("old")), F.when(k > 0, F.lit(0.95)), F.col("stamp"))
    return e.select("event_id", out.alias("o")).select("event_id", "o.*")


@query(f"""SELECT conv_id, turn, role AS subject, 'said_this' AS predicate, CASE WHEN turn % 4 = 1 THEN 'spare' ELSE {s.strip('text')} END AS value_text, CASE WHEN turn % 3 = 0 THEN 0.75::DOUBLE ELSE 0.2::DOUBLE + turn / 10.0::DOUBLE END AS confidence FROM conversations WHERE turn % 5 <> 0 AND (turn % 3 = 0 OR 0.2::DOUBLE + turn / 10.0::DOUBLE >= 0.35)""")
def fact_writes(spark, d):
    """Facts that may be written; empty subjects and low confidence may not."""
    k = F.col("turn")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "role", F.lit("\n"))).alias("subject"), F.lit(" Said this! ").alias("predicate"), F.when(k % 4 == 1, F.lit(" ")).otherwise(F.col("text")).alias("value_text"), F.lit("spare").alias("value"), F.when(k % 3 != 0, 0.2 + k / 10).alias("confidence"))
    return st.valid_facts(rows).select("conv_id", "turn", "subject", "predicate", "value_text", "confidence")


@query("""SELECT count(*) AS cases, avg((doc_id % 2 = 0)::INT::DOUBLE) AS target_tables_exact_rate, avg((doc_id % 2 = 0)::INT::DOUBLE) AS target_tables_primary_rate, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS ranking_hints_score, avg((doc_id % 5 = 3)::INT::DOUBLE) AS top_k_exact_rate FROM documents WHERE doc_id % 7 <> 0""")
def recall_plan_metrics(spark, d):
    """Made plans against expected ones, skipped cases left out."""
    k, a = F.col("doc_id"), lambda *x: F.array(*map(F.lit, x))
    rows = read(spark, d, "documents").select(
        (k % 7 == 0).alias("skipped"), a("semantic", "episodic").alias("expected_tables"), F.when(k % 2 == 0, a("semantic", "episodic")).otherwise(a("archival")).alias("predicted_tables"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(a("x", "y")).alias("expected_hints"), a("y", "z").alias("predicted_hints"), F.lit(3).alias("expected_k"), (k % 5).alias("predicted_k"),
    )
    return recall_metrics(rows)


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'image_context_missing' WHEN doc_id % 10 = 2 THEN 'ambiguous_relative_date' WHEN doc_id % 10 = 3 THEN 'speaker_confusion' WHEN doc_id % 10 = 4 THEN 'judge_error' WHEN doc_id % 10 = 5 THEN 'missing_memory'
WHEN doc_id % 10 = 6 THEN 'retrieval_miss' WHEN doc_id % 10 = 7 THEN 'bad_context_selection' WHEN doc_id % 10 = 8 THEN 'bad_context_selection' ELSE 'answer_model_error' END AS bucket, doc_id % 10 = 4 AS noise FROM documents""")
def failure_buckets(spark, d):
    """Each cause in turn."""
    k = F.col("doc_id") % 10
    asked = F.when(k == 1, F.lit("which Photo")).when(k == 2, F.lit("what came next")).when(k == 3, F.lit("where did She go")).otherwise(F.lit("which colour"))
    some = F.when(k == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit("memo")))
    judge, answer = F.when(k == 4, F.lit("Gold differs")).otherwise(F.lit("")), F.when(k == 8, F.lit("I do not know")).otherwise(F.lit("blue"))
    bucket = failure_bucket(k == 0, asked, F.lit("red"), answer, some, k != 5, k != 6, judge)
    return read(spark, d, "documents").select("doc_id", bucket.alias("bucket"), likely_noise(F.when(k == 4, F.lit(" Okay, sure. ")).otherwise(F.lit("A plan for May."))).alias("noise"))


@query(f"""WITH b AS (SELECT doc_id, doc_id % 4 AS k, {sig('text')} AS a, {sig("left(text, 100)")} AS h FROM documents), q AS (SELECT *, list_distinct(a) AS u FROM b)
SELECT doc_id, CASE WHEN k = 0 THEN 'store_episodic' WHEN k = 1 THEN 'store_episodic' WHEN k = 2 THEN 'ignore' WHEN len(list_filter(u, lambda x: list_contains(h, x))) >= ceil(len(u) * 0.5::DOUBLE) THEN 'update_existing' ELSE 'store_episodic' END AS final_action FROM q""")
def consolidation(spark, d):
    """Too far, by cosine too; a verdict that counts; a merge that must keep
    half of the old tokens."""
    k = F.col("doc_id") % 4
    rows = read(spark, d, "documents").select("doc_id", F.lit("store_episodic").alias("action"), F.when(k == 2, "ignore_noise").otherwise("update_existing").alias("verdict"), F.when(k == 0, 0.2).otherwise(0.4).alias("near"), F.when(k == 1, 0.4).when(k == 2, 0.6).alias("cosine"), F.col("text").alias("old"), F.substring("text", 1, 100).alias("merged"))
    return dc.consolidated(rows, "action", "verdict", "near", "cosine", "old", "merged").select("doc_id", "final_action")


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 2 = 1 THEN '$.action' END, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN '$.memory.content' END, CASE WHEN turn % 5 = 0 THEN '$.memory.type' END, CASE WHEN turn % 4 = 3 THEN '$.memory.confidence' END,
CASE WHEN turn % 7 = 0 THEN '$.facts.predicate' END, CASE WHEN turn % 6 = 5 THEN '$.reasoning' END], lambda x: x IS NOT NULL), ',') AS paths FROM conversations""")
def strict_decisions(spark, d):
    """what a strict decision breaks."""
    k, null = F.col("turn"), F.lit(None)
    memory = F.struct(F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("kept")).alias("content"), F.when(k % 5 == 0, F.lit("working")).otherwise(F.lit("semantic")).alias("type"), F.lit(0.5).alias("strength"), null.cast("double").alias("decay_rate"), F.lit(0.0).alias("emotional_weight"), F.when(k % 4 == 3, 1.5).otherwise(1.0).alias("confidence"))
    facts = F.from_json(F.to_json(F.array(F.struct(F.when(k % 7 == 0, F.lit("Says So")).otherwise(F.lit("says_so")).alias("predicate")))), f"array<{dc.FACT}>")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(k % 2 == 1, F.lit("promote")).otherwise(F.lit("update_existing")).alias("action"), memory.alias("memory"), facts.alias("facts"), F.when(k % 6 == 5, F.lit("")).otherwise(F.lit("r")).alias("reasoning"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(dc.strict_issues(rows), lambda i: i.path), ",").alias("paths"))


@query(f"""WITH k AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ignore_op' WHEN 1 THEN 'merge_Conflict' WHEN 2 THEN 'auto_promote' WHEN 3 THEN 'Update_row' WHEN 4 THEN 'rerank' WHEN 5 THEN 'slow_decay' WHEN 6 THEN 'other' ELSE 'recall_promote' END AS op FROM documents)
SELECT doc_id, CASE WHEN contains(lower(op), 'ignore') THEN 'ignore' WHEN contains(lower(op), 'conflict') THEN 'detect_interference' WHEN contains(lower(op), 'promote') THEN 'promote' WHEN contains(lower(op), 'update') THEN 'update_existing' WHEN contains(lower(op), 'rank') OR contains(lower(op), 'recall') THEN 'rank' WHEN contains(lower(op), 'decay') THEN 'decay' ELSE 'store_episodic' END AS action,
doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (doc_id % 5 = 0 OR doc_id % 5 < 3) AS logged, doc_id % 9 <> 0 AS todo FROM k""")
def operations(spark, d):
    """Actions of operation names, ignores worth a log, what is left to do."""
    k = F.col("doc_id")
    names = ["ignore_op", "merge_Conflict", "auto_promote", "Update_row", "rerank", "slow_decay", "other", "recall_promote"]
    docs = read(spark, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, names)), (k % 8).cast("int")).alias("op"), F.when(k % 2 == 0, "ignore").otherwise("store").alias("final_action"), (k % 3 == 0).alias("wrote"), F.when(k % 5 != 0, (k % 5) / 6).alias("confidence"))
    logged = st.low_confidence_ignores(docs).select("doc_id", F.lit(True).alias("logged"))
    todo = st.resume(docs, docs.filter("doc_id % 9 = 0"), ["doc_id"]).select("doc_id", F.lit(True).alias("todo"))
    out = docs.select("doc_id", dc.action_of_operation("op").alias("action")).join(logged, "doc_id", "left").join(todo, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("logged", "todo")})


QUERIES, ORACLE_SQL = Q, SQL
