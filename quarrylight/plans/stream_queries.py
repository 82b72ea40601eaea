"""Queries over sources, the tagged format, and the streaming queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import tagged
from quarrylight.operators import evaluation as e
from quarrylight.plans import sqltext as s
from quarrylight.plans.ranking_queries import read
from quarrylight.plans.store_queries import parsed
from quarrylight.session import scratch_folder
from quarrylight.sources import files
from quarrylight.streaming import queue

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark) -> str:
    """A new folder that driver and executors share, until ``release_scratch``."""
    return scratch_folder(spark, "queue")


@query("SELECT conv_id || ':' || turn AS id, 0 AS index, 'done' AS status, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text, conv_id || ':' || turn AS source_id FROM conversations WHERE length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) > 0 UNION ALL SELECT conv_id || ':' || turn, 0, 'failed', NULL, conv_id || ':' || turn FROM conversations WHERE length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) = 0")
def queue_drain(spark, d):
    """Turns enqueued as requests and drained by a stream."""
    root = scratch(spark)
    c = read(spark, d, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    queue.enqueue(c.select(key.alias("id"), F.lit("u").alias("user_id"), F.col("text").alias("llm_response"), F.lit(None).cast("string").alias("user_message"), key.alias("source_id"), F.current_timestamp().alias("created_at")), f"{root}/in")
    queue.drain(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    return queue.drained(spark, f"{root}/out").select("id", "index", "status", "text", "source_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """Extension: hourly counts."""
    return queue.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """Extension: sessions by a gap of half an hour."""
    return queue.sessions(read(spark, d, "events"))


@query()
def tagged_round_trip(spark, d):
    """decisions encoded as tagged lines and parsed or repaired."""
    rows = parsed(spark, d).withColumn("memory", F.when(F.col("action") == "ignore", F.lit(None)).otherwise(F.col("memory")))
    lines = tagged.encoded(F.col("action"), F.col("memory"), F.col("facts"), F.col("reasoning"))
    out = tagged.repair_decisions(rows.withColumn("lines", lines), F.concat_ws(":", "conv_id", "turn"), "lines")
    return out.select("key", "status", "action", F.array_join("repairs", ",").alias("repairs"))


@query("""SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN turn % 2 = 0 THEN ['other'] ELSE ['runaway_no_end', 'fact_pipe_slip', 'q_numeric_slip', 'missing_reasoning_line', 'repeated_line_loop'] END) AS label FROM conversations) GROUP BY label""")
def parse_failures(spark, d):
    """Failure classes of made outputs."""
    good, bad = F.lit("A:ignore\nQ:0.5,.7\nR:why\nEND"), F.lit("F:a|b\nQ:x,1\n" + "same\n" * 5)
    rows = read(spark, d, "conversations").select(F.explode(e.parse_failure_classes(F.when(F.col("turn") % 2 == 0, good).otherwise(bad))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def lines_of(spark, d, name: str, value) -> str:
    """A folder of text files, a log in parts, with one ``value`` a row of ``name``, in
    order: a sort by ranges gives each part its place."""
    path = f"{scratch(spark)}/{name}"
    rows = read(spark, d, name)
    key = ["conv_id", "turn"] if name == "conversations" else ["doc_id"]
    rows.select(*key, value.alias("value")).repartitionByRange(4, *key).sortWithinPartitions(*key).select("value").write.text(path)
    return path


@query("""SELECT row_number() OVER (ORDER BY doc_id) AS line_no, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, doc_id % 7 = 0 AS bad FROM documents""")
def jsonl_source(spark, d):
    """JSON lines with their place; every seventh is broken, and blank
    lines hold none."""
    row = F.to_json(F.struct("doc_id", "lang"))
    path = lines_of(spark, d, "documents", F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(row))
    out = files.read_jsonl(spark, path, spark.createDataFrame([], "doc_id long, lang string").schema, across=True)
    return out.select("line_no", "doc_id", "lang", F.col("_corrupt_record").isNotNull().alias("bad"))


@query("""SELECT doc_id, source || ', "so"' || chr(10) || lang AS note FROM documents""")
def csv_source(spark, d):
    """Quoted fields with commas, quotes and line ends."""
    path = f"{scratch(spark)}/csv"
    note = F.concat("source", F.lit(', "so"\n'), "lang")
    read(spark, d, "documents").select("doc_id", note.alias("note")).write.csv(path, header=True, quote='"', escape='"')
    return files.read_csv(spark, path, spark.createDataFrame([], "doc_id long, note string").schema)


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, turn, conv_id FROM conversations), k AS (SELECT * FROM l WHERE turn % 4 <> 1 AND turn % 2 = 0 ORDER BY line_no DESC LIMIT 50)
SELECT line_no, '2026-01-02T00:00:' || turn AS ts, 'hook' || conv_id AS hook FROM k""")
def hook_events(spark, d):
    """The last fifty events of a day (the reader's limit); bad lines are none."""
    day = F.when(F.col("turn") % 2 == 0, "2026-01-02T00:00:").otherwise("2026-01-03T00:00:")
    row = F.to_json(F.struct(F.concat(day, "turn").alias("ts"), F.concat(F.lit("hook"), "conv_id").alias("hook")))
    path = lines_of(spark, d, "conversations", F.when(F.col("turn") % 4 == 1, F.lit("broken")).otherwise(row))
    return files.read_hook_events(spark, path, "2026-01-02", 50, across=True).select("line_no", "ts", "hook")


TURN_SQL = r"SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '') AS text, role FROM conversations"


@query(f"SELECT line_no, text FROM ({TURN_SQL}) WHERE role = 'assistant' AND length(text) BETWEEN 80 AND 2000")
def rollout_turns(spark, d):
    """Assistant messages of session logs, from blocks."""
    block = F.struct(F.lit("output_text").alias("type"), "text")
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(block, F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content"))
    path = lines_of(spark, d, "conversations", F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))))
    return files.session_turns(files.read_lines(spark, path, across=True), "rollout").select("line_no", "text")


@query(f"SELECT line_no, text FROM ({TURN_SQL}) WHERE role = 'assistant' AND length(text) BETWEEN 80 AND 2000")
def session_turns(spark, d):
    """Assistant messages of session logs, as plain texts."""
    row = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return files.session_turns(files.read_lines(spark, lines_of(spark, d, "conversations", row), across=True), "session").select("line_no", "text")


@query(f"""WITH t AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS place, turn, {s.strip('text')} AS x FROM conversations)
SELECT place, CASE WHEN turn % 3 = 0 THEN x ELSE x || chr(10) || chr(10) || 'part ' || turn END AS text FROM t WHERE turn % 5 <> 4 AND x <> ''""")
def message_logs(spark, d):
    """Messages whose content is a text or parts, among them attached files."""
    parts = F.to_json(F.struct(F.array(F.struct("text"), F.struct(F.lit(files.ATTACHED + " x").alias("text")), F.struct(F.concat(F.lit(" part "), "turn").alias("text"))).alias("content")))
    row = F.when(F.col("turn") % 5 == 4, F.lit('{"content": 7}')).when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(parts)
    return files.message_lines(files.read_lines(spark, lines_of(spark, d, "conversations", row), across=True)).select("place", "text")


@query(r"""WITH l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS n, text, role FROM conversations) SELECT text FROM l WHERE role = 'assistant' AND NOT starts_with(text, '{') AND NOT starts_with(text, '[') AND regexp_matches(text, '\S') AND n > (SELECT max(n) FROM l) - 200 ORDER BY n DESC LIMIT 1""")
def last_assistant_message(spark, d):
    """The last assistant text within two hundred lines of a transcript."""
    path = lines_of(spark, d, "conversations", F.to_json(F.struct("role", "text")))
    return files.last_assistant_messages(files.read_lines(spark, path, across=True, tail=files.TAIL)).select("text")


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id::VARCHAR AS sample_id, turn + 1 AS session_no, 0 AS pos, CASE WHEN turn % 2 = 0 THEN 'day ' || turn ELSE 'event ' || turn END AS session_time, 'D' || turn AS dia_id, role AS speaker, text FROM t""")
def conversation_samples(spark, d):
    """Sessions in numeric order with their times, or those of events."""
    c = read(spark, d, "conversations")
    name = F.concat(F.lit("session_"), (F.col("turn") + 1).cast("string"))
    said = F.to_json(F.array(F.struct(F.concat(F.lit("D"), "turn").alias("dia_id"), F.col("role").alias("speaker"), "text")))
    parts = c.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(
        F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct(name, said))), F.map_from_entries(F.collect_list(F.struct(F.concat(name, F.lit("_date_time")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("day "), "turn")).otherwise(" ")))))).alias("conversation"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("events_"), name), F.struct(F.concat(F.lit("event "), "turn").alias("date")))))).alias("event_summary"),
    )
    return files.flatten_samples(parts)


@query("SELECT 'documents' AS name, doc_id AS id, lang AS value FROM documents UNION ALL SELECT 'labels', doc_id, quality::VARCHAR FROM labels")
def archive_round_trip(spark, d):
    """Tables exported with their counts and imported again."""
    path = f"{scratch(spark)}/archive"
    tables = {"documents": read(spark, d, "documents").select("doc_id", "lang"), "labels": read(spark, d, "labels").select("doc_id", "quality")}
    files.export_archive(tables, path)
    back = files.import_archive(spark, path, {k: v.schema for k, v in tables.items()})
    one, two = back["documents"].select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"), F.col("lang").alias("value")), back["labels"].select(F.lit("labels").alias("name"), F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("value"))
    return one.unionByName(two)


QUERIES, ORACLE_SQL = Q, SQL
