"""Readers and writers: JSONL, CSV, transcripts, session logs, archives.

Lines are read by byte splits. A line's number is its place in its split plus the
lines of the splits before it, of which a first pass counts each: a file of any size
is read by many tasks, and only counts, a row for each split, are summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrylight.operators import schema as sc

BLOCKS = "array<struct<type:string,text:string>>"
#: Characters of a usable turn.
LEAST, MOST = 80, 2000
#: Fixed value: lines of a transcript that are looked at, from its end.
TAIL = 200


def read_lines(spark: SparkSession, path: str, across: bool = False, tail: int | None = None) -> DataFrame:
    """(path, line_no from 1, line) of text files, blank lines left out. With
    ``across`` the files are one log, numbered on in the order of their names, with
    ``path`` as given. ``tail``: only lines among the last so many, up to the last that
    is not blank; known from the counts, so nothing else is kept or moved."""
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    some = F.trim("line") != ""
    # the rows of a split have consecutive ids; files are dealt to splits alike in both passes
    splits = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max(F.when(some, F.col("at"))).alias("last"))
    log = Window.partitionBy(F.lit(0) if across else F.col("file"))
    before = F.coalesce(F.sum("n").over(log.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = splits.withColumn("shift", before - F.col("first") + 1)
    places = places.select("file", "start", "shift", F.max(F.col("last") + F.col("shift")).over(log).alias("end"))
    rows = raw.filter(some).join(places, ["file", "start"]).withColumn("line_no", F.col("at") + F.col("shift"))
    if tail is not None:
        rows = rows.filter(F.col("line_no") > F.col("end") - tail)
    return rows.select((F.lit(path) if across else F.col("file")).alias("path"), "line_no", "line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False, across: bool = False) -> DataFrame:
    """Rows of JSON lines, with path, line_no and _corrupt_record; strict
    fails with the first bad line's place."""
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = read_lines(spark, path, across).withColumn("_r", F.from_json("line", full, {"mode": "PERMISSIVE"}))
    bad = F.col("_r._corrupt_record").isNotNull()
    if strict:
        rows = rows.withColumn("_r", F.when(bad, F.raise_error(F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": bad JSON")))).otherwise(F.col("_r")))
    return rows.select("path", "line_no", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields], F.col("_r._corrupt_record").alias("_corrupt_record"))


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """U8, U9."""
    columns = sorted(df.columns) if sort_keys else df.columns
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Quoted fields, doubled quotes, line ends inside quotes."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=schema)


def read_hook_events(spark: SparkSession, path: str, date: str, limit: int, across: bool = False) -> DataFrame:
    """The last events of a day, in order; bad lines are empty events."""
    rows = read_lines(spark, path, across).withColumn("ts", F.get_json_object("line", "$.ts"))
    last = rows.filter(F.col("ts").startswith(date)).orderBy(F.col("line_no").desc()).limit(limit)
    return last.select("line_no", "ts", *[F.get_json_object("line", f"$.{c}").alias(c) for c in ("hook", "status", "reason")]).orderBy("line_no")


def last_assistant_messages(lines: DataFrame) -> DataFrame:
    """The last assistant text of each transcript. ``lines``: path, line_no, line,
    as ``read_lines`` gives them with a tail of ``TAIL``."""
    def field(root: str, name: str) -> Column:
        v = F.get_json_object("line", f"${root}.{name}")
        return F.when((F.trim(v) != "") & ~F.ltrim(v).startswith("{") & ~F.ltrim(v).startswith("["), v)

    said = F.coalesce(*[field(r, n) for r in ("", ".payload") for n in ("text", "content", "message")])
    assistant = (F.get_json_object("line", "$.role") == "assistant") | (F.get_json_object("line", "$.payload.role") == "assistant")
    text = F.coalesce(field(".payload", "last_agent_message"), F.when(assistant, said))
    return lines.withColumn("text", text).filter("text IS NOT NULL").groupBy("path").agg(F.max_by("text", "line_no").alias("text"))


def newest_file(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """The newest .jsonl under ``root``, down to ``depth`` folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("path", "modificationTime")
    level = F.size(F.split("path", "/")) - len(root.rstrip("/").split("/")) - 1
    base = root if ":" in root else f"file:{root}"
    level = F.size(F.split("path", "/")) - F.lit(len(base.rstrip("/").split("/"))) - 1
    return files.filter(level <= depth).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def block_text(blocks: Column) -> Column:
    """Texts of content blocks, joined by lines."""
    kept = F.filter(F.from_json(blocks, BLOCKS), lambda b: b.type.isin("text", "output_text", "input_text") & (F.trim(b.text) != ""))
    return F.array_join(F.transform(kept, lambda b: F.trim(b.text)), "\n")


def session_turns(lines: DataFrame, kind: str) -> DataFrame:
    """Assistant turns of session logs of 80 to 2000 characters."""
    j = lambda p: F.get_json_object("line", p)
    if kind == "rollout":
        mine, content = (j("$.type") == "response_item") & (j("$.payload.type") == "message") & (j("$.payload.role") == "assistant"), j("$.payload.content")
    else:
        mine, content = (j("$.type") == "assistant") & (j("$.message.role") == "assistant"), j("$.message.content")
    text = F.when(F.ltrim(content).startswith("["), block_text(content)).otherwise(F.trim(content))
    return lines.filter(mine).select("path", "line_no", text.alias("text")).filter(F.length("text").between(LEAST, MOST))


#: Message types of a model's turns, and how attached files begin.
MODEL_TYPES = ("gemini", "model")
ATTACHED = "--- Content from referenced files ---"


def parts_text(content: Column) -> Column:
    """The text of a message's content, a VARIANT: a text itself, or the texts of a
    list's parts (texts, or objects with one) but attached files, by blank lines; null
    where nothing is left."""
    some = lambda x: F.when(~sc.blank(x), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    own = lambda x: F.coalesce(some(sc.as_text(x)), F.when(~some(sc.as_text(sc.get(x, "text"))).startswith(ATTACHED), some(sc.as_text(sc.get(x, "text")))))
    joined = F.array_join(F.array_compact(F.transform(sc.as_list(content), own)), "\n\n")
    return F.coalesce(some(sc.as_text(content)), F.nullif(joined, F.lit("")))


def message_lines(lines: DataFrame) -> DataFrame:
    """(path, place, text) of logs with a message a line; bad lines are none."""
    v = F.try_parse_json("line")
    return lines.withColumn("_v", v).select("path", F.col("line_no").alias("place"), parts_text(sc.get(F.col("_v"), "content")).alias("text")).filter("text IS NOT NULL")


def message_documents(texts: DataFrame) -> DataFrame:
    """(path, place, text) of the model's messages of logs that are one JSON
    document each; place is that of the message, from 1. ``texts``: path, text."""
    rows = texts.select("path", F.posexplode(sc.as_list(F.try_variant_get(F.try_parse_json("text"), "$.messages", "variant"))).alias("p", "m"))
    kind = F.lower(F.coalesce(sc.as_text(sc.get(F.col("m"), "type")), F.lit("")))
    return rows.filter(kind.isin(*MODEL_TYPES)).select("path", (F.col("p") + 1).cast("long").alias("place"), parts_text(sc.get(F.col("m"), "content")).alias("text")).filter("text IS NOT NULL")


def some_samples(samples: DataFrame, ids: list[str] | None) -> DataFrame:
    """The samples of these ids; all, if none are given."""
    return samples if ids is None else samples.filter(F.col("sample_id").isin(*ids))


def export_turns(texts: DataFrame) -> DataFrame:
    """The answer in a markdown export: what follows the first paragraph after
    the first user header. ``texts``: path, text."""
    rest = F.ltrim(F.regexp_replace(F.regexp_extract("text", r"(?ms)^###[^\n]*User[^\n]*$(.*)", 1), r"^\n+", ""))
    answer = F.substring(F.trim(F.get(F.split(rest, "\n\n", 2), 1)), 1, MOST)
    return texts.select("path", answer.alias("text")).filter(F.length("text") >= LEAST)


def user_turns(lines: DataFrame, header: str = r"^#{2,4}\s.*(User|You|Assistant|ChatGPT).*$") -> DataFrame:
    """Text under each header of a multi-turn export, by a running header."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("turn", F.sum(F.col("line").rlike(header).cast("int")).over(w)).withColumn("speaker", F.last(F.when(F.col("line").rlike(header), F.when(F.col("line").rlike("User|You"), "user").otherwise("assistant")), ignorenulls=True).over(w))
    body = marked.filter((F.col("turn") > 0) & ~F.col("line").rlike(header))
    return body.groupBy("path", "turn", "speaker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("text"))


def flatten_samples(samples: DataFrame) -> DataFrame:
    """Turns of sessions in numeric order, each with its session's time.
    ``samples``: sample_id, conversation (JSON), event_summary (JSON)."""
    parts = samples.select("sample_id", F.from_json("conversation", "map<string,string>").alias("c"), F.from_json("event_summary", "map<string,string>").alias("e"))
    sessions = parts.select("sample_id", "c", "e", F.explode(F.map_filter("c", lambda k, v: k.rlike("^session_[0-9]+$"))).alias("session", "turns"))
    named = F.nullif(F.trim(F.try_element_at("c", F.concat("session", F.lit("_date_time")))), F.lit(""))
    event = F.get_json_object(F.try_element_at("e", F.concat(F.lit("events_"), "session")), "$.date")
    turns = sessions.select("sample_id", "session", F.regexp_extract("session", "([0-9]+)$", 1).cast("int").alias("session_no"), F.coalesce(named, event).alias("session_time"), F.posexplode(F.from_json("turns", "array<struct<dia_id:string,speaker:string,text:string>>")).alias("pos", "t"))
    return turns.select("sample_id", "session_no", "pos", "session_time", "t.dia_id", "t.speaker", "t.text")


def export_archive(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder a table, and a manifest with counts."""
    counts = []
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        counts.append((name, df.count()))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([("archive", 1, n, c) for n, c in counts], "format string, version int, name string, n long").coalesce(1).write.json(f"{path}/manifest")


def import_archive(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """Tables of an archive; fails on another format or version."""
    if spark.read.json(f"{path}/manifest").filter("format != 'archive' OR version != 1").limit(1).count():
        raise ValueError("not an archive of version 1")
    return {k: spark.read.schema(v).json(f"{path}/{k}") for k, v in schemas.items()}
