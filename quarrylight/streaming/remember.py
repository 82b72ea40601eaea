"""Remembering in order of arrival: each request meets what earlier ones of its
user wrote.

What needs no state, parsing, the repair, the request's source, temporal fields and
guards, is native and runs on all requests at once (``prepared``). What is left is
a fold over each user's requests: the nearest of the newest ``NEWEST`` memories of
each table, the verdict of a consolidator on the two, the check that a merge keeps
half of the new text's significant tokens (C10, C11), the duplicate check within a
source's family (C5), and the write. ``remembered`` folds a table: requests are
dealt by user and sorted, and a task folds one after another with the state of one
user in memory. ``remember_stream`` folds a stream with that state kept by Spark, so
a query started again goes on where its checkpoint is. Both run the same ``step``.

A user's requests are a sequence and are folded by one task; users are spread.
The state of a user is at most ``NEWEST`` rows and ``KEYS`` digests a table.

The consolidator and the embedder are functions of the caller that run in tasks:
``judge(new, id, old)`` gives the model's raw answer or None, ``embed(text)`` a
vector. An answer that is no JSON object with an action, or an error of either,
keeps the decision as it is."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import plain
from quarrylight.functions import temporal
from quarrylight.functions import text as t
from quarrylight.operators import decisions as dc
from quarrylight.operators import service as sv
from quarrylight.operators.segment import segmented

NEWEST, KEYS, FOLDS = 50, 1000, 8
LEAST_SCORE, LEAST_COSINE, RETAINED = 0.3, 0.5, 0.5
TABLES = ("semantic", "episodic")
#: Strength and confidence of a memory whose decision has none.
STRENGTH, CONFIDENCE = {"semantic": 0.85, "episodic": 0.75}, {"semantic": 0.85, "episodic": 0.8}
NO_SOURCE = "llm-response"
FIELDS = ("source_kind", "source_id", "source_timestamp", "source_label", "temporal_expression", "resolved_time")
PREPARED = "user_id string, seq long, request_id string, action string, held string, content string, strength double, confidence double, tags array<string>, source string, " + ", ".join(f"{c} string" for c in FIELDS)
OUT = "user_id string, seq long, request_id string, action string, route string, written string, memory_table string, memory_id string, content string, near_id string, near_score double, conflict_id string"

Judge = Callable[[str, str, str], str | None]
Embed = Callable[[str], list[float]]


def prepared(requests: DataFrame, raw: str, repaired: str, text: str) -> DataFrame:
    """PREPARED: requests as far as no memory is needed. ``held`` is the route of
    one that writes nothing whatever is known (parse_error_noop, a guard's).
    ``requests``: user_id, seq, request_id and the texts; optionally source_id and
    the other fields of a source, and extra_tags."""
    out = sv.remember(requests, raw, repaired, text)
    m, names = F.col("memory"), set(requests.columns)
    when = temporal.normalized(m.temporal_expression, m.content, m.resolved_time, m.resolved_time_confidence, F.coalesce(m.source_timestamp, F.col("source_timestamp") if "source_timestamp" in names else F.lit(None)))
    source = F.coalesce(F.col("source_id") if "source_id" in names else F.lit(None), F.lit(NO_SOURCE))
    tags = F.concat(F.coalesce(m.tags, F.array().cast("array<string>")), F.coalesce(F.col("extra_tags"), F.array().cast("array<string>")) if "extra_tags" in names else F.array().cast("array<string>"))
    held = F.when(F.col("parse_error"), F.lit("parse_error_noop")).otherwise(F.col("guard_route"))
    fields = [F.coalesce(m.source_id, source).alias(c) if c == "source_id" else when[c].alias(c) if c.startswith(("temporal", "resolved")) else m[c].alias(c) for c in FIELDS]
    return out.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("seq").cast("long").alias("seq"), F.col("request_id").cast("string").alias("request_id"),
        "action", held.alias("held"), "content", m.strength.alias("strength"), m.confidence.alias("confidence"), tags.alias("tags"), source.alias("source"), *fields,
    )


def chunk_requests(requests: DataFrame, text: str, most: int = 1200, least: int = 200) -> DataFrame:
    """Each request as its segments, each a request of its own: ``text`` is the
    segment, source_id ``base:chunk-i``, the source's kind and label name the chunk, tags
    tell index, total and split, and ``seq`` is a struct of the request's and the index,
    as a number (requests of up to 100,000 segments). ``requests``: user_id, seq,
    request_id (unique), text and optionally the fields of a source and extra_tags."""
    names = set(requests.columns)
    cut = segmented(requests, "request_id", text, most, least)
    given = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    own = requests.drop(text).withColumnsRenamed({c: f"_{c}" for c in ("source_id", "source_kind", "source_label", "extra_tags") if c in names})
    old = lambda c: F.col(f"_{c}") if c in names else given(c)
    of = F.concat_ws("/", (F.col("index") + 1).cast("string"), F.col("n_segments").cast("string"))
    tags = F.array(*[F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("chunk_index", "index"), ("chunk_total", "n_segments"), ("chunk_split", "reason"))])
    kept = F.coalesce(F.col("_extra_tags"), F.array().cast("array<string>")) if "extra_tags" in names else F.array().cast("array<string>")
    rows = own.join(cut.withColumnRenamed("text", "_text"), "request_id")
    rows = rows.withColumns(
        {
            "parent_id": F.col("request_id"), "chunk": F.col("index"), "chunks": F.col("n_segments"), text: F.col("_text"), "seq": F.col("seq") * 100_000 + F.col("index"),
            "source_id": t.chunk_source(F.coalesce(old("source_id"), F.lit(NO_SOURCE)), F.col("index")), "source_kind": F.coalesce(old("source_kind"), F.lit("llm_response_chunk")),
            "source_label": F.coalesce(F.concat(old("source_label"), F.lit(" [chunk "), of, F.lit("]")), F.concat(F.lit("llm-response chunk "), of)), "extra_tags": F.concat(kept, tags),
        }
    )
    return rows.withColumn("request_id", F.concat_ws(":", "parent_id", "chunk")).drop("index", "n_segments", "tokens", "reason", "_text", *[f"_{c}" for c in ("source_id", "source_kind", "source_label", "extra_tags")])


def chunked(chunks: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """What became of each request: parent_id, chunk_count, chunks_stored,
    chunks_grounded, deduped, action, route, written. ``results``: OUT of ``chunks``."""
    both = chunks.select("parent_id", "request_id", "chunk", F.col(text).alias("_text")).join(results.select("request_id", "route", "written", "content"), "request_id")
    stored = F.col("written") != ""
    grounded = stored & dc.grounding(t.significant_tokens("_text"), F.array_distinct(t.significant_tokens("content"))).grounded
    rows = both.withColumns({"_stored": stored, "_grounded": grounded}).groupBy("parent_id").agg(
        F.count("*").alias("chunk_count"), F.count_if("_stored").alias("chunks_stored"), F.count_if("_grounded").alias("chunks_grounded"), F.count_if(F.col("route") == "dedupe_skip").alias("deduped"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_stored"), F.struct("chunk", "written")))), lambda x: x.written), ",").alias("written"),
    )
    some = F.col("chunks_stored") > 0
    return rows.select("parent_id", "chunk_count", "chunks_stored", "chunks_grounded", "deduped", F.when(some, "store_episodic").otherwise("ignore").alias("action"), F.when(some, "chunked_remember").otherwise("ignore").alias("route"), "written")


def cosine(a: list[float], b: list[float]) -> float:
    """Over the common prefix, 0 where it is empty or a norm is 0."""
    pairs = list(zip(a, b))
    norm = sqrt(sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs))
    return sum(x * y for x, y in pairs) / norm if norm else 0.0


def consolidation(raw: str | None) -> tuple[str, str] | None:
    """(action, merged text) of a consolidator's answer, None if it has none."""
    try:
        found = json.loads(plain.json_object(raw or ""))
        action = plain.strip(found["action"]).lower()
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    if not action:
        return None
    action = dc.ALIASES.get(action, action)
    merged = found.get("merged_content")
    return action if action in dc.ROUTES else "store_episodic", merged if isinstance(merged, str) else ""


def retains(new: str, merged: str) -> bool:
    """True if ``merged`` has half of the significant tokens of ``new``."""
    own, held = list(dict.fromkeys(plain.significant_tokens(new))), set(plain.significant_tokens(merged))
    return not own or sum(x in held for x in own) >= ceil(len(own) * RETAINED)


class Known:
    """What is known of one user: rows newest first, and digests of their texts."""

    def __init__(self, packed: str | None = None):
        held = json.loads(packed) if packed else {}
        self.rows = {t: deque(held.get("rows", {}).get(t, [])) for t in TABLES}
        self.keys = {t: deque(held.get("keys", {}).get(t, [])) for t in TABLES}
        self.memories = {t: deque(plain.Memory(t, r) for r in self.rows[t]) for t in TABLES}
        self.index, self.sources = plain.Index(), defaultdict(list)
        for table in TABLES:
            for m in self.memories[table]:
                self.index.add(m)
            for key, source in self.keys[table]:
                self.sources[key].append(source)

    def packed(self) -> str:
        return json.dumps({"rows": {t: list(x) for t, x in self.rows.items()}, "keys": {t: list(x) for t, x in self.keys.items()}})

    def nearest(self, text: str) -> tuple[plain.Memory, float] | None:
        """The best memory of all, the earlier of equals: semantic, then newest first."""
        question = plain.Question(text)
        common = self.index.scores(question)
        scored = [(m, common[m] if m in common else m.bare[question.temporal]) for t in TABLES for m in self.memories[t]]
        return max(scored, key=lambda x: x[1], default=None)

    def has_text(self, text: str, source: str) -> bool:
        """The same text from this source, its base or a chunk of that."""
        key, family = _digest(text), re.sub(r":chunk-[0-9]+$", "", source)
        return any(s in (source, family) or s.startswith(f"{family}:chunk-") for s in self.sources.get(key, ())) and bool(plain.content_key(text))

    def write(self, table: str, row: dict) -> None:
        row = row | {"strength": STRENGTH[table] if row["strength"] is None else row["strength"], "confidence": CONFIDENCE[table] if row["confidence"] is None else row["confidence"]}
        memory, key = plain.Memory(table, row), [_digest(row["content"]), row["source_id"] or ""]
        self.rows[table].appendleft(row)
        self.memories[table].appendleft(memory)
        self.index.add(memory)
        self.keys[table].appendleft(key)
        self.sources[key[0]].append(key[1])
        if len(self.rows[table]) > NEWEST:
            self.rows[table].pop()
            self.index.remove(self.memories[table].pop())
        if len(self.keys[table]) > KEYS:
            key, source = self.keys[table].pop()
            self.sources[key].remove(source)
            if not self.sources[key]:
                del self.sources[key]


@lru_cache(8)
def _digest(text: str) -> str:
    return hashlib.blake2b(plain.content_key(text).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def step(known: Known, r: dict, judge: Judge | None, embed: Embed | None) -> dict:
    """One request: the row of OUT, with ``known`` changed by what it writes."""
    action, content, conflict, near = r["action"], plain.strip(r["content"] or ""), None, None
    out = {"user_id": r["user_id"], "seq": r["seq"], "request_id": r["request_id"], "written": "", "memory_table": None, "memory_id": None, "near_id": None, "near_score": None, "conflict_id": None}
    if r["held"]:
        return out | {"action": "ignore", "route": r["held"], "content": content}
    stores = dc.ROUTES[action] not in ("ignore", "recall_only") and content
    if stores and judge:
        near = known.nearest(content)
        if near and near[1] >= LEAST_SCORE:
            verdict = _verdict(content, near[0], judge, embed)
            if verdict:
                action, merged = verdict
                content = merged if action == "update_existing" and plain.strip(merged) else content
                conflict = near[0].id if action == "flag_conflict" else None
    out |= {"near_id": near[0].id if near else None, "near_score": near[1] if near else None, "conflict_id": conflict}
    content = plain.strip(content)
    if content and known.has_text(content, r["source"]):
        return out | {"action": "ignore", "route": "dedupe_skip", "content": content, "conflict_id": None}
    route = dc.ROUTES[action]
    if route in ("ignore", "recall_only"):
        return out | {"action": action, "route": route, "content": content, "conflict_id": None}
    if not content:
        return out | {"action": "ignore", "route": "ignore", "content": content, "conflict_id": None}
    written = ["conflicts", "episodic"] if action == "flag_and_store" else dc.TARGETS[route]
    table = next((x for x in written if x in TABLES), None)
    if table:
        known.write(table, {"id": r["request_id"], "content": content} | {c: r[c] for c in ("strength", "confidence", *FIELDS)} | {"tags": [x for x in r["tags"] if x is not None]})
    return out | {"action": action, "route": route, "written": ",".join(written), "memory_table": table, "memory_id": r["request_id"] if table else None, "content": content}


def _verdict(content: str, near: plain.Memory, judge: Judge, embed: Embed | None) -> tuple[str, str] | None:
    try:
        if embed and cosine(embed(content), embed(near.content)) < LEAST_COSINE:
            return None
        found = consolidation(judge(content, near.id, near.content))
    except Exception:  # of the caller's model: consolidation never blocks a write
        return None
    if found and found[0] == "update_existing" and plain.strip(found[1]) and not retains(content, found[1]):
        return None
    return found


_NAMES = [x.split()[0] for x in OUT.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (x.split() for x in OUT.split(", "))])


def _folded(judge: Judge | None, embed: Embed | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, known = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if known is None or r["user_id"] != user:
                    user, known = r["user_id"], Known()
                rows.append(step(known, r, judge, embed))
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return scan


def remembered(requests: DataFrame, judge: Judge | None = None, embed: Embed | None = None) -> DataFrame:
    """OUT of each row of ``prepared`` requests, each user's in the order of (seq,
    request_id). Rows of a null user are one user's."""
    spark = requests.sparkSession
    # a number of partitions that is given is kept: folds cost much for few bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), FOLDS * spark.sparkContext.defaultParallelism)
    dealt = requests.select(*[x.split()[0] for x in PREPARED.split(", ")]).repartition(n, "user_id").sortWithinPartitions("user_id", "seq", "request_id")
    return dealt.mapInArrow(_folded(judge, embed), OUT)


def _fold(judge: Judge | None, embed: Embed | None, forget: int):
    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = Known(state.get[0] if state.exists else None)
        rows = sorted((r for p in parts for r in pa.Table.from_pandas(p, _REQUEST, preserve_index=False).to_pylist()), key=lambda r: (r["seq"] is not None, r["seq"] or 0, r["request_id"] or ""))
        out = [step(known, r, judge, embed) for r in rows]
        state.update((known.packed(),))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame(out, columns=_NAMES).astype({"seq": "Int64", "near_score": "float64"})

    return fold


def remember_stream(requests: DataFrame, judge: Judge | None = None, embed: Embed | None = None, idle: int = 0) -> DataFrame:
    """The same of a stream of ``prepared`` requests. A micro-batch's requests of a
    user are taken in the order of (seq, request_id), batches as they come. With
    ``idle`` (milliseconds) the state of a user who was silent so long is dropped, and
    what follows meets no memory; without it, state stays. Give ``idle`` to queries
    that poll: one that drains what is there waits for timeouts without end."""
    columns = requests.select(*[x.split()[0] for x in PREPARED.split(", ")])
    return columns.groupBy("user_id").applyInPandasWithState(_fold(judge, embed, idle), OUT, "known string", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


_REQUEST = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split() for x in PREPARED.split(", "))])
