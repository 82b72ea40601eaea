"""Segmentation of long texts: headers, numbered blocks, paragraphs, sentences.

The line state machine has no native form, so it runs in an Arrow-batched
function from texts to arrays of segments; texts that fit one chunk never reach
it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as t

SEGMENTS = "array<struct<index:int,text:string,tokens:int,reason:string>>"
_NUMBERED, _HEADER = re.compile(r"^\s*\d+\.\s+"), re.compile(r"^#{1,3}\s+")


def size(text: str) -> int:
    return -(-len(text.strip()) // 4)


def is_block(lines: list[str]) -> bool:
    return sum(bool(_NUMBERED.match(x)) for x in lines) >= 2


def sections(text: str) -> list[str]:
    """Parts that begin at headers of up to three levels."""
    groups: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _HEADER.match(line) and groups[-1]:
            groups.append([])
        groups[-1].append(line)
    return [x for x in ("\n".join(g).strip() for g in groups) if x] or [text.strip()]


class _Units:
    """Collects lines into units; a run of two numbered lines or more stays whole."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.lines: list[str] = []
        self.numbered = 0

    def close(self) -> None:
        joined = "\n".join(self.lines).strip()
        if joined:
            self.done.append(joined)
        self.lines, self.numbered = [], 0

    def feed(self, line: str) -> None:
        if _HEADER.match(line):
            self.close()
        elif _NUMBERED.match(line):
            if not self.numbered and self.lines and not is_block(self.lines):
                self.close()
            self.numbered += 1
        elif not line.strip():
            if self.numbered >= 2 or self.lines:
                self.close()
            return
        elif self.numbered < 2:
            self.numbered = 0
            if self.lines:
                self.close()
        self.lines.append(line)


def units(text: str) -> list[str]:
    u = _Units()
    for line in text.split("\n"):
        u.feed(line)
    u.close()
    return u.done or [text.strip()]


def hard_split(text: str, most: int) -> list[str]:
    """Paragraphs packed up to ``most`` tokens; longer ones by sentences."""
    out, held = [], ""

    def put(piece: str, joiner: str) -> None:
        nonlocal held
        joined = f"{held}{joiner}{piece}" if held else piece
        if size(joined) <= most:
            held = joined
            return
        if held.strip():
            out.append(held.strip())
        held = piece

    for paragraph in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        joined = f"{held}\n\n{paragraph}" if held else paragraph
        if size(joined) <= most or size(paragraph) <= most:
            put(paragraph, "\n\n")
            continue
        if held:
            out.append(held.strip())
            held = ""
        for sentence in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", paragraph) or [paragraph]:
            put(sentence.strip(), " ")
    if held.strip():
        out.append(held.strip())
    return out or [text.strip()]


def segments(text: str, most: int = 1200, least: int = 200) -> list[tuple[int, str, int, str]]:
    """(index, text, tokens, reason) of a text's chunks."""
    text = text.strip()
    if not text:
        return []
    if size(text) <= most:
        return [(0, text, size(text), "single")]
    parts = sections(text)
    reason = "markdown_header" if len(parts) > 1 else "paragraph"
    found: list[tuple[str, str]] = []
    for part in parts:
        for unit in units(part):
            if size(unit) <= most:
                found.append((unit, "numbered_block" if is_block(unit.split("\n")) else reason))
            else:
                found += [(piece, "hard_max") for piece in hard_split(unit, most)]
    merged = found[:1]
    for piece, why in found[1:]:
        before, kept = merged[-1]
        joined = f"{before}\n\n{piece}"
        if (size(before) < least or size(piece) < least) and size(joined) <= most:
            merged[-1] = (joined, kept)
        else:
            merged.append((piece, why))
    return [(i, x, size(x), why) for i, (x, why) in enumerate(merged)]


def segmented(df: DataFrame, key: str, text: str, most: int = 1200, least: int = 200) -> DataFrame:
    """(key, index, n_segments, text, tokens, reason), one row a segment."""
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, len(found), x, n, why) for k, text in zip(batch.column("k").to_pylist(), batch.column("x").to_pylist()) for found in [segments(text or "", most, least)] for i, x, n, why in found]
            columns = list(zip(*rows)) or [[]] * 6
            types = [batch.schema.field("k").type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, y) for c, y in zip(columns, types)], [key, "index", "n_segments", "text", "tokens", "reason"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x")).withColumn("n", t.estimated_tokens("x"))
    short = rows.filter((F.col("n") <= most) & (F.col("n") > 0)).select(F.col("k").alias(key), F.lit(0).alias("index"), F.lit(1).alias("n_segments"), t.strip("x").alias("text"), F.col("n").alias("tokens"), F.lit("single").alias("reason"))
    long = rows.filter(F.col("n") > most).select("k", "x").mapInArrow(scan, f"`{key}` {kind}, index int, n_segments int, text string, tokens int, reason string")
    return short.unionByName(long)


def chunked_sources(df: DataFrame, base: str) -> DataFrame:
    """Source ids and tags of chunks; one chunk keeps its source id."""
    many = F.col("n_segments") > 1
    out = df.withColumn("source_id", F.when(many, t.chunk_source(F.col(base), F.col("index"))).otherwise(F.col(base)))
    tags = F.array(F.concat(F.lit("chunk_index:"), F.col("index").cast("string")), F.concat(F.lit("chunk_total:"), F.col("n_segments").cast("string")), F.concat(F.lit("split:"), F.col("reason")))
    return out.withColumn("tags", F.when(many, tags).otherwise(F.array().cast("array<string>")))
