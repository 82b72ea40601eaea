"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``length`` consecutive words at least one
``seed``-word run is chosen, and the choice depends only on those words, so two
texts that share a passage of ``length`` words share the anchors inside it.
Anchors are joined across texts by a partially aggregated minimum and maximum
of doc_id. From each anchor that two texts share the match is extended to both
sides: every ``length``-word window that has it for its own anchor (its least
run) is looked up among those of other texts, and the windows found in a text
with a smaller doc_id merge into maximal repeats (``spans``). A window whose own
anchor no other text has can't be a repeat and is never made into a row.

No pair of texts is ever formed, so a passage shared by a third of all rows
costs a row for each occurrence and window, not for each pair. Texts of equal
words are represented by that with the smallest doc_id. Windows are compared by
128 bits, two hashes over independent word hashes (see ``wordhash``).

Defined results: a null text has no words; a text under ``length`` words loses
nothing; a row with null doc_id loses nothing and takes nothing from others;
rows with equal doc_id never remove words from one another, and those that also
repeat the text have equal results; a text of any length is taken whole; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import BLANKS, Scratch, maybe_in, split_by, text_slices
from quarrylight.llm.wordhash import Words, runs, slide, text_buffer, winnow

LENGTH, SEED = 50, 25
EMPTY = hashlib.sha256(b"").hexdigest()


def _mark(sha: bytes) -> int:
    """A number that tells texts of one doc_id apart."""
    return int.from_bytes(sha[:8], "big", signed=True)


def _anchors(words: Words, length: int, seed: int) -> np.ndarray:
    grams = runs(words.hash, seed)
    starts = np.arange(max(0, len(words) - length + 1))
    ends = np.repeat(words.off[1:], np.diff(words.off))
    return winnow(grams, starts + length <= ends[: len(starts)], length - seed + 1)


def _seeds(length: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words(*text_buffer(batch.column("text")), shas=True)
            at = _anchors(words, length, seed)
            cut = np.searchsorted(at, words.off)
            grams = runs(words.hash, seed)[at].view(np.int64) if len(at) else np.empty(0, np.int64)
            places = (at - np.repeat(words.off[:-1], np.diff(cut))).astype(np.int32)
            cut = cut.astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([_mark(x) for x in words.shas], pa.int64()),
                    pa.array(np.diff(words.off), pa.int64()),
                    pa.array(words.shas, pa.binary()),
                    pa.ListArray.from_arrays(cut, pa.array(grams)),
                    pa.ListArray.from_arrays(cut, pa.array(places)),
                ],
                ["doc_id", "mark", "n_words", "sha", "anchors", "places"],
            )

    return scan


def _extend(length: int, seed: int):
    """The windows whose own anchor, their least run, is shared, as two hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words(*text_buffer(batch.column("text")))
            if len(words) < length:
                continue
            grams = runs(words.hash, seed)
            least = slide(grams, length - seed + 1, np.minimum)
            at, of = [], []
            for i in range(batch.num_rows):
                a, n = int(words.off[i]), int(words.off[i + 1] - words.off[i]) - length + 1
                if n > 0:
                    found = np.flatnonzero(np.isin(least[a : a + n], grams[a + batch.column("places")[i].values.to_numpy()]))
                    at.append(found + a)
                    of.append(np.full(len(found), i))
            if not at:
                continue
            at, of = np.concatenate(at), np.concatenate(of)
            one, two = runs(words.hash, length, 1)[at], runs(words.hash2, length, 2)[at]
            yield pa.record_batch(
                [
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    *(batch.column(c).take(pa.array(of)) for c in ("doc_id", "mark")),
                    pa.array((at - words.off[of]).astype(np.int32)),
                ],
                ["h1", "h2", "doc_id", "mark", "place"],
            )

    return scan


def _cut(length: int):
    """The text without the words of the windows at ``places``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            raw, off = text_buffer(batch.column("text"))
            words = Words(raw, off)
            texts, spans, removed, kept = [], [], [], []
            for i in range(batch.num_rows):
                a, b = int(words.off[i]), int(words.off[i + 1])
                step = np.zeros(b - a + 1, np.int32)
                p = batch.column("places")[i].values.to_numpy()
                np.add.at(step, p, 1)
                np.add.at(step, p + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                text = _without(raw[off[i] : off[i + 1]].tobytes(), words.start[a:b] - off[i], words.end[a:b] - off[i], edge)
                texts.append(text)
                spans.append(edge.tolist())
                removed.append(int(gone.sum()))
                kept.append(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shas=True).shas[0].hex())
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "mark")),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array([t.decode() for t in texts], pa.string()),
                ],
                ["doc_id", "mark", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return scan


def _without(text: bytes, start: np.ndarray, end: np.ndarray, spans: np.ndarray) -> bytes:
    """``text`` less the words of each span; blanks between kept words stay."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : start[a]])
        at = int(start[b]) if b < len(start) else int(end[b - 1])
    return b"".join([*parts, text[at:]])


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame, Scratch]:
    """(rows, cuts, scratch). rows: (doc_id, mark, n_words, sha, copy) for every
    input row, ``copy`` where another text of the same words has a smaller
    doc_id. cuts: (doc_id, mark, n_removed, kept_sha256, spans, kept_text) of the
    other texts that lose words; spans are maximal repeats [from, to) in words.
    Both read tables of ``scratch``."""
    scratch = Scratch(docs.sparkSession, "op7")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.stage(docs.mapInArrow(_seeds(length, seed), "doc_id long, mark long, n_words long, sha binary, anchors array<long>, places array<int>"), "seeds")
    copied = found.filter(f"n_words >= {length} AND doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = scratch.stage(copied.filter("first_id < last_id").select("sha", "first_id"), "copied")
    # most texts have no copy; a bounded bitmap keeps them and their anchors from the shuffle
    may, never = split_by(found, "sha", copied, "sha", copied.count())
    marked = may.join(copied, "sha", "left").withColumn("copy", F.expr("coalesce(doc_id > first_id, false)")).select(*found.columns, "copy")
    marked = scratch.stage(marked, "marked")
    flat = never.unionByName(marked.filter("NOT copy").drop("copy")).filter("doc_id IS NOT NULL AND size(anchors) > 0")
    shared = flat.select("doc_id", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = scratch.stage(shared, "shared")  # a join can split hot keys only of what it reads, not of an aggregate
    placed = flat.select("doc_id", "mark", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("doc_id", "mark", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    placed = maybe_in(placed, "anchor", shared, "anchor", shared.count())
    hits = scratch.stage(placed.join(shared, "anchor").groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places")), "hits")
    scratch.drop("shared")
    near = maybe_in(docs, "doc_id", hits, "doc_id", hits.count()).withColumn("mark", _mark_of("text"))
    texts = scratch.stage(near.join(hits, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]), "texts")
    scratch.drop("hits")
    windows = scratch.stage(texts.mapInArrow(_extend(length, seed), "h1 long, h2 long, doc_id long, mark long, place int"), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("h1", "h2", "first_id")
    firsts = scratch.stage(firsts, "firsts")
    doomed = windows.join(firsts, ["h1", "h2"]).filter("doc_id > first_id").groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places"))
    doomed = scratch.stage(doomed, "doomed")
    scratch.drop("windows", "firsts")
    cuts = texts.drop("places").join(doomed, ["doc_id", "mark"]).mapInArrow(_cut(length), "doc_id long, mark long, n_removed long, kept_sha256 string, spans array<array<long>>, kept_text string")
    rows = never.withColumn("copy", F.lit(False)).unionByName(marked).select("doc_id", "mark", "n_words", "sha", "copy")
    return rows, cuts, scratch


def _mark_of(column: str):
    """``_mark`` of a text's words joined by one space."""
    words = F.regexp_replace(F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    return F.conv(F.substring(F.sha2(words, 256), 1, 16), 16, -10).cast("long")


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256,
    and spans, the maximal repeats removed, as [from, to) in words."""
    rows, cuts, scratch = repeats(docs, length, seed)
    cuts = scratch.stage(cuts.drop("kept_text"), "cuts")
    scratch.drop("texts", "doomed")
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return rows.join(cuts, ["doc_id", "mark"], "left").select(
        "doc_id",
        "n_words",
        F.expr("CASE WHEN copy THEN n_words ELSE coalesce(n_removed, 0L) END").alias("n_removed"),
        F.expr(f"CASE WHEN copy THEN '{EMPTY}' ELSE coalesce(kept_sha256, lower(hex(sha))) END").alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` set
    anew where there is one; rows without a word go, null texts stay."""
    rows, cuts, scratch = repeats(docs, length, seed)
    cuts = scratch.stage(cuts.select("doc_id", "mark", "kept_text"), "cuts")
    scratch.drop("texts", "doomed")
    changed = rows.filter("copy").select("doc_id", "mark", F.lit("").alias("kept_text")).distinct().unionByName(cuts)
    changed = scratch.stage(changed.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), F.col("kept_text").alias("kept")), "changed")
    scratch.drop("cuts", "marked", "copied", "seeds")
    # texts that surely stay as they are take no part in the join; the columns of
    # docs travel in one struct, so that none can clash with those of the join
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    may, never = split_by(whole, "id", changed, "id", changed.count())
    may = may.withColumn("of", _mark_of("row.text"))
    kept = may.join(changed, ["id", "of"], "left").select("row", "kept")
    out = kept.unionByName(never.select("row", F.lit(None).cast("string").alias("kept")))
    columns = []
    for f in docs.schema:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.coalesce(F.col("kept"), own)
        elif f.name == "n_chars":
            own = F.when(F.col("kept").isNull(), own).otherwise(F.length("kept").cast(f.dataType))
        columns.append(own.alias(f.name))
    return out.select(*columns).filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT row_id, doc_id, i, array_to_string(list_slice(words, i, i + {LENGTH} - 1), ' ') AS g
  FROM (SELECT row_id, doc_id, words, unnest(range(1, len(words) - {LENGTH} + 2)) AS i FROM w WHERE doc_id IS NOT NULL AND len(words) >= {LENGTH})
), marked AS (
  SELECT row_id, i FROM (SELECT row_id, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS first_id FROM windows) WHERE first_id < doc_id
), gone AS (
  SELECT row_id, list(DISTINCT p) AS ps FROM (SELECT row_id, unnest(range(i, i + {LENGTH})) AS p FROM marked) GROUP BY row_id
), kept AS (
  SELECT w.row_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM w JOIN (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) x ON w.row_id = x.row_id
  LEFT JOIN (SELECT row_id, unnest(ps) AS p FROM gone) g ON g.row_id = x.row_id AND g.p = x.p
  WHERE g.p IS NULL GROUP BY w.row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (row_id)
"""
