"""Delta-maintained token counts.

A change feed has rows (kind, doc_id, source, lang, tokenizer, n_tokens) and, for
a revision, old_tokens: an insert adds a document and its tokens, a delete takes
them away, a revision adds the difference of two counts. A revision that moves a
document has ``moved`` and old_source and old_lang, and takes all from the old
group and adds all to the new one. Signs make every change additive, so a batch is
reduced to one row for each (source, lang, tokenizer) by a partial aggregate and
written as an immutable delta; totals are the sum of the deltas that are
committed. The feed is taken at its word: no state of single documents is kept.

Commits are idempotent: a numbered log entry, visible by a rename that fails if
the number is taken, names one batch and its delta; a batch already named is
skipped, a delta of an interrupted or losing writer is never named and so never
counted. Entries are immutable and of constant size; a writer reads each once.
``compact`` commits a sum in place of the deltas that it has read, if all of them
still stand when it commits, and ``vacuum`` drops those.

Defined results: a null text has 0 tokens; null source and lang are groups of
their own; repeated rows count each; keys whose totals return to nothing stay
with zeros until compaction; texts of any length are counted whole; extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import CommitLog, drop_path, fresh_dir, staged
from quarrylight.llm.tokens import count

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: The tokenizer versions counted by the query.
VERSIONS = ("byte_bpe_50k", "words_v1")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column("text")]
        columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
        yield pa.record_batch([*columns, pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t.encode().split()) for t in texts], pa.int64())], ["doc_id", "source", "lang", *VERSIONS])


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens for each tokenizer version."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    wide = rows.mapInArrow(_counted, "doc_id long, source string, lang string, byte_bpe_50k long, words_v1 long")
    parts = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("n_tokens")) for v in VERSIONS])
    return wide.withColumn("x", F.explode(parts)).select("doc_id", "source", "lang", "x.tokenizer", "x.n_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows (keys, n_docs, n_tokens) of kinds insert, delete, revise."""
    names = set(changes.columns)
    old = {c: F.col(f"old_{c}") if f"old_{c}" in names else F.col(c) for c in ("source", "lang")}
    moved = F.col("moved") if "moved" in names else F.lit(False)

    def row(docs: int, tokens: Column, source: Column | None = None, lang: Column | None = None) -> Column:
        return F.struct((F.col("source") if source is None else source).alias("source"), (F.col("lang") if lang is None else lang).alias("lang"), F.lit(docs).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))

    n, before = F.col("n_tokens"), F.col("old_tokens")
    rows = (
        F.when(F.col("kind") == "insert", F.array(row(1, n))).when(F.col("kind") == "delete", F.array(row(-1, -n)))
        .when((F.col("kind") == "revise") & moved, F.array(row(-1, -before, old["source"], old["lang"]), row(1, n))).when(F.col("kind") == "revise", F.array(row(0, n - before)))
    )
    return changes.select("tokenizer", F.explode(rows).alias("x")).select("x.source", "x.lang", "tokenizer", "x.n_docs", "x.n_tokens")


def reduced(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)
        self.version, self.batches, self.deltas, self.covered = -1, set(), {}, []

    def _refresh(self) -> None:
        for version in self.log.versions():
            if version <= self.version:
                continue
            entry = self.log.read(version)
            if "batch" in entry:
                self.batches.add(entry["batch"])
            else:
                gone = [v for v in self.deltas if v <= entry["covers"]]
                self.covered += [self.deltas.pop(v) for v in gone]
            self.deltas[version] = entry["path"]
            self.version = version

    def _commit(self, entry: dict, holds: Callable[[], bool], tries: int = 100) -> bool:
        """Commit ``entry`` as the next version; False if, of what is known just
        before, ``holds`` no longer does."""
        for _ in range(tries):
            self._refresh()
            if not holds():
                return False
            if self.log.commit(self.version + 1, entry):
                self._refresh()
                return True
        raise RuntimeError(f"{entry} could not be committed")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit one batch; False if it was committed before."""
        self._refresh()
        if batch in self.batches:
            return False
        path = f"{self.root}/delta-{_safe(batch)}-{fresh_name()}"
        reduced(signed(changes)).write.parquet(path)
        return self._commit({"batch": batch, "path": path}, lambda: batch not in self.batches)

    def compact(self) -> bool:
        """A sum for the deltas known now, and those alone; what comes meanwhile
        stays. False, with nothing changed, if there is at most one, or if another
        compaction has taken any of them first."""
        self._refresh()
        parts, covers = dict(self.deltas), self.version
        if len(parts) < 2:
            return False
        path = f"{self.root}/sum-{fresh_name()}"
        self._sum(list(parts.values())).filter("n_docs != 0 OR n_tokens != 0").write.parquet(path)
        # later batches have greater versions, so ``covers`` names ``parts`` while all of them live
        if self._commit({"covers": covers, "path": path}, lambda: parts.items() <= self.deltas.items()):
            return True
        drop_path(self.spark, path)
        return False

    def vacuum(self) -> None:
        """Drop the deltas that a sum stands for, when no reader needs them."""
        self._refresh()
        for path in self.covered:
            drop_path(self.spark, path)
        self.covered = []

    def totals(self) -> DataFrame:
        self._refresh()
        if not self.deltas:
            return self.spark.createDataFrame([], TOTALS)
        return self._sum(list(self.deltas.values()))

    def _sum(self, paths: list[str]) -> DataFrame:
        return reduced(self.spark.read.schema(TOTALS).parquet(*paths))


def fresh_name() -> str:
    return uuid.uuid4().hex


def _safe(name: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in name)[:60]


def rolled_up(docs: DataFrame, batches: int = 4) -> DataFrame:
    """The totals of ``docs`` as a feed brings them: loads in batches, a tenth of
    the documents under no source at first; a replay, which changes nothing; a
    compaction; a revision of every byte_bpe_50k count to one with an end id; a
    move of that tenth to its source; and another tenth deleted and loaded anew."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(F.lit("feed"), "doc_id"), F.lit(10))
    counts = staged(token_counts(docs).withColumns({"place": place, "old_tokens": F.lit(None).cast("long")}), "op5-counts")
    ends = F.when(F.col("tokenizer") == VERSIONS[0], 1).otherwise(0)
    rollup = Rollup(spark, fresh_dir(spark, "rollup"))
    source = F.when(F.col("place") != 0, F.col("source"))
    inserts = counts.withColumn("kind", F.lit("insert"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        rollup.apply(f"load-{b}", inserts.filter(part == b).withColumn("source", source))
    rollup.apply("load-1", inserts.filter(part == 1))
    rollup.compact()
    rollup.vacuum()
    # a first count without the end of text is revised to one with it
    final = counts.withColumns({"n_tokens": F.col("n_tokens") + ends, "old_tokens": F.col("n_tokens")})
    rollup.apply("revise", final.withColumns({"kind": F.lit("revise"), "source": source}))
    moves = final.filter("place = 0").withColumns({"kind": F.lit("revise"), "moved": F.lit(True), "old_source": F.lit(None).cast("string"), "old_lang": F.col("lang"), "old_tokens": F.col("n_tokens")})
    rollup.apply("move", moves)
    rollup.apply("delete", final.filter("place = 1").withColumn("kind", F.lit("delete")))
    rollup.apply("restore", final.filter("place = 1").withColumn("kind", F.lit("insert")))
    rollup.compact()
    return rollup.totals()
