"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and reread as the next one's input.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. As a stage starts it drops what the stages
before it left in the shared folder, but for tables that ``docs`` itself reads.

Defined results: a null text has no word and is rejected by the first stage, so
no later one sees it there (called alone, they keep it); a text of blanks or
junk is rejected too. Of documents with equal or near-equal texts the least
doc_id stays; rows that repeat doc_id and text become one. Null doc_ids never
remove or lose words. Null sources are a source. Texts are taken whole, however
long. Extra columns pass through all but the last stage, whatever their names.
An empty table gives empty results with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import mixing, packing, probminhash, quality_lines, substring_dedup
from quarrylight.llm.common import drop_path, fresh_dir, live, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """Note what a stage leaves staged, for the next one to drop."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, keep=docs, among=_left)
        before = set(live())
        out = f(spark, docs, sf_dir)
        _left[:] = [p for p in live() if p not in before or p in _left]
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failed lines."""
    return quality_lines.cleaned(docs)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return probminhash.deduplicated(docs)


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has."""
    return substring_dedup.deduplicated(docs)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Signatures and tokens have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        last, path = path, fresh_dir(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            drop_path(spark, last)
