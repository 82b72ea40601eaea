"""Registered queries of this package: thin wrappers that read the tables and
derive the contract's columns from each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.centroids import SQL as CENTROIDS_SQL
from quarrylight.llm.manifest import SQL as MANIFEST_SQL
from quarrylight.llm.mixing import SQL as MIXING_SQL
from quarrylight.llm.quality_lines import SQL as QUALITY_SQL
from quarrylight.llm.substring_dedup import SQL as SUBSTRING_SQL
from quarrylight.llm.topk_search import SQL as TOPK_SQL
from quarrylight.llm.warc import SQL as WARC_SQL


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.substring_dedup import substring_dedup

    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.topk_search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.langid import predict_languages

    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.token_rollup import rolled_up

    return rolled_up(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.sharding import sharded

    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.quality_lines import quality

    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links, first."""
    from quarrylight.llm.probminhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.packing import packed

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.lm_scoring import lm_scores

    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.manifest import manifest

    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.centroids import clustered

    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_quality_lines,
        op3_langid,
        op4_probminhash,
        op5_token_rollup,
        op6_mixing,
        op7_substring_dedup,
        op8_sharding,
        op9_packing,
        op10_warc,
        op11_bloom_lm,
        op12_manifest,
        op13_centroids,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_quality_lines": QUALITY_SQL, "op6_mixing": MIXING_SQL, "op1_topk_search": TOPK_SQL, "op7_substring_dedup": SUBSTRING_SQL, "op10_warc": WARC_SQL, "op12_manifest": MANIFEST_SQL, "op13_centroids": CENTROIDS_SQL}
