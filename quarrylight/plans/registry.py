"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans import audit_queries, curation_queries, ranking_queries, service_queries, store_queries, stream_queries, validation_queries

_MODULES = (ranking_queries, curation_queries, store_queries, audit_queries, stream_queries, validation_queries, service_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking_queries.hybrid_rank(spark, sf_dir)
