"""The memory tables: scans, upserts and append logs as DataFrame functions.

Rows carry ``seq``, the order of ingest; "newest" is the highest created_at,
then seq. Scans over all users are windows by user, never sorts of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as t

#: Defaults of what is written.
DEFAULTS = {"episodic": {"strength": 0.75, "decay_rate": 0.02, "emotional_weight": 0.2, "confidence": 0.8}, "semantic": {"strength": 0.85, "decay_rate": 0.005, "emotional_weight": 0.2, "confidence": 0.85}}


def newest(df: DataFrame, by: list[str], limit: int, order: list | None = None) -> DataFrame:
    """The newest ``limit`` rows of each group."""
    order = order or [F.col("created_at").desc(), F.col("seq").desc()]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= limit).drop("_rn")


def select_memories(tables: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """Newest of each table and user, limits by table; columns an archive
    lacks are null and archived_at stands for created_at."""
    parts = []
    for name, df in tables.items():
        df = df.withColumnRenamed("archived_at", "created_at") if "created_at" not in df.columns and "archived_at" in df.columns else df
        parts.append(newest(df, ["user_id"], limit).withColumn("table", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def select_indexables(df: DataFrame, limit: int = 100) -> DataFrame:
    """By salience, then newest."""
    return newest(df, ["user_id"], limit, [F.col("salience").desc(), F.col("created_at").desc(), F.col("seq").desc()])


def ingested(df: DataFrame, limit: int = 100) -> DataFrame:
    """S3: the newest rows of a table, all users together, by order of ingest."""
    return df.orderBy(F.col("seq").desc()).limit(limit)


def by_key(df: DataFrame, user: str, key: str) -> DataFrame:
    """The row of a user and key, without regard to case."""
    return df.filter((F.col("user_id") == user) & (F.lower("key") == key.strip().lower()))


def pending(df: DataFrame, status: str = "pending", limit: int = 20) -> DataFrame:
    """The oldest rows of a status."""
    return df.filter(F.col("status") == status).orderBy("created_at", "seq").limit(limit)


def lookup(keys: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories by (table, id), misses dropped."""
    return keys.join(memories, ["table", "id"])


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Scores that were not given, by table."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in DEFAULTS[table].items()})


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """The last row of each key by seq; ``keep`` columns stay those of the first."""
    both = old.unionByName(new, allowMissingColumns=True)
    last, first = Window.partitionBy(*key).orderBy(F.col("seq").desc()), Window.partitionBy(*key).orderBy("seq")
    for c in keep:
        both = both.withColumn(f"_{c}", F.first(c).over(first))
    out = both.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    for c in keep:
        out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out


def upsert_partial(old: DataFrame, new: DataFrame, key: str = "id", defined: str | None = None) -> DataFrame:
    """Columns that the new row defines replace the old, a defined null too;
    new ids and columns are added. ``defined``: a column of ``new`` with the names
    of what its row defines; without it, that is what is not null."""
    names = [*old.columns, *[c for c in new.columns if c not in old.columns and c != defined]]
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
        mine, theirs = (F.col(f"{side}.{c}") if c in df.columns else F.lit(None) for side, df in (("a", old), ("b", new)))
        if c not in new.columns:
            return mine
        given = F.coalesce(F.array_contains(F.col(f"b.{defined}"), c), F.lit(False)) if defined else theirs.isNotNull()
        return F.when(given, theirs).otherwise(mine)

    return joined.select(*[merged(c).alias(c) for c in names])


def valid_facts(df: DataFrame) -> DataFrame:
    """Trimmed subject, snake predicate, a value, confidence 0.35 or more."""
    out = df.withColumns({"subject": t.strip("subject"), "predicate": t.predicate("predicate"), "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.75)), "value_text": F.coalesce(F.nullif(t.strip("value_text"), F.lit("")), F.nullif(t.strip("value"), F.lit("")))})
    return out.filter("subject != '' AND predicate IS NOT NULL AND value_text IS NOT NULL AND confidence >= 0.35")


def last_accessed(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Access times as an append-only log, the latest on read."""
    seen = log.groupBy("table", "id").agg(F.max("ts").alias("last_accessed"))
    return memories.join(seen, ["table", "id"], "left")


def low_confidence_ignores(df: DataFrame) -> DataFrame:
    """Ignored, nothing written, confidence missing or under a half."""
    return df.filter("final_action = 'ignore' AND NOT wrote AND (confidence IS NULL OR confidence < 0.5)")


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")
