"""Ranking queries: documents as memories, benchmark texts as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as t
from quarrylight.operators import ranking as r
from quarrylight.operators import vectors as vc
from quarrylight.plans import sqltext as s


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of one user; labels set confidence and table."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "text", "lang", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        F.lit("u").alias("user_id"), F.when(F.col("quality") == 1, "semantic").otherwise("episodic").alias("table"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"),
        F.col("text").alias("content"), F.array("lang").alias("tags"), F.col("source").alias("source_kind"), F.col("quality").cast("double").alias("confidence"), F.lit(None).cast("double").alias("strength"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.lit("u").alias("user_id"), F.col("item_id").alias("qid"), F.col("text").alias("query"), F.array(F.lit("semantic")).alias("preferred"))


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.hybrid_rank(questions(spark, sf_dir), document_memories(spark, sf_dir), top_k=5, min_score=0.35).drop("user_id", "preferred_table")


MEMORIES_SQL = f"""
base AS (
  SELECT d.doc_id, d.text, d.lang || '' AS tag_text, d.text || ' ' || d.lang || ' ' || d.source || '     ' AS searchable,
    CASE WHEN l.quality = 1 THEN 'semantic' ELSE 'episodic' END AS tbl, coalesce(l.quality::DOUBLE, 0.5::DOUBLE) AS confidence, 0.5::DOUBLE AS strength
  FROM documents d LEFT JOIN labels l USING (doc_id)
), m AS (
  SELECT *, {s.tokens('searchable')} AS mt, {s.numbers('searchable')} AS mn, {s.tokens('tag_text')} AS mg, {s.temporal_signal('searchable')} AS sig,
    array_to_string(list_slice({s.tokens('text')}, 1, 28), ' ') AS ckey FROM base
), q AS (
  SELECT item_id AS qid, {s.tokens('text')} AS qt, {s.numbers('text')} AS qn, {s.entities('text')} AS qe,
    regexp_matches(lower(text), '\\b(?:when|date|year|month|day|time)\\b') AS tq FROM benchmark
)"""

HYBRID_SQL = f"""
WITH {MEMORIES_SQL}, c AS (
  SELECT qid, doc_id, tbl, ckey, confidence, strength,
    CASE WHEN len(qt) > 0 AND len(mt) > 0 THEN {s.hits('qt', 'mt')} / sqrt((len(qt) * len(mt))::DOUBLE) ELSE 0.0::DOUBLE END AS lexical,
    CASE WHEN len(qt) > 0 THEN {s.hits('qt', 'mt')}::DOUBLE / len(qt) ELSE 0.0::DOUBLE END AS exact_coverage,
    {s.hits('qt', 'mt', ' AND length(t) >= 5')}::BIGINT AS rare_exact,
    CASE WHEN len(qn) > 0 AND len(mn) > 0 THEN {s.hits('qn', 'mn')}::DOUBLE / len(qn) ELSE 0.0::DOUBLE END AS number,
    CASE WHEN tq THEN sig ELSE 0.0::DOUBLE END AS temporal,
    CASE WHEN len(qe) > 0 AND len(mt) > 0 THEN {s.hits('qe', 'mt')}::DOUBLE / len(qe) ELSE 0.0::DOUBLE END AS entity,
    CASE WHEN len(qt) > 0 AND len(mg) > 0 THEN {s.hits('qt', 'mg')} / sqrt((len(qt) * len(mg))::DOUBLE) ELSE 0.0::DOUBLE END AS tag
  FROM q, m
), scored AS (
  SELECT *, round(0.9::DOUBLE * lexical + 0.75::DOUBLE * exact_coverage + 0.18::DOUBLE * rare_exact + 0.55::DOUBLE * number + 0.25::DOUBLE * temporal + 0.4::DOUBLE * entity + 0.25::DOUBLE * tag + 0.8::DOUBLE * 0
    + CASE WHEN tbl = 'semantic' THEN 0.08::DOUBLE ELSE 0::DOUBLE END + 0.12::DOUBLE * confidence + 0.08::DOUBLE * strength + 0.04::DOUBLE * (tbl = 'semantic')::INT, 6) AS score FROM c
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY qid, ckey ORDER BY score DESC, doc_id) AS f FROM scored WHERE score >= 0.35
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM firsts WHERE f = 1
)
SELECT qid, rank, tbl AS "table", doc_id::VARCHAR AS id, score, round(lexical, 6) AS lexical, round(exact_coverage, 6) AS exact_coverage, rare_exact,
  round(number, 6) AS number, round(temporal, 6) AS temporal, round(entity, 6) AS entity, round(tag, 6) AS tag, 0.0::DOUBLE AS vector
FROM ranked WHERE rank <= 5
"""


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by cosine of every 100th vector, against all."""
    v = read(spark, sf_dir, "embeddings")
    vectors = v.select(F.lit("u").alias("user_id"), F.lit("semantic").alias("table"), F.col("vec_id").alias("id"), "embedding")
    asked = v.filter("vec_id % 100 = 0").select(F.lit("u").alias("user_id"), F.col("vec_id").alias("qid"), F.col("embedding").alias("q_embedding"))
    return vc.vector_top(asked, vectors, 10).select("qid", "id", t.round6(F.col("vector")).alias("vector"), "rank")


VECTOR_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS qid, v.vec_id AS id,
    list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) /
    (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS c
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS rank FROM pairs)
SELECT qid, id, round(c, 6) AS vector, rank FROM ranked WHERE rank <= 10
"""


def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each turn: its role says its text."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.lit("u").alias("user_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.col("role").alias("subject"), F.lit("said").alias("predicate"), F.col("text").alias("value_text"),
        F.when(F.col("turn") % 5 == 0, "temporal_fact").otherwise("statement").alias("fact_type"), (0.5 + F.col("turn") / 20).alias("confidence"),
    )


def rank_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rank_facts(questions(spark, sf_dir), conversation_facts(spark, sf_dir), 5).drop("user_id")


FACTS_SQL = f"""
WITH f AS (
  SELECT conv_id || ':' || turn AS id, conv_id * 1000 + turn AS pos, role, CASE WHEN turn % 5 = 0 THEN 'temporal_fact' ELSE 'statement' END AS fact_type, 0.5::DOUBLE + turn::DOUBLE / 20 AS confidence, text FROM conversations
), m AS (
  SELECT *, {s.tokens("role || ' said  ' || text || ' ' || fact_type || '    '")} AS mt, {s.tokens("'said'")} AS mp, {s.tokens('role')} AS ms FROM f
), q AS (SELECT item_id AS qid, {s.tokens('text')} AS qt FROM benchmark), scored AS (
  SELECT qid, id, pos, round({s.hits('qt', 'mt')}::DOUBLE / len(qt) + CASE WHEN {s.hits('qt', 'mp')} > 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {s.hits('qt', 'ms')} > 0 THEN 0.25::DOUBLE ELSE 0::DOUBLE END
    + 0.1::DOUBLE * confidence + CASE WHEN fact_type = 'temporal_fact' AND len(list_filter(qt, lambda t: t IN ('when', 'date', 'year', 'month', 'time'))) > 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END, 6) AS score
  FROM q, m WHERE len(qt) > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM scored WHERE score >= 0.2)
SELECT qid, rank, id, score FROM ranked WHERE rank <= 5
"""


def rank_indexables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    x = d.select(
        F.lit("u").alias("user_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, "workflow").otherwise("mnemonic").alias("kind"),
        t.recall_key(t.hint("text")).alias("key"), (0.3 + (F.col("doc_id") % 7) / 20).alias("salience"), t.hint("text").alias("reconstructive_hint"), F.array("lang").alias("tags"), F.lit(None).cast("array<string>").alias("steps"),
    )
    return r.rank_indexables(questions(spark, sf_dir), x, 5).drop("user_id")


def _sql_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '')"


INDEXABLES_SQL = rf"""
WITH f AS (
  SELECT *, CASE WHEN regexp_matches(text, '^(.+?[.!?])(?:\s|$)') THEN regexp_extract(text, '^(.+?[.!?])(?:\s|$)', 1) ELSE text END AS statement FROM documents
), h AS (
  SELECT *, CASE WHEN length(statement) <= 160 THEN statement ELSE {s.strip("left(statement, 157)")} || '...' END AS hint FROM f
), x AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'workflow' ELSE 'mnemonic' END AS kind, {_sql_key('hint')} AS key, 0.3::DOUBLE + (doc_id % 7)::DOUBLE / 20 AS salience, hint, lang FROM h
), m AS (SELECT *, {s.tokens("key || ' ' || hint || ' ' || lang || ' '")} AS mt FROM x
), q AS (SELECT item_id AS qid, {_sql_key('text')} AS norm, {s.tokens('text')} AS qt FROM benchmark), scored AS (
  SELECT qid, id, key, round(salience + CASE WHEN key <> '' AND (contains(norm, key) OR contains(key, norm)) THEN 0.55::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN kind = 'workflow' AND regexp_matches(replace(norm, '-', ' '), 'review|workflow|procedure|how do i') THEN 0.1::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN len(qt) > 0 THEN {s.hits('qt', 'mt')}::DOUBLE / len(qt) * 0.35::DOUBLE ELSE 0::DOUBLE END, 6) AS score FROM q, m
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE score >= 0.35)
SELECT qid, rank, id, key, score FROM ranked WHERE rank <= 5
"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts first, then memories, eight in all for each question."""
    q = questions(spark, sf_dir)
    facts = conversation_facts(spark, sf_dir)
    memories = document_memories(spark, sf_dir)
    best_facts = r.rank_facts(q, facts, 3).join(facts.select("user_id", "id", F.col("value_text").alias("content")), ["user_id", "id"])
    best = r.hybrid_rank(q, memories, 8, 0.35).join(memories.select("user_id", "id", "content"), ["user_id", "id"])
    return r.assemble_context(best_facts, best, 8).select("qid", "place", "table", "id", "score")


CONTEXT_SQL = f"""
WITH facts AS (SELECT qid, rank, id, score FROM ({FACTS_SQL.replace('rank <= 5', 'rank <= 3')})), mems AS (SELECT qid, rank, "table", id, score FROM ({HYBRID_SQL.replace('rank <= 5', 'rank <= 8')})),
both_ AS (SELECT qid, rank, 'memory_fact' AS "table", id, score, 0 AS prio FROM facts UNION ALL SELECT qid, rank, "table", id, score, 1 FROM mems),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prio, rank) AS place FROM both_)
SELECT qid, place, "table", id, score FROM placed WHERE place <= 8
"""

def hybrid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid ranking with the cosines of the hundred nearest vectors of
    each question; documents and questions have the vectors of their numbers."""
    v = read(spark, sf_dir, "embeddings")
    memories, asked = document_memories(spark, sf_dir), questions(spark, sf_dir)
    held = memories.join(v.select(F.col("vec_id").cast("string").alias("id"), "embedding"), "id").select("user_id", "table", "id", "embedding")
    near = vc.vector_top(asked.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_embedding")), "qid").select("user_id", "qid", "q_embedding"), held, 100)
    return r.hybrid_rank(asked, memories, top_k=5, min_score=0.35, vectors=near).drop("user_id", "preferred_table")


HYBRID_VECTORS_SQL = HYBRID_SQL.replace(
    "), c AS (",
    """), vp AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, CASE WHEN l.quality = 1 THEN 'semantic' ELSE 'episodic' END AS tbl,
    round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 12) AS vec
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN labels l ON l.doc_id = v.vec_id
), vt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec DESC, tbl, doc_id::VARCHAR) AS vr FROM vp
), c AS (""",
    1,
).replace("0.8::DOUBLE * 0\n", "0.8::DOUBLE * coalesce((SELECT vec FROM vt WHERE vt.qid = c.qid AND vt.doc_id = c.doc_id AND vr <= 100), 0)\n").replace("0.0::DOUBLE AS vector", "round(coalesce((SELECT vec FROM vt WHERE vt.qid = ranked.qid AND vt.doc_id = ranked.doc_id AND vr <= 100), 0), 6) AS vector")

QUERIES = {"rank_hybrid": hybrid_rank, "rank_hybrid_vectors": hybrid_vectors, "rank_vectors": vector_top, "rank_facts": rank_facts, "rank_indexables": rank_indexables, "rank_context": context}
ORACLE_SQL = {"rank_hybrid": HYBRID_SQL, "rank_hybrid_vectors": HYBRID_VECTORS_SQL, "rank_vectors": VECTOR_SQL, "rank_facts": FACTS_SQL, "rank_indexables": INDEXABLES_SQL, "rank_context": CONTEXT_SQL}
