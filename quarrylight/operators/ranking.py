"""Hybrid ranking of memories for queries, and the rankings beside it.

The overlap terms are computed in token-inverted form: distinct tokens of each
memory are exploded once and equi-joined with query tokens that carry their
multiplicity, so work follows the tokens in common and not all pairs. A pair
without any token, number, entity or vector in common still has a base score;
such pairs are added only where the base can reach the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as t

PREFIX_TOKENS = 28
KEY_PREFIX = 8


def memory_features(memories: DataFrame) -> DataFrame:
    """One row for each memory with token arrays and base terms. ``memories``:
    user_id, table, id, pos, content, tags and the optional text columns."""
    names = set(memories.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in names else F.lit("")

    tags = F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " ") if "tags" in names else F.lit("")
    out = memories.withColumn("tag_text", tags)
    searchable = F.concat_ws(" ", text("content"), F.col("tag_text"), *[text(c) for c in ("source_kind", "source_id", "source_label", "temporal_expression", "resolved_time", "source_timestamp")])
    out = out.withColumn("searchable", searchable)
    number = F.lit(0.5)
    return out.select(
        "user_id", "table", "id", "pos", "content",
        t.tokens("searchable").alias("m_tokens"),
        t.numbers("searchable").alias("m_numbers"),
        t.tokens("tag_text").alias("m_tags"),
        t.temporal_signal("searchable").alias("m_temporal"),
        F.coalesce(F.col("confidence").cast("double"), number).alias("confidence") if "confidence" in names else number.alias("confidence"),
        F.coalesce(F.col("strength").cast("double"), number).alias("strength") if "strength" in names else number.alias("strength"),
        F.array_join(F.slice(t.tokens("content"), 1, PREFIX_TOKENS), " ").alias("content_key"),
    )


def query_features(queries: DataFrame) -> DataFrame:
    """``queries``: user_id, qid, query, and optionally preferred (array of tables)."""
    preferred = F.col("preferred") if "preferred" in queries.columns else F.array().cast("array<string>")
    return queries.select(
        "user_id", "qid",
        t.tokens("query").alias("q_tokens"), t.numbers("query").alias("q_numbers"), t.entity_tokens("query").alias("q_entities"),
        t.temporal_question("query").alias("q_temporal"), preferred.alias("preferred"),
    )


def deduped(memories: DataFrame) -> DataFrame:
    """First row of each (user, table, id) by position."""
    w = Window.partitionBy("user_id", "table", "id").orderBy("pos")
    return memories.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _counted(queries: DataFrame, column: str, kind: str) -> DataFrame:
    """(user_id, qid, kind, key, times, rare) of a query's list, with multiplicity."""
    return queries.select("user_id", "qid", F.lit(kind).alias("kind"), F.explode(column).alias("key")).groupBy("user_id", "qid", "kind", "key").agg(F.count("*").alias("times"))


def overlaps(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(user_id, qid, table, id) with overlap counts of every pair that shares
    a token, number, entity or tag token."""
    wanted = _counted(queries, "q_tokens", "token").unionByName(_counted(queries, "q_numbers", "number")).unionByName(_counted(queries, "q_entities", "entity")).unionByName(_counted(queries, "q_tokens", "tag"))
    entry = F.concat(_entries("token", "m_tokens"), _entries("entity", "m_tokens"), _entries("number", "m_numbers"), _entries("tag", "m_tags"))
    held = memories.select("user_id", "table", "id", F.explode(entry).alias("e")).select("user_id", "table", "id", "e.kind", "e.key")

    def total(kind: str, when: Column | None = None) -> Column:
        hit = (F.col("kind") == kind) if when is None else (F.col("kind") == kind) & when
        return F.sum(F.when(hit, F.col("times")).otherwise(0))

    return held.join(wanted, ["user_id", "kind", "key"]).groupBy("user_id", "qid", "table", "id").agg(
        total("token").alias("n_token"), total("token", F.length("key") >= 5).alias("n_rare"), total("number").alias("n_number"), total("entity").alias("n_entity"), total("tag").alias("n_tag")
    )


def _entries(kind: str, column: str) -> Column:
    """(kind, key) of each distinct token of an array."""
    return F.transform(F.array_distinct(column), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))


def _share(n: str, a: Column, b: Column | None = None) -> Column:
    """n / a, or n / sqrt(a b); 0 where a list is empty."""
    if b is None:
        return F.when(a > 0, F.col(n) / a).otherwise(0.0)
    return F.when((a > 0) & (b > 0), F.col(n) / F.sqrt(a * b)).otherwise(0.0)


def hybrid_rank(queries: DataFrame, memories: DataFrame, top_k: int = 5, min_score: float = 0.35, vectors: DataFrame | None = None) -> DataFrame:
    """The best ``top_k`` memories of each query: qid, rank, table, id, score and
    the components (R1, R6, R7, R8). ``vectors``: (user_id, qid, table, id, vector)."""
    q, m = query_features(queries), memory_features(deduped(memories))
    keys = ["user_id", "qid", "table", "id"]
    pairs = overlaps(q, m)
    if vectors is not None:
        pairs = pairs.join(vectors.select(*keys, "vector"), keys, "full_outer")
    else:
        pairs = pairs.withColumn("vector", F.lit(0.0))
    # pairs with nothing in common whose base score reaches the threshold
    light = m.select("user_id", "table", "id", (0.12 * F.col("confidence") + 0.08 * F.col("strength") + F.when(F.col("table") == "semantic", 0.04).otherwise(0.0)).alias("base"), "m_temporal")
    bare = light.filter(F.col("base") + 0.08 + 0.25 * F.col("m_temporal") >= min_score - 1e-6)
    bare = bare.join(q.select("user_id", "qid", "q_temporal", "preferred"), "user_id").filter(F.col("base") + F.when(F.array_contains("preferred", F.col("table")), 0.08).otherwise(0.0) + F.when(F.col("q_temporal"), 0.25 * F.col("m_temporal")).otherwise(0.0) >= min_score - 1e-6)
    pairs = pairs.join(bare.select(*keys), keys, "full_outer").na.fill(0)
    wide = pairs.join(q.select("user_id", "qid", F.size("q_tokens").alias("nq"), F.size("q_numbers").alias("nqn"), F.size("q_entities").alias("nqe"), "q_temporal", "preferred"), ["user_id", "qid"])
    wide = wide.join(m.select("user_id", "table", "id", "pos", F.size("m_tokens").alias("nm"), F.size("m_numbers").alias("nmn"), F.size("m_tags").alias("nmt"), "m_temporal", "confidence", "strength", "content_key"), ["user_id", "table", "id"])
    c = F.col
    wide = wide.withColumn("lexical", _share("n_token", c("nq"), c("nm"))).withColumn("exact_coverage", _share("n_token", c("nq"))).withColumn("rare_exact", c("n_rare").cast("long"))
    wide = wide.withColumn("number", F.when(c("nmn") > 0, _share("n_number", c("nqn"))).otherwise(0.0)).withColumn("temporal", F.when(c("q_temporal"), c("m_temporal")).otherwise(0.0))
    wide = wide.withColumn("entity", F.when(c("nm") > 0, _share("n_entity", c("nqe"))).otherwise(0.0)).withColumn("tag", _share("n_tag", c("nq"), c("nmt")))
    wide = wide.withColumn("preferred_table", F.array_contains("preferred", c("table")))
    score = (
        0.9 * c("lexical") + 0.75 * c("exact_coverage") + 0.18 * c("rare_exact") + 0.55 * c("number") + 0.25 * c("temporal") + 0.4 * c("entity") + 0.25 * c("tag") + 0.8 * c("vector")
        + F.when(c("preferred_table"), 0.08).otherwise(0.0) + 0.12 * c("confidence") + 0.08 * c("strength") + 0.04 * (c("table") == "semantic").cast("int")
    )
    wide = wide.withColumn("score", t.round6(score)).filter(c("score") >= min_score)
    return top_distinct(wide, ["user_id", "qid"], "content_key", top_k).select("user_id", "qid", "rank", "table", "id", "score", *[t.round6(c(x)).alias(x) for x in ("lexical", "exact_coverage")], "rare_exact", *[t.round6(c(x)).alias(x) for x in ("number", "temporal", "entity", "tag", "vector")], "preferred_table")


def top_distinct(scored: DataFrame, group: list[str], key: str, k: int) -> DataFrame:
    """Best row of each ``key`` in a group, then the best ``k``, ties by position."""
    order = [F.col("score").desc(), F.col("pos")]
    first = scored.withColumn("_first", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).filter("_first = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def _hits(q: str, m: Column) -> Column:
    return F.size(F.filter(F.col(q), lambda x: F.array_contains(m, x)))


def rank_facts(queries: DataFrame, facts: DataFrame, top_k: int = 5, min_score: float = 0.2) -> DataFrame:
    """Coverage and hits on predicate and subject, by an equi-join on tokens.
    A fact has one row for each (user_id, id). ``facts``: user_id, id,
    pos, subject, predicate, value_text and optional object, fact_type,
    evidence_text, temporal_expression, resolved_time, source_id, confidence."""
    names = set(facts.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in names else F.lit("")

    f = facts.select(
        "user_id", "id", "pos",
        t.tokens(F.concat_ws(" ", *[text(c) for c in ("subject", "predicate", "object", "value_text", "fact_type", "evidence_text", "temporal_expression", "resolved_time", "source_id")])).alias("f_tokens"),
        t.tokens(text("predicate")).alias("f_predicate"), t.tokens(text("subject")).alias("f_subject"),
        (text("fact_type") == "temporal_fact").alias("f_temporal"),
        (F.coalesce(F.col("confidence").cast("double"), F.lit(0.75)) if "confidence" in names else F.lit(0.75)).alias("f_confidence"),
    )
    f = f.withColumn("f_base", t.round6(0.1 * F.col("f_confidence"))).withColumn("f_late", t.round6(0.1 * F.col("f_confidence") + F.when(F.col("f_temporal"), 0.4).otherwise(0.0)))
    q = queries.select("user_id", "qid", t.tokens("query").alias("q_tokens")).filter(F.size("q_tokens") > 0)
    q = q.withColumn("q_time", F.exists("q_tokens", lambda x: x.isin("when", "date", "year", "month", "time")))
    kinds = {"token": "f_tokens", "predicate": "f_predicate", "subject": "f_subject"}
    entry = F.concat(*[_entries(k, c) for k, c in kinds.items()])
    held = f.select("user_id", "id", F.explode(entry).alias("e")).select("user_id", "id", "e.kind", "e.key")
    wanted = _counted(q, "q_tokens", "token").drop("kind")
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("times")).otherwise(0))
    pairs = held.join(wanted, ["user_id", "key"]).groupBy("user_id", "qid", "id").agg(*[total(k).alias(f"n_{k}") for k in kinds])
    # without a word in common a fact scores its base, so the top_k best bases of
    # a user stand for all: what they have in common can only raise them
    best = lambda c: f.filter(F.col(c) >= min_score).withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col(c).desc(), "pos"))).filter(F.col("_r") <= top_k)
    bare = best("f_base").select("user_id", "id", F.lit(False).alias("q_time")).unionByName(best("f_late").select("user_id", "id", F.lit(True).alias("q_time")))
    bare = q.select("user_id", "qid", "q_time").join(bare, ["user_id", "q_time"]).select("user_id", "qid", "id")
    pairs = pairs.join(bare, ["user_id", "qid", "id"], "full_outer").na.fill(0)
    pairs = pairs.join(q.select("user_id", "qid", F.size("q_tokens").alias("nq"), "q_time"), ["user_id", "qid"]).join(f.select("user_id", "id", "pos", "f_confidence", "f_temporal"), ["user_id", "id"])
    score = (
        F.col("n_token") / F.col("nq") + F.when(F.col("n_predicate") > 0, 0.3).otherwise(0.0) + F.when(F.col("n_subject") > 0, 0.25).otherwise(0.0)
        + 0.1 * F.col("f_confidence") + F.when(F.col("q_time") & F.col("f_temporal"), 0.4).otherwise(0.0)
    )
    pairs = pairs.withColumn("score", t.round6(score)).filter(F.col("score") >= min_score)
    order = Window.partitionBy("user_id", "qid").orderBy(F.col("score").desc(), "pos")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("user_id", "qid", "rank", "id", "score")


def _substrings(x: Column, length: Column) -> Column:
    return F.when(F.length(x) >= length, F.transform(F.sequence(F.lit(1), F.length(x) - length + 1), lambda i: F.substring(x, i, length))).otherwise(F.array().cast("array<string>"))


def rank_indexables(queries: DataFrame, indexables: DataFrame, top_k: int = 5, min_score: float = 0.35) -> DataFrame:
    """Salience, key match, workflow intent and token overlap. ``indexables``:
    user_id, id, pos, kind, key, salience, reconstructive_hint, tags, steps.

    Only pairs with something in common are made, by one equi-join: on tokens; on the
    first ``KEY_PREFIX`` characters of a key, which a question that holds the key has
    too; and on questions as whole, where a key may hold one with which it shares no
    token. Of the others the best ``top_k`` of a user stand for all."""
    empty = F.array().cast("array<string>")
    words = F.concat_ws(" ", F.col("key"), F.coalesce("reconstructive_hint", F.lit("")), F.array_join(F.coalesce("tags", empty), " "), F.array_join(F.coalesce("steps", empty), " "))
    x = indexables.select("user_id", "id", "pos", "kind", F.lower("key").alias("key"), F.coalesce(F.col("salience").cast("double"), F.lit(0.5)).alias("salience"), words.alias("words"))
    # equal questions of one qid are ranked once and counted
    q = queries.groupBy("user_id", "qid", "query").agg(F.count("*").alias("copies"))
    q = q.select("user_id", "qid", "copies", F.xxhash64("qid", "query").alias("ask"), t.recall_key("query").alias("norm"), t.tokens("query").alias("q_tokens"))
    q = q.withColumn("intends", F.coalesce(F.regexp_replace("norm", "-", " ").rlike("review|workflow|procedure|how do i"), F.lit(False)))
    norm, size = F.col("norm"), F.lit(KEY_PREFIX)
    tokens = q.select("user_id", "ask", F.explode("q_tokens").alias("entry")).groupBy("user_id", "ask", F.concat(F.lit("t"), "entry").alias("entry")).agg(F.count("*").alias("times"))
    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda n: _substrings(norm, n))))
    starts = q.select("user_id", "ask", F.explode(starts).alias("entry")).select("user_id", "ask", F.concat(F.lit("k"), "entry").alias("entry"), F.lit(0).cast("long").alias("times"))
    # a key that holds a question has its inner words whole, so it shares their tokens
    inner = F.regexp_extract(norm, "^[^-]+-(.+)-[^-]+$", 1)
    bare_words = q.filter((norm != "") & (F.size(t.tokens(inner)) == 0))
    whole = bare_words.select("user_id", "ask", F.concat(F.lit("w"), norm).alias("entry"), F.lit(0).cast("long").alias("times"))
    lengths = bare_words.agg(F.collect_set(F.length(norm)).alias("lengths"))

    key = F.col("key")
    held = F.concat(
        F.transform(F.array_distinct(t.tokens("words")), lambda w: F.concat(F.lit("t"), w)), F.when(key != "", F.array(F.concat(F.lit("k"), F.substring(key, F.lit(1), size)))).otherwise(empty),
        F.coalesce(F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(_substrings(key, n), lambda w: F.concat(F.lit("w"), w))))), empty),
    )
    own = ["user_id", "id", "pos", "kind", "key", "salience"]
    entries = x.crossJoin(F.broadcast(lengths)).withColumn("row", F.monotonically_increasing_id()).select("row", *own, F.explode(held).alias("entry"))
    pairs = entries.join(tokens.unionByName(starts).unionByName(whole), ["user_id", "entry"]).groupBy("row", *own, "ask").agg(F.sum("times").alias("hits")).drop("row")
    asked = q.select("user_id", "ask", "qid", "copies", "norm", "intends", F.size("q_tokens").alias("nq"))
    match = F.coalesce((key != "") & (norm.contains(key) | key.contains(norm)), F.lit(False))
    common = (F.col("hits") > 0) | match
    pairs = pairs.join(asked, ["user_id", "ask"]).filter(common)
    # a question in which nothing is left is in every key
    bonus = F.when(F.col("flavour") == "intent", F.when(F.col("kind") == "workflow", 0.1).otherwise(0.0)).when(F.col("flavour") == "blank", F.when(key != "", 0.55).otherwise(0.0)).otherwise(0.0)
    base = x.withColumn("flavour", F.explode(F.array(F.lit("plain"), F.lit("intent"), F.lit("blank")))).withColumn("base", t.round6(F.col("salience") + bonus)).filter(F.col("base") >= min_score)
    order = Window.partitionBy("user_id", "flavour").orderBy(F.col("base").desc(), "pos")
    best = base.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k).select(*own, "flavour", t.tokens("words").alias("hay"))
    flavour = F.when(norm == "", "blank").when(F.col("intends"), "intent").otherwise("plain")
    bare = best.join(q.withColumn("flavour", flavour).withColumn("nq", F.size("q_tokens")), ["user_id", "flavour"]).withColumn("hits", _hits("q_tokens", F.col("hay")).cast("long"))
    bare = bare.filter((F.col("flavour") == "blank") | ~common)

    share = F.when(F.col("nq") > 0, F.col("hits") / F.col("nq") * 0.35).otherwise(0.0)
    score = F.col("salience") + F.when(match, 0.55).otherwise(0.0) + F.when((F.col("kind") == "workflow") & F.col("intends"), 0.1).otherwise(0.0) + share
    scored = pairs.select(*own, "qid", "copies", "norm", "intends", "hits", "nq").unionByName(bare.select(*own, "qid", "copies", "norm", "intends", "hits", "nq"))
    scored = scored.select("user_id", "qid", "id", "pos", "key", t.round6(score).alias("score"), "copies").filter(F.col("score") >= min_score)
    scored = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = Window.partitionBy("user_id", "qid").orderBy(F.col("score").desc(), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("user_id", "qid", "rank", "id", "key", "score")


def assemble_context(facts: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """Facts first, up to k, then memories up to what is left. Both:
    user_id, qid, rank, id, content, score."""
    columns = ["user_id", "qid", "rank", "id", "content", "score"]
    both = facts.select(*columns, F.lit(0).alias("prio"), F.lit("memory_fact").alias("table")).unionByName(memories.select(*columns, F.lit(1).alias("prio"), F.col("table")))
    both = both.filter(F.trim("content") != "")
    order = Window.partitionBy("user_id", "qid").orderBy("prio", "rank")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("user_id", "qid", "place", "table", "id", "content", "score")


def merged_candidates(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Lexical before vector candidates, one row for each (user, qid, table, id)."""
    both = lexical.withColumn("src_rank", F.lit(0)).unionByName(vector.withColumn("src_rank", F.lit(1)))
    w = Window.partitionBy("user_id", "qid", "table", "id").orderBy("src_rank", "pos")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
