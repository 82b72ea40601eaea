"""Dataset curation: first-wins dedupe, exclusion, splits, balancing, sampling.

Every "first" is by an explicit position column, since file order is no
contract. Windows are partitioned by class or key; limits over a whole table are
taken from counts of classes, never by sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as t


def first_by_key(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """The row of least position for each key."""
    w = Window.partitionBy(*key).orderBy(pos)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def record_key(action: Column, kind: Column, source: Column, content: Column, question: Column, turn: Column) -> Column:
    """Key of D3: action, source and the first normalised text that is not empty."""
    texts = [F.nullif(t.content_key(F.coalesce(c, F.lit(""))), F.lit("")) for c in (content, question, turn)]
    empty = F.lit("")
    return F.concat_ws("|", F.coalesce(action, empty), F.coalesce(kind, empty), F.coalesce(source, empty), F.coalesce(*texts, empty))


def canonical_hash(*columns: str) -> Column:
    """sha256 of JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def excluding(df: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not known."""
    return df.join(known.select(*key).distinct(), key, "left_anti")


def source_family_duplicates(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` (user_id, content, source_id) whose normalised content
    ``old`` has from the same source family (chunk numbers aside)."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_norm", F.sha2(t.content_key("content"), 256)).withColumn("_family", t.base_source("source_id"))

    return keyed(new).join(keyed(old).select("user_id", "_norm", "_family").distinct(), ["user_id", "_norm", "_family"], "left_semi").drop("_norm", "_family")


def nth_split(df: DataFrame, pos: str, ratio: float, group: list[str] | None = None) -> DataFrame:
    """Every n-th row by position is validation. ``group`` numbers rows
    within groups, so that no task numbers a whole table."""
    n = max(2, int(1 / ratio + 0.5))
    w = Window.partitionBy(*(group or [])).orderBy(pos)
    return df.withColumn("split", F.when((F.row_number().over(w) - 1) % n == 0, "validation").otherwise("train"))


def hash_split(df: DataFrame, key: str, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """By the first 32 bits of sha256(key); needs no order and no shuffle."""
    u = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def row_id(path: Column, line: Column, raw: Column) -> Column:
    """Raw: and ten digits of sha256(path:line:raw)."""
    return F.concat(F.lit("raw:"), F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), raw), 256), 1, 10))


def _numbered(df: DataFrame, by: str, pos: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(pos)))


def quotas(df: DataFrame, by: str, pos: str, quota: dict[str, int]) -> DataFrame:
    """The first ``quota[class]`` rows of each class."""
    q = F.create_map(*[x for k, n in quota.items() for x in (F.lit(k), F.lit(n))])
    return _numbered(df, by, pos, "_rn").filter(F.col("_rn") <= F.coalesce(F.try_element_at(q, F.col(by)), F.lit(0))).drop("_rn")


def balanced(df: DataFrame, by: str, pos: str, limit: int) -> DataFrame:
    """floor(limit / classes) of each class, the rest filled in order."""
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}  # one row a class
    if sum(sizes.values()) <= limit:
        return df
    base = max(1, limit // len(sizes))
    marked = _numbered(df, by, pos, "_rn").withColumn("_phase", F.when(F.col("_rn") <= base, 0).otherwise(1))
    taken = sum(min(n, base) for n in sizes.values())
    first = marked.filter("_phase = 0")
    if taken >= limit:
        return first.orderBy(by, pos).limit(limit).drop("_rn", "_phase")
    fill = marked.filter("_phase = 1").orderBy(pos).limit(limit - taken)
    return first.unionByName(fill).drop("_rn", "_phase")


def balanced_by_ratio(df: DataFrame, by: str, pos: str, limit: int, ratios: dict[str, float], last: str) -> DataFrame:
    """round(limit * ratio) of each class, then rows that are not ``last``
    in order, then any."""
    total = df.count()
    if total <= limit:
        return df
    want = {k: int(limit * v + 0.5) for k, v in ratios.items()}
    q = F.create_map(*[x for k, n in want.items() for x in (F.lit(k), F.lit(n))])
    marked = _numbered(df, by, pos, "_rn").withColumn("_phase", F.when(F.col("_rn") <= F.coalesce(F.try_element_at(q, F.col(by)), F.lit(0)), 0).when(~F.col(by).eqNullSafe(last), 1).otherwise(2))
    return marked.orderBy("_phase", pos).limit(limit).drop("_rn", "_phase")


def balanced_by_hash(df: DataFrame, by: str, key: str, limit: int, ratios: dict[str, float], salt: str) -> DataFrame:
    """floor(limit * ratio) of each class by FNV-1a of salt and key."""
    marked = df.withColumn("_h", t.fnv1a(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string"))))
    w = Window.partitionBy(by).orderBy("_h", key)
    q = F.create_map(*[x for k, v in ratios.items() for x in (F.lit(k), F.lit(int(limit * v)))])
    return marked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.coalesce(F.try_element_at(q, F.col(by)), F.lit(0))).drop("_rn", "_h")


def hash_pick(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The n rows of least FNV-1a(salt:key)."""
    h = t.fnv1a(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def round_robin(df: DataFrame, bucket: str, pos: str, limit: int) -> DataFrame:
    """One of each bucket in turn, buckets descending."""
    return _numbered(df, bucket, pos, "_rn").orderBy("_rn", F.col(bucket).desc()).limit(limit).drop("_rn")


def even_positions(df: DataFrame, by: str, pos: str, count: int) -> DataFrame:
    """Rows floor(i * n / count) of each class."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    places = sizes.select(by, F.explode(F.when(F.col("_n") <= count, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") / F.lit(float(count))))))).alias("_place"))
    return _numbered(df, by, pos, "_rn").withColumn("_place", (F.col("_rn") - 1).cast("long")).join(places, [by, "_place"], "left_semi").drop("_rn", "_place")


def oversampled(df: DataFrame, copies: Column) -> DataFrame:
    """Each row ``copies`` times, with copy from 1."""
    return df.filter(copies >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


#: Phrases of one or two words that are scanned for at once.
ODD = 10_000


def phrase_holdout(rows: DataFrame, phrases: DataFrame, least: int = 30) -> DataFrame:
    """Rows without any holdout phrase: equal to one, or holding one of
    ``least`` characters or more. ``rows``: norm; ``phrases``: phrase, both
    normalised to single blanks. Texts are known by a digest."""
    rows = rows.withColumn("_k", F.sha2("norm", 256))
    hits = phrase_matches(rows, phrases.filter(F.length("phrase") >= least)).select("_k")
    equal = phrases.select(F.sha2("phrase", 256).alias("_k"))
    return rows.join(hits.unionByName(equal).distinct(), "_k", "left_anti").drop("_k")


def phrase_matches(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(_k, phrase) for each phrase that a text holds. ``rows``: _k, norm;
    ``phrases``: phrase.

    Between blanks a phrase's inner words stand whole wherever it occurs, so those
    of four words or more are looked up by their second and third word, those of
    three by the second; only a text with a candidate meets it. Phrases of one or
    two words need a scan, ``ODD`` at a time."""
    words = phrases.select("phrase").distinct().withColumn("_w", F.split("phrase", " "))
    key = F.when(F.size("_w") >= 4, F.concat_ws(" ", F.get("_w", F.lit(1)), F.get("_w", F.lit(2)))).when(F.size("_w") == 3, F.get("_w", F.lit(1)))
    known = words.select("phrase", key.alias("_g"))
    parts = rows.select("_k", F.split("norm", " ").alias("_p"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.concat_ws(" ", F.get(F.col("_p"), i), F.get(F.col("_p"), i + 1)))
    held = parts.select("_k", F.explode(F.array_distinct(F.concat(pairs, F.col("_p")))).alias("_g"))
    tried = held.join(known.filter("_g IS NOT NULL"), "_g").select("_k", "phrase").distinct()
    hits = rows.select("_k", "norm").join(tried, "_k").filter(F.col("norm").contains(F.col("phrase"))).select("_k", "phrase")
    odd = known.filter("_g IS NULL").select("phrase")
    n = odd.count()
    blocks = -(-n // ODD)
    for b in range(blocks):
        some = odd.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        hits = hits.unionByName(rows.join(F.broadcast(some), F.col("norm").contains(F.col("phrase"))).select("_k", "phrase"))  # about ODD phrases
    return hits


def shingle_overlap(rows: DataFrame, known: DataFrame, n: int = 8, least: int = 2) -> DataFrame:
    """(id, n_shared, equal) of rows that share ``least`` n-word shingles with
    the known texts taken together, or whose words are those of one. Both: id,
    words (array)."""
    def shingles(df: DataFrame) -> DataFrame:
        return df.select("id", F.explode(F.array_distinct(t.word_shingles(F.col("words"), n))).alias("s"))

    def digest() -> Column:
        return F.sha2(F.array_join("words", " "), 256).alias("d")

    counts = shingles(rows).join(shingles(known).select("s").distinct(), "s").groupBy("id").agg(F.count("*").alias("n_shared"))
    equal = rows.select("id", digest()).join(known.select(digest()).distinct(), "d").select("id", F.lit(True).alias("equal"))
    both = counts.join(equal, "id", "full_outer").select("id", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.coalesce("equal", F.lit(False)).alias("equal"))
    return both.filter((F.col("n_shared") >= least) | F.col("equal"))


def neighbours(df: DataFrame, group: list[str], pos: str, column: str, back: int, ahead: int, source: str | None = None) -> DataFrame:
    """``column`` of the rows around each row, in order; with ``source``,
    without those of the row's own source."""
    w = Window.partitionBy(*group).orderBy(pos).rowsBetween(-back, ahead)
    if source is None:
        return df.withColumn("around", F.collect_list(column).over(w))
    near = F.collect_list(F.struct(F.col(source).alias("s"), F.col(column).alias("v"))).over(w)
    return df.withColumn("_near", near).withColumn("around", F.transform(F.filter("_near", lambda x: ~x.s.eqNullSafe(F.col(source))), lambda x: x.v)).drop("_near")


#: What makes a message worth labelling, and its points; a caller adds the
#: words of its own subject.
TOPICS = "retention|decay|checkpoint|validation|dataset|colab|huggingface|duckdb|memory"
POINTS = [
    (r"should|must|need|make sure|quality|best|prefer|full dataset|training", 2),
    (r"failed|wrong|empty|404|not found|disconnect|regression|forgot|miss", 3),
    (r"accuracy|mae|score|cross-eval|results", 2),
    (r"^i('|’)m |^i found |^next i('|’)m ", -3),
]
#: Buckets in the order in which they claim a message, and their shares.
BUCKETS = [
    ("correction", r"failed|wrong|empty|404|not found|disconnect|regression|forgot|miss|failure|error|should not|don't like|do not like|we went wrong"),
    ("rule", r"should|must|need to|make sure|best practice|prefer|always|never|do not|don't|quality|full dataset|today|works well"),
]
MILESTONES = "accuracy|mae|cross-eval|results|training"
NARRATION = r"^i('|â€™)m |^i found |^next i('|â€™)m |run this|use this|checking|inspecting|\[code_block\]"
REPLIES = r"^(okay|ok|yes|no|proceed|thanks|thank you|what'?s going on|whats going on)[.! ]*$"
SHARES = {"correction": 0.22, "rule": 0.28, "milestone": 0.34, "transient": 0.16}


def candidate_points(text: Column, topics: str = TOPICS) -> Column:
    """Points of a message."""
    low = F.lower(text)
    points = F.when(low.rlike(topics), 3).otherwise(0) + F.when(F.length(text) < 30, -2).otherwise(0)
    for pattern, n in POINTS:
        points = points + F.when(low.rlike(pattern), n).otherwise(0)
    return points


def candidate_bucket(text: Column, assistant: Column, topics: str = TOPICS) -> Column:
    """Correction, rule, milestone or transient; null for what is skipped."""
    low = F.lower(text)
    out = F.when(low.rlike(BUCKETS[0][1]), BUCKETS[0][0]).when(low.rlike(BUCKETS[1][1]), BUCKETS[1][0]).when(low.rlike(f"{topics}|{MILESTONES}"), "milestone")
    return out.when(assistant & low.rlike(NARRATION), "transient").when(low.rlike(REPLIES), "transient")


def mined_candidates(messages: DataFrame, count: int, pos: str = "pos", text: str = "text") -> DataFrame:
    """At most ``count`` messages, in order of ``pos`` (unique). ``messages`` has
    ``bucket`` and ``points``. Each bucket gives its share (one at least) of best
    messages; what they leave free goes to the best of the rest, of any bucket; of those
    that begin with the same 160 characters the first stays. Quotas cut before rows
    move, so a bucket may hold any part of the input."""
    best = [F.col("points").desc(), F.col(pos)]
    quota = {k: max(1, int(count * share)) for k, share in SHARES.items()}
    scored = messages.filter(F.col("bucket").isin(*quota))
    sizes = {r.bucket: r.n for r in scored.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    free = max(0, count - sum(min(n, quota[k]) for k, n in sizes.items()))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("bucket"))
    # the best quota + free of a bucket hold all that can be picked of it
    near = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*best))).filter(F.col("_rank") <= max(quota.values()) + free)
    picked = near.filter(F.col("_rank") <= most)
    if free:
        picked = picked.unionByName(near.filter(F.col("_rank") > most).orderBy(*best).limit(free))
    first = Window.partitionBy(F.substring(F.lower(F.col(text)), 1, 160)).orderBy(pos)
    kept = picked.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_rank", "_first")
    return kept.orderBy(pos).limit(count)
