"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share
all words. A source's target is at most ``MOST`` times its size; the excess goes
to the others by weight, which is the level at which the sum of
min(MOST * size, level * weight) is the total.

A source takes floor(target / size) complete epochs first. The fraction left is
filled with documents in order of the key -ln(u) / q, u a hash of seed and
doc_id, q the document's quality weight (the share of letters among its
characters), the rule of Efraimidis and Spirakis for weighted sampling without
replacement; documents are taken while their prefix sum of words is nearer to
the budget with them than without.

No source is gathered or sorted whole: keys fall into ``BUCKETS`` ordered ranges
for each source, sums of ranges are partial aggregates, and only the range in
which a source's budget ends, about a ``BUCKETS``-th of it, is sorted. Whether a
document lies before, behind or within that range follows from its own key and
one row for its source, so ``mixed`` moves no text but those within.

Defined results: a null text has size 0 and quality weight ``FLOOR``; documents
of size 0 are taken with their neighbours and count nothing; a null source is a
source of its own; rows with equal doc_id share a key and are taken by size; an
empty table or one without words gives targets of 0; a text of any length is
taken whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import BLANKS, Scratch, maybe_in

WEIGHTS, MOST, BUCKETS, SEED, FLOOR = (1, 2, 3), 3, 1 << 20, "mix-1", 0.05
SPAN = 1 << 52


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row each."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("ratio", most * F.col("source_size").cast("double") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weights", F.sum("weight").over(whole))
    out = out.withColumn("full", F.sum("source_size").over(by_ratio)).withColumn("used", F.sum("weight").over(by_ratio))
    # the level if this source and those of a smaller ratio were full
    out = out.withColumn("before", (F.col("total") - most * (F.col("full") - F.col("source_size"))) / (F.col("all_weights") - F.col("used") + F.col("weight")).cast("double"))
    out = out.withColumn("level", F.max(F.when(F.col("before") <= F.col("ratio"), F.col("before"))).over(whole))
    bound = (most * F.col("source_size")).cast("double")
    return out.select("source", "source_size", F.coalesce(F.least(bound, F.col("level") * F.col("weight")), bound).alias("target"))


def keyed(docs: DataFrame, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, key, bucket) of every row, and ``row`` if ``docs``
    has it. Buckets rise with keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    size = F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")
    solid = text
    for blank in BLANKS:
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    quality = F.greatest(F.lit(FLOOR), letters / F.greatest(F.lit(1), F.length(solid)).cast("double"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(SPAN))
    more = ["row"] if "row" in docs.columns else []
    out = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), quality.alias("q"), u.alias("u"), *more)
    out = out.select("doc_id", "source", "size", (-F.log("u") / F.col("q")).alias("key"), *more)
    return out.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))).cast("int"))


def _plan(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """One row for each source: s (the source in a struct, so that null joins),
    source_size, target, epochs, budget (words of the fraction), edge (the bucket
    in which the budget ends; those below are taken, those above are not) and
    before (words below it)."""
    sums = scratch.stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("s", F.struct("source"))
    # at most BUCKETS rows of a source, whatever its size
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sums.withColumn("upto", F.sum("words").over(running)).withColumn("s", F.struct("source")).drop("source")
    ends = ranges.join(goals.select("s", "budget"), "s").filter("budget > 0 AND upto > budget").groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    plan = goals.drop("source").join(ends, "s", "left")
    edge = F.coalesce("x.bucket", F.when(F.col("budget") > 0, F.lit((1 << 31) - 1)).otherwise(F.lit(-1)))
    plan = scratch.stage(plan.select("s", "source_size", "target", "epochs", "budget", edge.alias("edge"), F.coalesce("x.before", F.lit(0)).alias("before")), "plan")
    scratch.drop("sums")
    return plan


def _edge(rows: DataFrame) -> DataFrame:
    """``chosen`` of the rows in their source's edge bucket."""
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, budget = F.col("before") + F.sum("size").over(order), F.col("budget")
    return rows.withColumn("chosen", (upto - F.col("size") < budget) & (F.abs(upto - budget) <= F.abs(upto - F.col("size") - budget)))


def mix(docs: DataFrame, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size,
    target, epochs (complete ones), chosen (taken once more), taken."""
    scratch = Scratch(docs.sparkSession, "op6")
    rows = scratch.stage(keyed(docs.select("doc_id", "source", "text"), seed, buckets), "keyed")
    placed = rows.withColumn("s", F.struct("source")).join(_plan(scratch, rows), "s")
    sure = placed.filter("bucket != edge").withColumn("chosen", F.col("bucket") < F.col("edge"))
    out = _edge(placed.filter("bucket = edge")).unionByName(sure)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "chosen", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them. Rows that share doc_id,
    source, size and key take what was taken of them in the order of their texts."""
    scratch = Scratch(docs.sparkSession, "op6")
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = scratch.stage(keyed(docs.select("doc_id", "source", "text"), seed, buckets), "keyed")
    plan = _plan(scratch, rows)
    same = F.struct("doc_id", "source", "size", "key")
    edge = _edge(rows.withColumn("s", F.struct("source")).join(plan, "s").filter("bucket = edge"))
    edge = edge.groupBy(same.alias("same")).agg(F.sort_array(F.collect_list((F.col("epochs") + F.col("chosen").cast("long"))), asc=False).alias("times"))
    edge = scratch.stage(edge, "edge")
    scratch.drop("keyed")
    placed = keyed(whole, seed, buckets).withColumn("s", F.struct("source")).join(plan, "s")
    sure = placed.filter("bucket != edge").select("row", (F.col("epochs") + (F.col("bucket") < F.col("edge")).cast("long")).alias("n"))
    # the few documents within the edge ranges, found by doc_id and then by all of their key
    few = maybe_in(whole, "doc_id", edge.select("same.doc_id"), "doc_id", edge.count())
    near = keyed(few, seed, buckets).select(same.alias("same"), "row")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy("row.text")))
    near = near.join(edge, "same").select("row", F.expr("times[rank - 1]").alias("n"))
    return sure.unionByName(near).filter("n > 0").withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("row.*")


SQL = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), sized AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest({FLOOR}::DOUBLE, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')))::DOUBLE) AS q,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(SPAN)!r}::DOUBLE AS u
  FROM base
), keyed AS (
  SELECT *, -ln(u) / q AS key FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM keyed GROUP BY source
), ratios AS (
  SELECT *, {MOST} * source_size::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights FROM sources
), running AS (
  SELECT *, sum(source_size) OVER w AS full_size, sum(weight) OVER w AS used FROM ratios
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), levels AS (
  SELECT *, (total - {MOST} * (full_size - source_size))::DOUBLE / (all_weights - used + weight)::DOUBLE AS before FROM running
), goals AS (
  SELECT source, source_size, coalesce(least(({MOST} * source_size)::DOUBLE, (SELECT max(before) FROM levels WHERE before <= ratio) * weight), ({MOST} * source_size)::DOUBLE) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals
), prefix AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto <= budget OR (upto - size < budget AND abs(upto - budget) <= abs(upto - size - budget)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM prefix
"""
