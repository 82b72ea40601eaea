"""Curation and evaluation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as t
from quarrylight.operators import curation as c
from quarrylight.operators import evaluation as e
from quarrylight.plans import sqltext as s
from quarrylight.plans.ranking_queries import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORM = s.strip(r"regexp_replace(lower({0}), '\s+', ' ', 'g')")


def norm(x: str) -> str:
    return rf"regexp_replace(lower({s.strip(x)}), '\s+', ' ', 'g')"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an action: quality and toxic as its two halves."""
    joined = read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return joined.withColumn("action", F.concat(F.when(F.col("quality") == 1, "store").otherwise("ignore"), F.when(F.col("toxic") == 1, "_flag").otherwise("")))


LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, CASE WHEN quality = 1 THEN 'store' ELSE 'ignore' END || CASE WHEN toxic = 1 THEN '_flag' ELSE '' END AS action FROM documents d JOIN labels l USING (doc_id))"


@query(f"SELECT min(doc_id) AS doc_id, lang, source FROM (SELECT *, {norm('text')} AS n FROM documents) GROUP BY lang, source, n")
def dedupe_first_wins(spark, d):
    """D3 over documents: the first of each language, source and text."""
    rows = read(spark, d, "documents").withColumn("key", F.sha2(c.record_key(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")), 256))
    return c.first_by_key(rows.select("key", "doc_id", "lang", "source"), ["key"], "doc_id").select("doc_id", "lang", "source")


@query("SELECT min(doc_id) AS doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS h, count(*) AS n FROM documents GROUP BY lang, source")
def dedupe_canonical_hash(spark, d):
    """Rows by sha256 of sorted-key JSON."""
    return read(spark, d, "documents").withColumn("h", c.canonical_hash("source", "lang")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, left({norm('text')}, 400) AS p, doc_id % 2 = 0 AS known FROM documents),
fresh AS (SELECT doc_id, p FROM k WHERE NOT known AND p NOT IN (SELECT p FROM k WHERE known)) SELECT min(doc_id) AS doc_id FROM fresh GROUP BY p""")
def dedupe_against_known(spark, d):
    """New texts by their first 400 characters, against known ones and each other."""
    rows = read(spark, d, "documents").select("doc_id", F.sha2(F.substring(t.content_key("text"), 1, 400), 256).alias("p"))
    fresh = c.excluding(rows.filter("doc_id % 2 != 0"), rows.filter("doc_id % 2 = 0"), ["p"])
    return c.first_by_key(fresh, ["p"], "doc_id").select("doc_id")


@query(f"""WITH k AS (SELECT doc_id, source, {norm('text')} AS p, source || ':chunk-' || (doc_id % 3) AS sid FROM documents)
SELECT doc_id FROM k a WHERE doc_id % 3 <> 0 AND EXISTS (SELECT 1 FROM k b WHERE b.doc_id % 3 = 0 AND b.p = a.p AND b.source = a.source)""")
def dedupe_source_family(spark, d):
    """Texts already known from the same source family."""
    rows = read(spark, d, "documents").select("doc_id", F.lit("u").alias("user_id"), F.col("text").alias("content"), F.concat("source", F.lit(":chunk-"), (F.col("doc_id") % 3).cast("string")).alias("source_id"))
    return c.source_family_duplicates(rows.filter("doc_id % 3 != 0"), rows.filter("doc_id % 3 = 0")).select("doc_id")


@query("SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_every_nth(spark, d):
    return c.nth_split(read(spark, d, "documents").select("doc_id", "source"), "doc_id", 0.1, ["source"]).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || left(sha256(doc_id::VARCHAR), 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE AS u FROM documents)")
def split_by_hash(spark, d):
    return c.hash_split(read(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, 'raw:' || left(sha256(source || ':' || doc_id || ':' || text), 10) AS row_id FROM documents")
def stable_row_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", c.row_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("row_id"))


@query(f"""WITH {LABELLED}, k AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY doc_id) AS rn, (SELECT count(DISTINCT action) FROM labelled) AS a FROM labelled),
p AS (SELECT *, rn > greatest(1, 120 // a) AS later FROM k), t AS (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN later THEN '' ELSE action END, doc_id) AS o FROM p) SELECT doc_id, action FROM t WHERE o <= 120""")
def balance_equal(spark, d):
    """R16 with a limit of 120 rows."""
    return c.balanced(labelled(spark, d).select("doc_id", "action"), "action", "doc_id", 120)


RATIOS = {"ignore": 0.25, "store": 0.5, "store_flag": 0.1}


@query(f"""WITH {LABELLED}, k AS (SELECT doc_id, action, row_number() OVER (PARTITION BY action ORDER BY doc_id) AS rn FROM labelled),
p AS (SELECT *, CASE WHEN rn <= CASE action WHEN 'ignore' THEN 25 WHEN 'store' THEN 50 WHEN 'store_flag' THEN 10 ELSE 0 END THEN 0 WHEN action <> 'ignore' THEN 1 ELSE 2 END AS ph FROM k)
SELECT doc_id, action FROM (SELECT *, row_number() OVER (ORDER BY ph, doc_id) AS o FROM p) WHERE o <= 100""")
def balance_by_ratio(spark, d):
    """R17 with a limit of 100 rows."""
    return c.balanced_by_ratio(labelled(spark, d).select("doc_id", "action"), "action", "doc_id", 100, RATIOS, "ignore")


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, ch: ((xor(h, ch)) * 16777619) & 4294967295)"


@query(f"""WITH {LABELLED}, k AS (SELECT doc_id, action, {FNV.format("('s:' || doc_id)")} AS h FROM labelled)
SELECT doc_id, action FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY h, doc_id) AS rn FROM k) WHERE rn <= CASE action WHEN 'ignore' THEN 25 WHEN 'store' THEN 50 WHEN 'store_flag' THEN 10 ELSE 0 END""")
def balance_by_hash(spark, d):
    """floor(100 ratio) of each class by FNV-1a."""
    return c.balanced_by_hash(labelled(spark, d).select("doc_id", "action"), "action", "doc_id", 100, RATIOS, "s")


@query("""WITH k AS (SELECT doc_id, least(n_chars // 1000, 6) AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM k)
SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (ORDER BY rn, bucket DESC) AS o FROM r) WHERE o <= 150""")
def sample_round_robin(spark, d):
    """150 rows, one of each length bucket in turn."""
    rows = read(spark, d, "documents").select("doc_id", F.least(F.expr("n_chars div 1000"), F.lit(6)).alias("bucket"))
    return c.round_robin(rows, "bucket", "doc_id", 150)


@query("""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM k WHERE n <= 20 OR p IN (SELECT floor(i * (n / 20.0::DOUBLE))::BIGINT FROM range(20) r(i))""")
def sample_even_positions(spark, d):
    """20 evenly spaced rows of each language."""
    return c.even_positions(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("SELECT doc_id, action, copy FROM (WITH " + LABELLED + " SELECT doc_id, action, unnest(range(1, CASE WHEN action = 'store_flag' THEN 4 WHEN action = 'ignore' THEN 1 ELSE 2 END)) AS copy FROM labelled)")
def oversample(spark, d):
    """Copies by class: three, one or none."""
    copies = F.when(F.col("action") == "store_flag", 3).when(F.col("action") == "ignore", 0).otherwise(1)
    return c.oversampled(labelled(spark, d).select("doc_id", "action"), copies).select("doc_id", "action", F.col("copy").cast("long").alias("copy"))


@query(f"""WITH n AS (SELECT doc_id, {s.squeeze('lower(text)')} AS norm FROM documents), p AS (SELECT DISTINCT {s.squeeze('lower(text)')} AS phrase FROM benchmark)
SELECT doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE norm = phrase OR (length(phrase) >= 30 AND contains(norm, phrase)))""")
def holdout_phrases(spark, d):
    """Documents without any benchmark text."""
    rows = read(spark, d, "documents").select("doc_id", t.squeeze(F.lower("text")).alias("norm"))
    return c.phrase_holdout(rows, read(spark, d, "benchmark").select(t.squeeze(F.lower("text")).alias("phrase"))).select("doc_id")


@query(f"""WITH a AS (SELECT doc_id AS id, string_split({s.squeeze('lower(text)')}, ' ') AS w FROM documents), b AS (SELECT item_id AS id, string_split({s.squeeze('lower(text)')}, ' ') AS w FROM benchmark),
sa AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM a)),
sb AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM b)),
n AS (SELECT sa.id, count(*) AS k FROM sa WHERE s IN (SELECT s FROM sb) GROUP BY id), q AS (SELECT id, w IN (SELECT w FROM b) AS equal FROM a)
SELECT id, coalesce(k, 0) AS n_shared, equal FROM q LEFT JOIN n USING (id) WHERE coalesce(k, 0) >= 2 OR equal""")
def shingle_overlap(spark, d):
    """Documents that share two eight-word runs with the benchmark texts."""
    def words(name, key):
        return read(spark, d, name).select(F.col(key).alias("id"), F.split(t.squeeze(F.lower("text")), " ").alias("words"))

    return c.shingle_overlap(words("documents", "doc_id"), words("benchmark", "item_id"))


@query("""SELECT conv_id, turn, array_to_string(list(role) OVER w, ',') AS around, array_to_string(list_transform(list_filter(list({'s': turn // 2, 'v': role || turn}) OVER w, lambda x: x.s <> turn // 2), lambda x: x.v), ',') AS others
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def turn_neighbours(spark, d):
    """Roles of two turns before and after, and without those of the same
    source, a pair of turns."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.concat("role", "turn").alias("name"), F.expr("turn div 2").alias("source"))
    out = c.neighbours(rows, ["conv_id"], "turn", "role", 2, 2).withColumnRenamed("around", "all")
    out = c.neighbours(out, ["conv_id"], "turn", "name", 2, 2, "source")
    return out.select("conv_id", "turn", F.array_join("all", ",").alias("around"), F.array_join("around", ",").alias("others"))


@query("SELECT lang AS category, count(*) AS questions, avg((quality = 1)::INT::DOUBLE) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, d):
    """A1, A2: accuracy overall and by category."""
    return e.accuracy_report(labelled(spark, d).select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("ok")), "category", "ok")


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS key, count(*) AS n FROM events GROUP BY 1")
def count_by_json_key(spark, d):
    """A3 with the key taken from JSON."""
    return e.count_by(read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")), "k")


@query("""WITH k AS (SELECT doc_id, md5(regexp_replace(lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), '\\s+', ' ', 'g')) AS key FROM documents), g AS (SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1),
r AS (SELECT key, n, doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k JOIN g USING (key))
SELECT key, n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS locations FROM r WHERE rn <= 12 GROUP BY key, n""")
def duplicate_groups(spark, d):
    """Repeated texts and where they are."""
    out = e.duplicate_groups(read(spark, d, "documents"), t.content_key("text"), "doc_id", 1)
    return out.select("key", "n", F.array_join(F.transform("locations", lambda x: x.cast("string")), ",").alias("locations"))


@query(f"""WITH o AS (SELECT lang, array_to_string(list_slice(string_split({s.squeeze('text')}, ' '), 1, 8), ' ') AS opening, count(*) AS n, sum(ceil(length(text) / 4.0))::BIGINT AS tk FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, opening) AS r FROM o)
SELECT lang, sum(n)::BIGINT AS n_rows, sum(tk)::BIGINT AS tokens, count(*) AS openings, sum(CASE WHEN r <= 3 THEN n ELSE 0 END)::DOUBLE / sum(n) AS top3_share, sum(tk)::DOUBLE / sum(n) AS avg_tokens FROM r GROUP BY lang""")
def opening_audit(spark, d):
    """A5 by language, with the first eight words as the opening."""
    opening = t.squeeze(F.regexp_extract("text", r"^\s*\S+(?:\s+\S+){0,7}", 0))
    return e.opening_audit(read(spark, d, "documents"), "lang", opening, F.ceil(F.length("text") / 4).cast("long"))


@query("""WITH k AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(n_chars) AS least, max(n_chars) AS most, max(n_chars) FILTER (p = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(n_chars) FILTER (p = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90,
max(n_chars) FILTER (p = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(n_chars) FILTER (p = least(n - 1, floor(n * 0.99::DOUBLE))) AS p99 FROM k GROUP BY lang""")
def length_percentiles(spark, d):
    """A8 by language."""
    return e.index_percentiles(read(spark, d, "documents").select("lang", "n_chars"), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("""WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY ALL), r AS (SELECT x, sum(CASE WHEN x = y THEN n ELSE 0 END)::DOUBLE / sum(n) AS recall FROM c GROUP BY x), p AS (SELECT y, sum(n) AS p FROM c GROUP BY y)
SELECT (SELECT sum(n) FROM c)::BIGINT AS total, (SELECT sum(CASE WHEN x = y THEN n ELSE 0 END)::DOUBLE / sum(n) FROM c) AS accuracy, (SELECT avg(recall) FROM r) AS macro_accuracy, (SELECT max(p) FROM p)::DOUBLE / (SELECT sum(n) FROM c) AS collapse_fraction""")
def classification_report(spark, d):
    """A12 with toxic as the prediction of quality."""
    return e.classification_report(read(spark, d, "labels"), "quality", "toxic")


@query("SELECT quality, toxic, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY ALL")
def confusion_pairs(spark, d):
    return e.confusion(read(spark, d, "labels"), "quality", "toxic")


EVAL = """ev AS (SELECT doc_id, doc_id % 17 = 0 AS skipped, doc_id % 11 <> 0 AS parse_valid, doc_id % 7 <> 0 AS schema_valid, CASE WHEN quality = 1 THEN 'store' ELSE 'ignore' END AS expected_action, CASE WHEN toxic = 1 THEN 'ignore' ELSE 'store' END AS predicted_action,
lang AS expected_memory_type, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS predicted_memory_type, doc_id % 3 <> 0 AS memory_content_exact, doc_id % 4 AS expected_fact_count, doc_id % 2 AS predicted_fact_count, doc_id % 13 <> 0 AS facts_exact FROM labels JOIN documents USING (doc_id))"""


def evaluated(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.selectExpr(
        "doc_id", "doc_id % 17 = 0 AS skipped", "doc_id % 11 != 0 AS parse_valid", "doc_id % 7 != 0 AS schema_valid", "CASE WHEN quality = 1 THEN 'store' ELSE 'ignore' END AS expected_action", "CASE WHEN toxic = 1 THEN 'ignore' ELSE 'store' END AS predicted_action",
        "lang AS expected_memory_type", "CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS predicted_memory_type", "doc_id % 3 != 0 AS memory_content_exact", "doc_id % 4 AS expected_fact_count", "doc_id % 2 AS predicted_fact_count", "doc_id % 13 != 0 AS facts_exact",
    )


@query(f"""WITH {EVAL} SELECT CASE WHEN skipped THEN 'context_overflow' WHEN NOT parse_valid THEN 'parse_fail' WHEN NOT schema_valid THEN 'schema_fail' WHEN predicted_action <> expected_action THEN 'wrong_action' WHEN predicted_memory_type <> expected_memory_type THEN 'wrong_memory_type'
WHEN NOT memory_content_exact THEN 'wrong_memory_content' WHEN predicted_fact_count <> expected_fact_count THEN 'wrong_fact_count' WHEN NOT facts_exact THEN 'wrong_facts' ELSE 'pass' END AS bucket, count(*) AS n FROM ev GROUP BY 1""")
def row_buckets(spark, d):
    """E5."""
    return evaluated(spark, d).groupBy(e.row_bucket().alias("bucket")).agg(F.count("*").alias("n"))


METRICS = """SELECT count(*) AS total, avg(parse_valid::INT::DOUBLE) AS parse_valid_rate, avg(schema_valid::INT::DOUBLE) AS schema_valid_rate, avg((predicted_action = expected_action)::INT::DOUBLE) AS action_accuracy, avg((predicted_memory_type = expected_memory_type)::INT::DOUBLE) AS memory_type_accuracy,
avg(memory_content_exact::INT::DOUBLE) AS memory_content_exact_rate, avg((predicted_fact_count = expected_fact_count)::INT::DOUBLE) AS fact_count_accuracy, avg(facts_exact::INT::DOUBLE) AS facts_exact_rate FROM ev"""


@query(f"WITH {EVAL} {METRICS}")
def decision_metrics(spark, d):
    """E6."""
    return e.decision_metrics(evaluated(spark, d))


@query(f"""WITH {EVAL}, m AS ({METRICS}), u AS (SELECT unnest(['parse_valid_rate','schema_valid_rate','action_accuracy','memory_type_accuracy','memory_content_exact_rate','fact_count_accuracy','facts_exact_rate']) AS metric,
unnest([parse_valid_rate, schema_valid_rate, action_accuracy, memory_type_accuracy, memory_content_exact_rate, fact_count_accuracy, facts_exact_rate]) AS actual, unnest([0.95::DOUBLE, 0.95, 0.85, 0.7, 0.5, 0.7, 0.5]) AS required FROM m) SELECT *, actual >= required AS passed FROM u""")
def gate_thresholds(spark, d):
    """E9, expanded mode."""
    return e.gate(e.decision_metrics(evaluated(spark, d)), "expanded")


@query(f"""WITH {EVAL} SELECT doc_id, round(parse_valid::INT * 0.25::DOUBLE + (predicted_action = expected_action)::INT * 0.2::DOUBLE + schema_valid::INT * 0.15::DOUBLE + memory_content_exact::INT * 0.2::DOUBLE + facts_exact::INT * 0.1::DOUBLE + (NOT skipped)::INT * 0.1::DOUBLE, 4) AS reward FROM ev""")
def storage_reward(spark, d):
    """E10."""
    rows = evaluated(spark, d).selectExpr("doc_id", "parse_valid", "predicted_action = expected_action AS action_match", "schema_valid AS store_match", "memory_content_exact AS content_grounded", "facts_exact AS no_bleed", "NOT skipped AS complete_json")
    return rows.select("doc_id", e.storage_reward().alias("reward"))


@query("""WITH x AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS target FROM events) SELECT round(avg(abs(value - target)) FILTER (event_type = 'click'), 6) AS mae_click, round(avg(abs(value - target)), 6) AS mae_all FROM x""")
def score_errors(spark, d):
    """Error of each value against the one before it of its type."""
    from pyspark.sql import Window

    x = read(spark, d, "events").withColumn("target", F.lag("value").over(Window.partitionBy("event_type").orderBy("event_id")))
    x = x.withColumns({"v": F.when(F.col("event_type") == "click", F.col("value")), "w": F.col("value")})
    out = e.mean_absolute_errors(x, {"click": ("v", "target"), "all": ("w", "target")})
    return out.select(*[t.round6(F.col(x)).alias(x) for x in ("mae_click", "mae_all")])


@query(f"""WITH k AS (SELECT floor((doc_id * 37 % 101) + 1e-9)::INT AS cent, quality = 1 AS y FROM labels), m AS (SELECT i::INT AS mark FROM range(5, 96) r(i))
SELECT mark, avg(((cent >= mark) = y)::INT::DOUBLE) AS accuracy FROM k, m GROUP BY mark""")
def threshold_sweep(spark, d):
    """Accuracy at 91 thresholds."""
    return e.threshold_sweep(read(spark, d, "labels").select(((F.col("doc_id") * 37 % 101) / 100).alias("p"), (F.col("quality") == 1).alias("y")), "p", "y")


@query("SELECT sum((q AND p)::INT)::BIGINT AS tp, sum((q AND NOT p)::INT)::BIGINT AS fn, sum((NOT q AND p)::INT)::BIGINT AS fp, sum((NOT q AND NOT p)::INT)::BIGINT AS tn, round(avg((q = p)::INT::DOUBLE), 4) AS accuracy FROM (SELECT quality = 1 AS q, toxic = 0 AS p FROM labels)")
def storage_gate_confusion(spark, d):
    """A25."""
    return e.gate_confusion(read(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("""WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) SELECT event_id, best IS NULL OR value > best AS is_best FROM b""")
def best_so_far(spark, d):
    """Events that beat all earlier ones of their user."""
    return e.best_so_far(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", ["value"]).select("event_id", "is_best")


QUERIES, ORACLE_SQL = Q, SQL
