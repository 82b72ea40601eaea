"""Metrics, audits and gates as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import word

#: Thresholds of the gate modes.
GATES = {
    "direct": {"parse_valid_rate": 1.0, "schema_valid_rate": 1.0, "action_accuracy": 1.0, "memory_type_accuracy": 1.0, "memory_content_exact_rate": 1.0, "fact_count_accuracy": 1.0, "facts_exact_rate": 1.0},
    "expanded": {"parse_valid_rate": 0.95, "schema_valid_rate": 0.95, "action_accuracy": 0.85, "memory_type_accuracy": 0.70, "memory_content_exact_rate": 0.50, "fact_count_accuracy": 0.70, "facts_exact_rate": 0.50},
    "recall": {"parse_valid_rate": 0.95, "schema_valid_rate": 0.95, "target_tables_exact_rate": 0.90, "target_tables_primary_rate": 0.95, "ranking_hints_score": 0.50, "top_k_exact_rate": 0.90},
}
#: Weights of the storage reward.
REWARD = {"parse_valid": 0.25, "action_match": 0.20, "store_match": 0.15, "content_grounded": 0.20, "no_bleed": 0.10, "complete_json": 0.10}


def hit_at(evidence: Column, selected: Column, k: int) -> Column:
    """Whether any evidence is among the first k selected."""
    return F.arrays_overlap(evidence, F.slice(selected, 1, k))


def rate(hit: Column, among: Column | None = None) -> Column:
    """Mean of a flag, 0 over nothing."""
    x = hit.cast("double") if among is None else F.when(among, hit.cast("double"))
    return F.coalesce(F.avg(x), F.lit(0.0))


def accuracy_report(df: DataFrame, category: str, correct: str) -> DataFrame:
    """A2: questions and accuracy overall (category null) and for each category."""
    return df.rollup(category).agg(F.count("*").alias("questions"), rate(F.col(correct)).alias("accuracy"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """A3: rows by key, null as unknown."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, norm: Column, location: str, more_than: int = 3, shown: int = 12) -> DataFrame:
    """Texts that occur more often than ``more_than``, with their first locations."""
    keyed = df.select(F.md5(norm).alias("key"), location)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    w = Window.partitionBy("key").orderBy(location)
    first = keyed.join(counts, "key").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    return first.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(location)).alias("locations"))


def opening_audit(df: DataFrame, by: str, opening: Column, tokens: Column) -> DataFrame:
    """A5: rows, tokens, distinct openings and the share of the three most frequent."""
    counts = df.select(by, opening.alias("opening"), tokens.alias("tokens")).groupBy(by, "opening").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), "opening")
    ranked = counts.withColumn("r", F.row_number().over(w))
    return ranked.groupBy(by).agg(
        F.sum("n").alias("n_rows"), F.sum("tokens").alias("tokens"), F.count("*").alias("openings"), (F.sum(F.when(F.col("r") <= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("top3_share")
    ).withColumn("avg_tokens", F.col("tokens") / F.col("n_rows"))


def index_percentiles(df: DataFrame, by: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """Element min(n - 1, int(n r)) of the sorted values, from value counts, so
    no list of values is collected."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    picked = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(r))), F.col(value))).alias(name) for name, r in ratios.items()]
    return run.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *picked)


def classification_report(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Accuracy, mean of class recalls, and the largest predicted share."""
    cells = df.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    recall = cells.groupBy(expected).agg((F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
    share = cells.groupBy(predicted).agg(F.sum("n").alias("p"))
    total = cells.agg(F.sum("n").alias("total"), (F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return total.join(F.broadcast(recall.agg(F.avg("recall").alias("macro_accuracy")))).join(F.broadcast(share.agg(F.max("p").alias("most")))).select("total", "accuracy", "macro_accuracy", (F.col("most") / F.col("total")).alias("collapse_fraction"))  # one row each


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts of wrong pairs."""
    return df.filter(F.col(expected) != F.col(predicted)).groupBy(expected, predicted).agg(F.count("*").alias("n"))


def mean_absolute_errors(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Error of each component and over all, rows with a target only."""
    parts = {n: F.avg(F.abs(F.col(a) - F.col(b))) for n, (a, b) in pairs.items()}
    total = sum((F.coalesce(F.sum(F.abs(F.col(a) - F.col(b))), F.lit(0.0)) for a, b in pairs.values()), F.lit(0.0))
    n = sum((F.count(F.abs(F.col(a) - F.col(b))) for a, b in pairs.values()), F.lit(0))
    return df.agg(*[v.alias(f"mae_{k}") for k, v in parts.items()], F.when(n > 0, total / n).otherwise(0.0).alias("mae"))


def row_bucket(c: type = None) -> Column:
    """E5: the first thing wrong with an evaluated row, or pass."""
    no = lambda n: ~F.coalesce(F.col(n), F.lit(False))
    return (
        F.when(F.coalesce(F.col("skipped"), F.lit(False)), "context_overflow").when(no("parse_valid"), "parse_fail").when(no("schema_valid"), "schema_fail")
        .when(~F.col("predicted_action").eqNullSafe(F.col("expected_action")), "wrong_action").when(~F.col("predicted_memory_type").eqNullSafe(F.col("expected_memory_type")), "wrong_memory_type")
        .when(no("memory_content_exact"), "wrong_memory_content").when(~F.col("predicted_fact_count").eqNullSafe(F.col("expected_fact_count")), "wrong_fact_count").when(no("facts_exact"), "wrong_facts").otherwise("pass")
    )


def decision_metrics(df: DataFrame) -> DataFrame:
    """Rates over all rows, skipped ones as failures."""
    hit = lambda c: rate(F.coalesce(c, F.lit(False)))
    return df.agg(
        F.count("*").alias("total"), hit(F.col("parse_valid")).alias("parse_valid_rate"), hit(F.col("schema_valid")).alias("schema_valid_rate"), hit(F.col("predicted_action") == F.col("expected_action")).alias("action_accuracy"),
        hit(F.col("predicted_memory_type") == F.col("expected_memory_type")).alias("memory_type_accuracy"), hit(F.col("memory_content_exact")).alias("memory_content_exact_rate"),
        hit(F.col("predicted_fact_count") == F.col("expected_fact_count")).alias("fact_count_accuracy"), hit(F.col("facts_exact")).alias("facts_exact_rate"),
    )


def gate(metrics: DataFrame, mode: str) -> DataFrame:
    """(metric, actual, required, passed) of one row of metrics; a missing
    metric counts 0."""
    want = GATES[mode]
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), (F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k in metrics.columns else F.lit(0.0)).alias("actual"), F.lit(v).alias("required")) for k, v in want.items()])
    return metrics.select(F.explode(rows).alias("x")).select("x.metric", "x.actual", "x.required", (F.col("x.actual") >= F.col("x.required")).alias("passed"))


#: Words that tell why an answer is wrong, in the order in which they are
#: looked for, with where; the first three come before what is known of the retrieval.
WHY_WRONG = [
    ("image_context_missing", "all", "image|photo|picture|caption|shown|seen"),
    ("ambiguous_relative_date", "all", word("yesterday|today|tomorrow|last|next")),
    ("speaker_confusion", "question", word("speaker|he|she|they|her|his|their")),
    ("judge_error", "judge", "judge|evaluation|gold"),
]
NO_ANSWER = "i do not know|unknown|not enough|cannot determine"


def failure_bucket(correct: Column, question: Column, gold: Column, answer: Column, items: Column, in_memory: Column, hit: Column, judge: Column) -> Column:
    """Why an answer is wrong; empty where it is right."""
    texts = {"all": F.concat_ws(" ", question, gold, answer, F.array_join(items, " ")), "question": question, "judge": judge}
    why = F.when(correct, "")
    for name, where, pattern in WHY_WRONG:
        why = why.when(F.lower(texts[where]).rlike(pattern), name)
    unanswered = (F.size(items) == 0) | F.lower(answer).rlike(NO_ANSWER)
    return why.when(~in_memory, "missing_memory").when(~hit, "retrieval_miss").when(unanswered, "bad_context_selection").otherwise("answer_model_error")


def storage_reward() -> Column:
    """Weighted sum of six flags, four decimals."""
    total = F.lit(0.0)
    for k, w in REWARD.items():
        total = total + F.col(k).cast("double") * F.lit(w)
    return F.round(total, 4)


def grounding_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Some rates over effectively stored rows, others over all."""
    stored = F.coalesce(F.col("effective_stored"), F.lit(False))
    r4 = lambda c: F.round(c, 4)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count("*").alias("cases"), F.count_if("model_would_store").alias("model_stored"), F.count_if(stored).alias("effective"), r4(rate(F.col("content_grounded"), stored)).alias("content_grounding_rate"),
        r4(rate(F.col("curriculum_bleed"), stored)).alias("curriculum_bleed_rate"), r4(rate(F.col("guard_rejected"))).alias("guard_reject_rate"), r4(rate(F.col("action_match"))).alias("action_match_rate"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, folds: str | None = None) -> DataFrame:
    """Accuracy at each of 91 thresholds (0.05 to 0.95), for each fold. Scores
    are reduced to hundredths first, so the sweep joins bounded tables."""
    by = [folds] if folds else []
    cells = df.groupBy(*by, F.floor(F.col(score) * 100 + F.lit(1e-9)).cast("int").alias("cent"), F.col(label).cast("boolean").alias("y")).agg(F.count("*").alias("n"))
    marks = df.sparkSession.range(5, 96).select(F.col("id").cast("int").alias("mark"))
    swept = cells.join(F.broadcast(marks))  # 91 rows, whatever the input
    return swept.groupBy(*by, "mark").agg((F.sum(F.when((F.col("cent") >= F.col("mark")) == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def calibrated(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """Thresholds chosen by cross-validation, one row: n, the accuracy at 0.5, the
    best threshold over all rows with its accuracy, the thresholds that the folds
    chose on the others (in fold order) and the accuracy held out. Rows are read once,
    into counts by fold, hundredth and label; a fold's training counts are the total
    less its own. The least of equally good thresholds is chosen."""
    cells = df.groupBy(F.col(fold).alias("fold"), F.floor(F.col(score) * 100 + F.lit(1e-9)).cast("int").alias("cent"), F.col(label).cast("boolean").alias("y")).agg(F.count("*").alias("n"))
    marks = df.sparkSession.range(5, 96).select(F.col("id").cast("int").alias("mark"))
    right = cells.join(F.broadcast(marks)).groupBy("fold", "mark").agg(F.sum(F.when((F.col("cent") >= F.col("mark")) == F.col("y"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n"))
    every = Window.partitionBy("mark")
    right = right.withColumns({"all": F.sum("right").over(every), "total": F.sum("n").over(every)})
    first_best = lambda by: F.max_by("mark", F.struct(by, -F.col("mark")))
    by_fold = right.groupBy("fold").agg(F.max_by(F.struct("mark", "right"), F.struct(F.col("all") - F.col("right"), -F.col("mark"))).alias("chosen"))
    held = by_fold.agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "chosen.mark"))), lambda x: x.mark / 100).alias("fold_thresholds"), F.sum("chosen.right").alias("held_right"))
    whole = right.groupBy("mark").agg(F.any_value("all").alias("all"), F.any_value("total").alias("n"))
    fit = whole.agg(F.max("n").alias("n"), F.max(F.when(F.col("mark") == 50, F.col("all"))).alias("half"), first_best(F.col("all")).alias("mark"), F.max("all").alias("best"))
    return fit.join(held, F.lit(True)).select("n", (F.col("half") / F.col("n")).alias("accuracy_half"), (F.col("mark") / 100).alias("threshold"), (F.col("best") / F.col("n")).alias("accuracy_fit"), "fold_thresholds", (F.col("held_right") / F.col("n")).alias("accuracy_held_out"))


def gate_confusion(df: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """Tp, fn, fp, tn and rates over max(1, n)."""
    n = F.greatest(F.lit(1), F.count("*"))
    return df.agg(
        F.count_if(expected & predicted).alias("tp"), F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & predicted).alias("fp"), F.count_if(~expected & ~predicted).alias("tn"),
        F.round(F.count_if(expected == predicted) / n, 4).alias("accuracy"),
    )


def parse_failure_classes(raw: Column) -> Column:
    """Labels of a raw tagged output."""
    lines = F.filter(F.transform(F.split(raw, "\n"), F.trim), lambda x: x != "")
    end = F.array_position(lines, F.lit("END"))
    body = F.when(end > 0, F.slice(lines, F.lit(1), end.cast("int"))).otherwise(lines)
    slip = F.exists(body, lambda x: x.startswith("F:") & (F.size(F.split(x, r"\|")) < 6))
    number = F.exists(F.filter(body, lambda x: x.startswith("Q:")), lambda x: F.exists(F.split(F.substring(x, F.lit(3), F.length(x)), ","), lambda p: (F.trim(p) != "") & ~F.trim(p).rlike(r"^-?[0-9]*\.?[0-9]+(e-?[0-9]+)?$")))
    loop = F.exists(F.array_distinct(body), lambda x: F.size(F.filter(body, lambda y: y == x)) >= 5)
    found = F.array_compact(F.array(F.when(end == 0, "runaway_no_end"), F.when(slip, "fact_pipe_slip"), F.when(number, "q_numeric_slip"), F.when(~F.exists(body, lambda x: x.startswith("R:")), "missing_reasoning_line"), F.when(loop, "repeated_line_loop")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def best_so_far(df: DataFrame, by: list[str], step: str, metrics: list[str]) -> DataFrame:
    """Whether a step beats all before it, by its metrics in order."""
    w = Window.partitionBy(*by).orderBy(step)
    value = F.struct(*metrics)
    latest = df.withColumn("_v", value).withColumn("_best", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return latest.withColumn("is_best", F.col("_best").isNull() | (F.col("_v") > F.col("_best"))).drop("_v", "_best")


def dataset_warnings(df: DataFrame, action: str, indexables: str) -> DataFrame:
    """Ratios of a dataset of 100 rows or more that are out of bounds."""
    n = F.count("*")
    share = lambda a: F.count_if(F.col(action) == a) / F.greatest(F.lit(1), n)
    ratios = df.agg(n.alias("n"), share("ignore").alias("ignore"), share("recall_context").alias("recall"), (F.count_if(F.col(indexables) > 0) / F.greatest(F.lit(1), n)).alias("indexed"))
    found = F.array_compact(F.array(F.when(F.col("ignore") > 0.45, "ignore_overrepresented"), F.when(F.col("recall") < 0.05, "recall_underrepresented"), F.when(F.col("indexed") < 0.35, "indexables_underrepresented")))
    return ratios.filter("n >= 100").select(F.explode(found).alias("warning"))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and the value at max(0, int(0.95 n) - 1) of the sorted ones,
    by counts of values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumns({"upto": upto, "n": F.sum("c").over(w)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    late = at(F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(0.95)) - 1))
    return run.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 3).alias("mean"), F.round((low + high) / 2, 3).alias("p50"), F.round(late, 3).alias("p95"))


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which each column is neither null nor empty."""
    return df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in columns])


def skip_histogram(df: DataFrame, source: str, reason: str) -> DataFrame:
    """Skipped rows by source and reason, and by reason over all (source null)."""
    rows = df.filter(F.col(reason).isNotNull())
    return rows.groupBy(source, reason).agg(F.count("*").alias("n")).unionByName(rows.groupBy(reason).agg(F.count("*").alias("n")).withColumn(source, F.lit(None).cast(df.schema[source].dataType)))


def format_sizes(df: DataFrame, one: str, other: str) -> DataFrame:
    """Total sizes of two renderings and the share that the second saves."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.length(one)).alias("one"), F.sum(F.length(other)).alias("other")).withColumn("saved", F.round(1 - F.col("other") / F.greatest(F.lit(1), F.col("one")), 4))


def repair_histogram(df: DataFrame, repairs: str, status: str) -> DataFrame:
    """How often each repair was made, and the share of rows that parse."""
    ops = df.select(F.explode(repairs).alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("value"))
    return ops.unionByName(df.agg(rate(F.col(status) != "failed").alias("value")).select(F.lit("product_parse_valid_rate").alias("name"), "value"))


def curriculum_audit(df: DataFrame, source: str, facts: str, temporal: str, most: int = 6) -> DataFrame:
    """Rows, rows with facts and with times, and the largest sources, as
    (measure, key, n)."""
    totals = df.agg(F.count("*").alias("rows"), F.count_if(F.col(facts) > 0).alias("with_facts"), F.count_if(F.col(temporal)).alias("with_temporal"))
    flat = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit("").alias("key"), F.col(c).alias("n")) for c in totals.columns])).alias("x")).select("x.*")
    top = count_by(df, source).orderBy(F.col("n").desc(), "key").limit(most)
    return flat.unionByName(top.select(F.lit("source").alias("measure"), "key", "n"))


def mix_counts(df: DataFrame, key: str, task: str) -> DataFrame:
    """Rows by task and by the part of the id before the first colon."""
    prefix = F.substring_index(F.col(key).cast("string"), ":", 1)
    return df.groupBy(F.col(task).alias("task"), prefix.alias("prefix")).agg(F.count("*").alias("n"))


def teacher_comparison(df: DataFrame, model: str, rows: int, price: dict[str, float]) -> DataFrame:
    """By model the rates of valid and of stored outputs, mean tokens, and the
    cost of ``rows`` such outputs. ``price``: of a million tokens, by model."""
    cost = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in price.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(model)), F.lit(0.0))
    out = df.groupBy(model).agg(F.count("*").alias("n"), rate(F.col("valid")).alias("valid_rate"), rate(F.col("stored")).alias("store_rate"), F.avg("tokens").alias("mean_tokens"))
    return out.withColumn("cost", F.round(F.col("mean_tokens") * rows * cost / 1e6, 4))


def dual_gate(storage: DataFrame, recall: DataFrame) -> DataFrame:
    """Whether all metrics of both gates (see ``gate``) pass, and what fails."""
    both = storage.withColumn("gate", F.lit("storage")).unionByName(recall.withColumn("gate", F.lit("recall")))
    failed = F.array_sort(F.array_compact(F.collect_list(F.when(~F.col("passed"), F.concat_ws(":", "gate", "metric")))))
    return both.agg(F.bool_and("passed").alias("passed"), failed.alias("failed"))
