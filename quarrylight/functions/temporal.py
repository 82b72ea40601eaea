"""Resolution of relative time words against a source date (F31-F38). Results
are display texts: ``7 May 2023``, ``week before 7 May 2023``, ``April 2023``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import MONTHS, col, word

#: Supported relative words; the second list is an extension.
RELATIVE = ["yesterday", "today", "tomorrow", "last week", "next week", "last month", "next month", "last year", "next year"]
THIS = ["this week", "this month", "this year"]
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMMM yyyy", "d MMMM, yyyy", "d MMM yyyy", "d MMM, yyyy"]


def source_date(x: Column | str) -> Column:
    """The UTC day of a timestamp text, else of a ``d Month yyyy`` in it, else null."""
    c = col(x)
    iso = F.regexp_extract(c, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    named = F.regexp_replace(F.regexp_extract(c, rf"(?i){word('[0-9]{1,2}' + chr(92) + 's+(?:' + MONTHS + '),?' + chr(92) + 's+[0-9]{4}')}", 0), ",", "")
    parts = F.split(named, r"\s+")
    short = F.concat_ws(" ", F.get(parts, 0), F.initcap(F.substring(F.get(parts, 1), 1, 3)), F.get(parts, 2))
    whole = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(?:Z|[+-][0-9:]+)?", 0), F.lit(""))))
    day = F.to_date(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")))
    return F.coalesce(whole, day, F.to_date(F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("d MMM yyyy"))))


def detect_relative(x: Column | str, extended: bool = False) -> Column:
    """The first relative word, lower case, or null."""
    words = "|".join(RELATIVE + (THIS if extended else []))
    return F.nullif(F.lower(F.regexp_extract(col(x), f"(?i){word(words)}", 0)), F.lit(""))


def is_supported(x: Column | str) -> Column:
    """A relative word, a year, or a day and month."""
    low = F.lower(col(x))
    return low.rlike(word("|".join(RELATIVE))) | low.rlike(word("[0-9]{4}")) | low.rlike(word(rf"[0-9]{{1,2}}\s+(?:{MONTHS})"))


def resolve_relative(expression: Column | str, anchor: Column, extended: bool = False) -> Column:
    """Display text of a relative word seen from the day ``anchor``."""
    e = F.lower(col(expression))

    def day(d: Column) -> Column:
        return F.date_format(d, "d MMMM yyyy")

    def month(n: int) -> Column:
        return F.date_format(F.add_months(F.trunc(anchor, "MM"), n), "MMMM yyyy")

    year = F.year(anchor)
    out = (
        F.when(e == "today", day(anchor)).when(e == "yesterday", day(F.date_add(anchor, -1))).when(e == "tomorrow", day(F.date_add(anchor, 1)))
        .when(e == "last week", F.concat(F.lit("week before "), day(anchor))).when(e == "next week", F.concat(F.lit("week after "), day(anchor)))
        .when(e == "last month", month(-1)).when(e == "next month", month(1))
        .when(e == "last year", (year - 1).cast("string")).when(e == "next year", (year + 1).cast("string"))
    )
    if extended:
        out = out.when(e == "this week", F.concat(F.lit("week of "), day(anchor))).when(e == "this month", month(0)).when(e == "this year", year.cast("string"))
    return out


def normalized(expression: Column, text: Column, resolved: Column, confidence: Column, stamp: Column) -> Column:
    """struct(temporal_expression, resolved_time, resolved_time_confidence) of a
    memory or fact (F35, F36): unsupported words clear all three, unresolved ones
    leave them, a resolution sets them with confidence 0.9 at least."""
    found = F.coalesce(expression, detect_relative(text))
    new = resolve_relative(found, source_date(stamp))
    kept = F.struct(expression.cast("string").alias("temporal_expression"), resolved.cast("string").alias("resolved_time"), confidence.cast("double").alias("resolved_time_confidence"))
    nothing = F.struct(F.lit(None).cast("string").alias("temporal_expression"), F.lit(None).cast("string").alias("resolved_time"), F.lit(None).cast("double").alias("resolved_time_confidence"))
    done = F.struct(found.alias("temporal_expression"), new.alias("resolved_time"), F.greatest(F.coalesce(confidence.cast("double"), F.lit(0.0)), F.lit(0.9)).alias("resolved_time_confidence"))
    return F.when(found.isNull(), kept).when(~is_supported(found), nothing).when(new.isNull(), kept).otherwise(done)
