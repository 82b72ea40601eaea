r"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: a line without a word is neutral; a line with
words fails

* punctuation: it does not end in a terminal mark, or more than ``MARKS`` of
  its non-blank characters are neither letters, marks nor digits;
* navigation: it has at least three separators, one to every five words or more;
* boilerplate: it holds one of a fixed list of phrases in four languages.

Failed lines are removed; a document is rejected if the lines that stay hold
less than ``LEAST`` of the characters that its words had. Base counts follow
the contract: words ``[^\x20\x09-\x0D]+`` of the whole text, symbols, repeated
lines, and words in three-word windows that occur twice or more.

A repeated window is found by sorting a document's windows, so a text of n
words costs n log n and stays one row: no shuffle at all.

Defined results: a null text counts as empty, has no word and fails the base
rules; rows are judged one by one, so repeated rows and null doc_ids pass
through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import BLANKS

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Boilerplate phrases in English, French, German and Spanish,
#: matched without regard to case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "released under the",
    "sign up for",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use cookies",
    "abonnez-vous à",
    "cliquez ici",
    "conditions générales",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "utilise des cookies",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "hier klicken",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "verwendet cookies",
    "aviso legal",
    "haga clic aquí",
    "política de privacidad",
    "suscríbete a",
    "términos y condiciones",
    "todos los derechos reservados",
    "utiliza cookies",
)
SEPARATORS = "|»›•·→"
MARKS, LEAST, MIN_WORDS, REPEAT_PERCENT = 0.2, 0.5, 50, 50
TERMINAL = r"[.!?…。！？؟।:;][\"'”’»)\]]*$"
WORDLIKE = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"


#: Words in windows found twice or more. Each transform(array(x), v -> ...)[0]
#: binds v to x, so that no rewriting of the plan evaluates x for each element.
REPEATS = """
transform(array(q_words), w ->
  transform(array(sort_array(transform(sequence(0, size(w) - 3, 1), i -> struct(concat(get(w, i), ' ', get(w, i + 1), ' ', get(w, i + 2)) AS g, i AS p)))), s ->
    aggregate(sort_array(transform(filter(s, (x, i) -> x.g <=> get(s, i - 1).g OR x.g <=> get(s, i + 1).g), x -> x.p)),
      struct(0 AS upto, 0L AS total), (a, p) -> struct(p + 3 AS upto, a.total + p + 3 - greatest(p, a.upto) AS total), a -> a.total))[0])[0]
"""


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _line_passes(line: Column) -> Column:
    solid = F.length(_without(line, BLANKS))
    words = F.size(F.split(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    marks = F.length(F.regexp_replace(line, WORDLIKE, ""))
    separators = F.length(line) - F.length(_without(line, SEPARATORS))
    ends = F.rtrim(line, F.lit(BLANKS)).rlike(TERMINAL)
    # bound to a name: else each phrase would lower the line again
    boiler = F.exists(F.array(F.lower(line)), lambda low: reduce(Column.__or__, [low.contains(phrase) for phrase in BOILERPLATE]))
    return ends & (marks <= F.lit(MARKS) * solid) & ~((separators >= 3) & (separators * 5 >= words)) & ~boiler


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` plus the base counts, line counts, ``clean_text``, ``base_failed``
    and ``kept``; all added columns start with ``q_``."""
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("q_text", text)
    out = out.withColumn("q_bare", F.btrim("q_text", F.lit(BLANKS)))
    out = out.withColumn("q_words", F.when(F.col("q_bare") == "", F.array().cast("array<string>")).otherwise(F.split("q_bare", blank)))
    out = out.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(word)))
    out = out.withColumn("q_n_words", F.size("q_words").cast("long"))
    out = out.withColumn("q_word_chars", F.length(_without(F.col("q_text"), BLANKS)).cast("long"))
    out = out.withColumn("q_n_symbols", (F.length("q_text") - F.length(_without(F.col("q_text"), SYMBOLS))).cast("long"))
    out = out.withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    out = out.withColumn("q_n_repeat_words", F.coalesce(F.expr(f"CASE WHEN q_n_words >= 3 THEN {REPEATS} END"), F.lit(0)).cast("long"))
    out = out.withColumn("q_base_failed", (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words")))
    out = out.withColumn("q_kept_lines", F.filter("q_lines", _line_passes))
    out = out.withColumn("q_clean_text", F.array_join("q_kept_lines", "\n"))
    out = out.withColumn("q_kept_chars", F.length(_without(F.col("q_clean_text"), BLANKS)).cast("long"))
    out = out.withColumn("q_n_lines", F.size("q_lines").cast("long")).withColumn("q_n_kept_lines", F.size("q_kept_lines").cast("long"))
    out = out.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_kept_chars") >= F.lit(LEAST) * F.col("q_word_chars")))
    return out.drop("q_text", "q_bare", "q_words", "q_lines", "q_kept_lines")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the characters and lines that stay."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "n_lines", "n_kept_lines"]
    return judged(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents kept, without their failed lines, in the columns of ``docs``;
    a text that lost no line stays as it was, ``n_chars`` follows the text."""
    # the columns of docs travel in one struct, so that none can clash; the row
    # number keeps the filter above the projection, which else is evaluated for both
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    out = judged(whole).withColumn("q_row", F.monotonically_increasing_id()).filter("q_kept")
    changed = F.col("q_n_kept_lines") < F.col("q_n_lines")
    columns = []
    for f in docs.schema:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.when(changed, F.col("q_clean_text")).otherwise(own)
        elif f.name == "n_chars":
            own = F.when(changed, F.length("q_clean_text").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return out.select(*columns)


SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT row_id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base
), lines AS (
  SELECT row_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM words
), judged AS (
  SELECT row_id, line,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS marks,
    length(regexp_replace(line, '[^{SEPARATORS}]+', '', 'g')) AS separators,
    regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '[.!?…。！？؟।:;]["''”’»)\]]*$') AS ends,
    regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS boiler
  FROM lines
), verdicts AS (
  SELECT *, ends AND marks <= {MARKS} * solid AND NOT (separators >= 3 AND separators * 5 >= n) AND NOT boiler AS passes FROM judged
), by_line AS (
  SELECT row_id, count(*) AS n_lines, count(DISTINCT line) AS distinct_lines,
    count(*) FILTER (passes) AS n_kept_lines, coalesce(sum(solid) FILTER (passes), 0) AS kept_chars
  FROM verdicts GROUP BY row_id
), grams AS (
  SELECT row_id, p, list_extract(w, p) || ' ' || list_extract(w, p + 1) || ' ' || list_extract(w, p + 2) AS g
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS p FROM words WHERE len(w) >= 3)
), twice AS (
  SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, g) AS c FROM grams) WHERE c > 1
), repeated AS (
  SELECT row_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT row_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY row_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines - distinct_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(kept_chars, 0)::BIGINT AS kept_chars, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept_lines, 0)::BIGINT AS n_kept_lines
  FROM words LEFT JOIN by_line USING (row_id) LEFT JOIN repeated USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND kept_chars >= {LEAST} * word_chars AS kept,
  kept_chars, n_lines, n_kept_lines
FROM counts
"""
