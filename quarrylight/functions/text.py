r"""Token, key and text-shape functions as native column expressions.

ASCII word boundaries are written with lookarounds, since Java's ``\b`` also
takes accented letters as word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the ranking tokenizer.
STOPWORDS = ["the", "and", "for", "that", "this", "with", "you", "your", "what", "when", "where", "why", "how", "are", "was", "were", "has", "have", "had", "from", "about", "into", "onto", "then", "than", "they", "them", "does", "did", "doing", "done", "will", "would", "could", "should", "their", "there", "here", "also"]
#: Stop words of key synthesis.
KEY_STOPWORDS = ["the", "and", "for", "that", "this", "with", "from", "into", "said", "user", "memory"]
#: Month names and abbreviations, as one alternation.
MONTHS = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
#: Relative expressions that raise the temporal signal, and those of question words.
RELATIVE = "yesterday|today|tomorrow|last year|last week|last month|next year|next week|next month"
TEMPORAL_QUESTION = "when|date|year|month|day|time"
#: Phrases of the bleed blocklist.
BLEED = r"(?i)checkpoint|powershell|gate datasets|nvidia-smi|direct probe|token budget|runpod|fact parser|malformed parser|constoursated|gate6|expanded probe|gate-?\d"
#: Workflow headers and the keys they stand for.
WORKFLOWS = [("review.*pull request|pull request review", "review-pr"), ("runpod.*train|gpu train|train.*runpod", "runpod-gpu-train"), ("grounding bar|promotion bar", "grounding-bar")]
#: What is redacted and its labels. A local path is one of any drive.
SECRETS = [
    (r"hf_[A-Za-z0-9_=-]{16,}", "[REDACTED_HF_TOKEN]"),
    (r"(?i)sk-[A-Za-z0-9_-]{8,}", "[REDACTED_API_KEY]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"[A-Za-z]:\\[^ \n\r\t\"'`]+", "[LOCAL_PATH]"),
    (r"(?i)/content/[^ \n\r\t\"'`]+", "[COLAB_PATH]"),
]
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries."""
    return f"{LEFT}(?:{pattern}){RIGHT}"


def strip(x: Column | str) -> Column:
    """Trim all white space, not blanks alone."""
    return F.regexp_replace(F.regexp_replace(col(x), r"^\s+", ""), r"\s+$", "")


def squeeze(x: Column | str) -> Column:
    """Collapse white space and trim."""
    return strip(F.regexp_replace(col(x), r"\s+", " "))


def content_key(x: Column | str) -> Column:
    """Trimmed, lower case, single blanks."""
    return F.regexp_replace(F.lower(strip(x)), r"\s+", " ")


def stem(t: Column) -> Column:
    """ies -> y, es and s dropped, by length (F2)."""
    n = F.length(t)
    return (
        F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("es") & (n > 4), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("s") & (n > 3), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def _runs(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def tokens(x: Column | str) -> Column:
    """Stemmed tokens of more than two characters that are no stop words (F1)."""
    found = F.transform(_runs(F.lower(F.coalesce(col(x), F.lit(""))), "[a-z0-9]+"), stem)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def numbers(x: Column | str) -> Column:
    """Numbers of two to four digits."""
    return _runs(F.coalesce(col(x), F.lit("")), f"{LEFT}[0-9]{{2,4}}{RIGHT}")


def entity_tokens(x: Column | str) -> Column:
    """Capitalised words, lower case and stemmed."""
    return F.transform(_runs(F.coalesce(col(x), F.lit("")), f"{LEFT}[A-Z][a-zA-Z]{{2,}}{RIGHT}"), lambda t: stem(F.lower(t)))


def significant_tokens(x: Column | str) -> Column:
    """Tokens that are not all digits."""
    return F.filter(tokens(x), lambda t: ~t.rlike("^[0-9]+$"))


def meaningful_tokens(x: Column | str) -> Column:
    """Unstemmed tokens for keys."""
    return F.filter(_runs(F.lower(squeeze(x)), "[a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(KEY_STOPWORDS))


def keywords(x: Column | str, n: int = 12) -> Column:
    """The first words of three characters or more."""
    return F.slice(_runs(F.lower(col(x)), "[a-z0-9]{3,}"), 1, n)


def slug(x: Column | str, joiner: str = "-", keep: str = "a-z0-9") -> Column:
    lowered = F.regexp_replace(F.lower(col(x)), f"[^{keep}]+", joiner)
    return F.regexp_replace(F.regexp_replace(lowered, f"^{joiner}+", ""), f"{joiner}+$", "")


def recall_key(x: Column | str) -> Column:
    """Lower case, anything else a hyphen."""
    return slug(x)


def clean_key(x: Column | str) -> Column:
    """As recall_key, hyphens kept."""
    return slug(strip(x), keep="a-z0-9-")


def predicate(x: Column | str) -> Column:
    """Snake case, null if nothing is left."""
    return F.nullif(slug(strip(x), "_"), F.lit(""))


def step_id(x: Column | str) -> Column:
    """Identifier of a workflow step."""
    bare = F.regexp_replace(F.lower(col(x)), "`([^`]+)`", "$1")
    short = F.substring(slug(bare, "_"), 1, 48)
    return F.when(short == "", F.lit("step")).otherwise(short)


def first_statement(x: Column | str) -> Column:
    """Up to the first sentence end, else all."""
    found = F.regexp_extract(col(x), r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(found == "", col(x)).otherwise(found)


def shortened(x: Column | str, most: int) -> Column:
    """At most ``most`` characters, three of them dots where it was cut."""
    c = col(x)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(strip(F.substring(c, 1, most - 3)), F.lit("...")))


def hint(x: Column | str) -> Column:
    """First sentence, at most 160 characters (F16)."""
    return shortened(first_statement(x), 160)


def without_metadata(x: Column | str) -> Column:
    """Without a leading [..]."""
    return strip(F.regexp_replace(col(x), r"^\[[^\]]+\]\s*", ""))


def source_suffix(source_id: Column, resolved: Column, stamp: Column) -> Column:
    """(source=..; date=..) from what is known."""

    def some(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    parts = F.concat_ws("; ", F.when(some(source_id), F.concat(F.lit("source="), source_id)), F.when(some(resolved), F.concat(F.lit("date="), resolved)), F.when(~some(resolved) & some(stamp), F.concat(F.lit("source_time="), stamp)))
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit(" ("), parts, F.lit(")")))


def estimated_tokens(x: Column | str) -> Column:
    """A fourth of the trimmed length, at least 1 unless empty."""
    return F.ceil(F.length(strip(x)) / 4).cast("int")


def chunk_source(base: Column, index: Column) -> Column:
    return F.concat(base, F.lit(":chunk-"), index.cast("string"))


def base_source(x: Column | str) -> Column:
    """Source id without its chunk number."""
    return F.regexp_replace(col(x), r":chunk-[0-9]+$", "")


def redacted(x: Column | str) -> Column:
    """Tokens, keys, e-mail addresses and paths replaced; blanks collapsed."""
    out = col(x)
    for pattern, label in SECRETS:
        out = F.regexp_replace(out, pattern, label)
    return squeeze(out)


def tag_value(tags: Column | str, key: str) -> Column:
    """What follows ``key:`` in the first such tag."""
    found = F.get(F.filter(col(tags), lambda t: t.startswith(f"{key}:")), 0)
    return F.substring(found, F.lit(len(key) + 2), F.length(found))


def word_shingles(words: Column, n: int = 8) -> Column:
    """Runs of n words, none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def pieces(x: Column | str) -> Column:
    """Words and single marks."""
    return _runs(col(x), r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def count_terms(x: Column | str, terms: list[str]) -> Column:
    """How many of ``terms`` the text holds."""
    low = F.lower(col(x))
    total = F.lit(0)
    for t in terms:
        total = total + low.contains(t).cast("int")
    return total


def topic_tags(x: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Tags whose pattern the text matches."""
    return F.array_compact(F.array(*[F.when(col(x).rlike(f"(?i){p}"), F.lit(t)) for p, t in rules]))


def unique_tags(tags: Column | str) -> Column:
    """Trimmed, not empty, blanks as underscores, first of each."""
    trimmed = F.filter(F.transform(col(tags), strip), lambda t: t != "")
    return F.array_distinct(F.transform(trimmed, lambda t: F.regexp_replace(t, r"\s+", "_")))


def has_bleed(x: Column | str) -> Column:
    """Matches the bleed blocklist (P5)."""
    return col(x).rlike(BLEED)


def temporal_question(x: Column | str) -> Column:
    return F.lower(col(x)).rlike(word(TEMPORAL_QUESTION))


def temporal_signal(x: Column | str) -> Column:
    """1 for a year, .9 a day and month, .7 a month, .45 a relative word."""
    low = F.lower(col(x))
    return (
        F.when(low.rlike(word("[0-9]{4}")), 1.0)
        .when(low.rlike(word(rf"[0-9]{{1,2}}\s+(?:{MONTHS})")), 0.9)
        .when(low.rlike(word(MONTHS)), 0.7)
        .when(low.rlike(word(RELATIVE)), 0.45)
        .otherwise(0.0)
    )


def workflow_key(text: Column | str, tags: Column | None = None) -> Column:
    """From a workflow: tag, else from the header and the first 240 characters."""
    t = col(text)
    hay = F.lower(F.concat(F.regexp_extract(t, r"(?m)^#\s+(.+)$", 1), F.lit("\n"), F.substring(t, 1, 240)))
    out = F.lit(None).cast("string")
    for pattern, key in reversed(WORKFLOWS):
        out = F.when(hay.rlike(pattern), F.lit(key)).otherwise(out)
    if tags is None:
        return out
    tagged = F.get(F.filter(tags, lambda x: F.lower(x).rlike("^workflow:[a-z0-9-]+$")), 0)
    return F.coalesce(F.lower(F.regexp_replace(tagged, "(?i)^workflow:", "")), out)


def workflow_steps(text: Column | str) -> Column:
    """Ids of numbered lines, first of each."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: x.rlike(r"^\s*[0-9]+\.\s+.+$"))
    return F.array_distinct(F.transform(lines, lambda x: step_id(strip(F.regexp_replace(x, r"^\s*[0-9]+\.\s+", "")))))


def mnemonic_key(content: Column | str, tags: Column | None = None) -> Column:
    """The first four distinct tokens of tags and content."""
    found = meaningful_tokens(content)
    if tags is not None:
        found = F.concat(F.flatten(F.transform(tags, lambda t: meaningful_tokens(F.regexp_replace(t, "_", " ")))), found)
    key = F.array_join(F.slice(F.array_distinct(found), 1, 4), "-")
    return F.when(key == "", F.lit("memory-anchor")).otherwise(key)


def fact_key(subject: Column, pred: Column, value: Column) -> Column:
    """Anchor key of a fact."""
    return F.array_join(F.slice(F.array_distinct(F.concat(*[meaningful_tokens(F.coalesce(c, F.lit(""))) for c in (subject, pred, value)])), 1, 4), "-")


def salience(content: Column | str, tags: Column | None = None) -> Column:
    """0.68 and more for temporal, decision and tagged content, at most 0.98."""
    low = F.lower(col(content))
    score = F.lit(0.68) + F.when(low.rlike(word("[0-9]{4}") + "|yesterday|last week|workflow|review|procedure"), 0.08).otherwise(0.0)
    score = score + F.when(low.rlike("decision|prefer|constraint|indexable|mnemonic|recall"), 0.12).otherwise(0.0)
    if tags is not None:
        score = score + F.when(F.size(tags) > 0, 0.04).otherwise(0.0)
    return F.round(F.least(score, F.lit(0.98)), 2)


def fnv1a(x: Column | str) -> Column:
    """32-bit FNV-1a over code points, as a number."""
    codes = F.transform(F.filter(F.split(col(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def json_object(x: Column | str) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(col(x), r"(?s)\{.*\}", 0), F.lit(""))


def round6(x: Column) -> Column:
    return F.round(x, 6)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
