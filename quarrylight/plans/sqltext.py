"""Snippets of DuckDB SQL for the oracles."""

from __future__ import annotations

from quarrylight.functions.text import KEY_STOPWORDS, MONTHS, RELATIVE, STOPWORDS


def literals(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def stem(t: str) -> str:
    return (
        f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'es') AND length({t}) > 4 THEN left({t}, length({t}) - 2) "
        f"WHEN ends_with({t}, 's') AND length({t}) > 3 THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: {stem('t')}), lambda t: length(t) > 2 AND NOT list_contains({literals(STOPWORDS)}, t))"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b\d{{2,4}}\b')"


def entities(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '\b[A-Z][a-zA-Z]{{2,}}\b'), lambda w: {stem('lower(w)')})"


def meaningful(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({literals(KEY_STOPWORDS)}, t))"


def distinct(x: str) -> str:
    """First of each, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def squeeze(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def temporal_signal(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches(lower({x}), '\b\d{{4}}\b') THEN 1.0::DOUBLE "
        rf"WHEN regexp_matches(lower({x}), '\b\d{{1,2}}\s+(?:{MONTHS})\b') THEN 0.9::DOUBLE "
        rf"WHEN regexp_matches(lower({x}), '\b(?:{MONTHS})\b') THEN 0.7::DOUBLE "
        rf"WHEN regexp_matches(lower({x}), '\b(?:{RELATIVE})\b') THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END"
    )


def hits(q: str, m: str, more: str = "") -> str:
    return f"len(list_filter({q}, lambda t: list_contains({m}, t){more}))"
