"""Python forms of a few text functions, for code that runs inside tasks with
state. Tests hold them against the column expressions in ``functions.text``."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from math import floor, sqrt

from quarrylight.functions import text as t

_TOKEN, _NUMBER = re.compile("[a-z0-9]+"), re.compile(f"{t.LEFT}[0-9]{{2,4}}{t.RIGHT}")
_ENTITY = re.compile(f"{t.LEFT}[A-Z][a-zA-Z]{{2,}}{t.RIGHT}")
_QUESTION = re.compile(t.word(t.TEMPORAL_QUESTION))
_SIGNALS = [(re.compile(p, re.ASCII), v) for p, v in ((t.word("[0-9]{4}"), 1.0), (t.word(rf"[0-9]{{1,2}}\s+(?:{t.MONTHS})"), 0.9), (t.word(t.MONTHS), 0.7), (t.word(t.RELATIVE), 0.45))]
_STOP = frozenset(t.STOPWORDS)
_BLANK = re.compile(r"\s+", re.ASCII)


def stem(x: str) -> str:
    if x.endswith("ies") and len(x) > 4:
        return x[:-3] + "y"
    if x.endswith("es") and len(x) > 4:
        return x[:-2]
    return x[:-1] if x.endswith("s") and len(x) > 3 else x


@lru_cache(1 << 16)
def _kept(x: str) -> str:
    """The stem of a word, empty if it is no token."""
    s = stem(x)
    return s if len(s) > 2 and s not in _STOP else ""


def tokens(x: str | None) -> list[str]:
    return [s for s in map(_kept, _TOKEN.findall((x or "").lower())) if s]


def significant_tokens(x: str | None) -> list[str]:
    return [s for s in tokens(x) if not s.isdigit()]


def numbers(x: str | None) -> list[str]:
    return _NUMBER.findall(x or "")


def entity_tokens(x: str | None) -> list[str]:
    return [stem(s.lower()) for s in _ENTITY.findall(x or "")]


def temporal_question(x: str) -> bool:
    return bool(_QUESTION.search(x.lower()))


def temporal_signal(x: str) -> float:
    low = x.lower()
    return next((v for p, v in _SIGNALS if p.search(low)), 0.0)


def strip(x: str) -> str:
    return x.strip(" \t\n\x0b\x0c\r")


def content_key(x: str) -> str:
    return _BLANK.sub(" ", strip(x).lower())


def json_object(x: str) -> str:
    """From the first brace to the last, else the trimmed text."""
    a, b = x.find("{"), x.rfind("}")
    return x[a : b + 1] if 0 <= a < b else strip(x)


def round6(x: float) -> float:
    """Half up at six places, as the columns round."""
    return floor(x * 1e6 + 0.5) / 1e6


class Question:
    """The features of a query or a new text, and its score of a memory."""

    def __init__(self, text: str):
        self.tokens, self.numbers, self.entities, self.temporal = tokens(text), numbers(text), entity_tokens(text), temporal_question(text)

    def score(self, m: Memory) -> float:
        n, entities, tags = (sum(x in s for x in q) for q, s in ((self.tokens, m.words), (self.entities, m.words), (self.tokens, m.tag_words)))
        return self.scored(m, n, sum(x in m.words and len(x) >= 5 for x in self.tokens), sum(x in m.numbers for x in self.numbers), entities, tags)

    def scored(self, m: Memory, n: int, rare: int, numbers: int, entities: int, tags: int) -> float:
        """The score of a memory by what it has of the question's tokens (of all, and of
        those of five characters), numbers and entities, and its tags of the tokens."""
        nq = len(self.tokens)
        return round6(
            0.9 * (n / sqrt(nq * m.n) if nq and m.n else 0.0) + 0.75 * (n / nq if nq else 0.0) + 0.18 * rare
            + 0.55 * (numbers / len(self.numbers) if self.numbers and m.numbers else 0.0) + 0.25 * (m.temporal if self.temporal else 0.0)
            + 0.4 * (entities / len(self.entities) if self.entities and m.n else 0.0) + 0.25 * (tags / sqrt(nq * m.n_tags) if nq and m.n_tags else 0.0)
            + 0.12 * m.confidence + 0.08 * m.strength + (0.04 if m.table == "semantic" else 0.0)
        )


class Memory:
    """The features of a memory row, a dict of its columns."""

    EXTRA = ("source_kind", "source_id", "source_label", "temporal_expression", "resolved_time", "source_timestamp")

    def __init__(self, table: str, row: dict):
        tags = " ".join(row.get("tags") or [])
        searchable = " ".join([row["content"], tags, *(row.get(c) or "" for c in self.EXTRA)])
        found, tag_tokens = tokens(searchable), tokens(tags)
        self.table, self.id, self.content = table, row["id"], row["content"]
        self.words, self.n, self.tag_words, self.n_tags = set(found), len(found), set(tag_tokens), len(tag_tokens)
        self.numbers, self.temporal = set(numbers(searchable)), temporal_signal(searchable)
        self.confidence, self.strength = row["confidence"], row["strength"]
        # the score for a question that has nothing in common, and for one of time
        self.bare = [round6(0.25 * (self.temporal if asked else 0.0) + 0.12 * self.confidence + 0.08 * self.strength + (0.04 if table == "semantic" else 0.0)) for asked in (False, True)]


class Index:
    """Memories by their words, tag words and numbers, so a question meets only those
    that have something in common with it."""

    def __init__(self) -> None:
        self.words: dict = defaultdict(dict)
        self.tags: dict = defaultdict(dict)
        self.numbers: dict = defaultdict(dict)

    def _lists(self, m: Memory):
        return ((self.words, m.words), (self.tags, m.tag_words), (self.numbers, m.numbers))

    def add(self, m: Memory) -> None:
        for held, keys in self._lists(m):
            for x in keys:
                held[x][m] = None

    def remove(self, m: Memory) -> None:
        for held, keys in self._lists(m):
            for x in keys:
                del held[x][m]
                if not held[x]:
                    del held[x]

    def scores(self, q: Question) -> dict[Memory, float]:
        """Scores of the memories that have anything in common with the question."""
        n, rare, numbers, entities, tags = ({} for _ in range(5))

        def count(into: dict, held: dict, keys: Counter) -> None:
            for x, times in keys.items():
                for m in held.get(x, ()):
                    into[m] = into.get(m, 0) + times

        own = Counter(q.tokens)
        count(n, self.words, own)
        count(rare, self.words, {x: k for x, k in own.items() if len(x) >= 5})
        count(tags, self.tags, own)
        count(entities, self.words, Counter(q.entities))
        count(numbers, self.numbers, Counter(q.numbers))
        return {m: q.scored(m, n.get(m, 0), rare.get(m, 0), numbers.get(m, 0), entities.get(m, 0), tags.get(m, 0)) for m in n | numbers | entities | tags}
