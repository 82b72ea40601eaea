"""Language-model scores from a log-frequency Bloom filter.

A count c is held as its level 1 + floor(log c / log ``BASE``): the filter gets the
pairs (n-gram, 1) .. (n-gram, level), so a level is read back by probing 1, 2, ..
until a probe fails, and stands for the mean of the whole numbers it covers. An
n-gram that was inserted is never read too low; one that was not is found by a
false positive with probability about ``(1 - exp(-K / BITS)) ** K``, 0.35 %, and
one level too high as often. As a pair is no more frequent than its words, its
level is probed only up to the lesser of theirs.

The model interpolates by a Dirichlet prior of ``PRIOR`` observations:

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | v) = (c(v w) + PRIOR P(w)) / (c(v) + PRIOR)

over words and one end for each text; a text's first token follows a start, seen
once in each text. The score is the sum of log10 P(w | v). Counts of this model come
from the filter; the base score, log10 P(w) summed, has exact ones.

How it runs. Tasks count the words and pairs of their part of the training texts and
send them on as one row for each of ``segments`` ranges of hashes, whose number
follows the bytes of text; a group merges the counts of its range and builds the
part of the filter for it, ``BITS`` bits for each pair inserted. Hashes are even and
counts are summed before they move, so no word makes a group large. Parts go to
the workers in slices of at most ``MOST_BYTES``, one pass over the texts for each
slice: a pair is looked up in the slice that holds its range, so the sums of
the passes are the score whatever their number. The words' part has at most
``WORD_BYTES``: beyond it words get fewer bits each, and more are found wrongly.
For the base score, words of high levels, at most ``HEAD``, are looked up in a
broadcast table; the others, which are rare, meet their exact counts in a join.

Words are compared by 128 bits of hash (64 within a task's part), pairs by 64.
Defined results: a null text is an empty one, a single end; a null doc_id has no
remainder, is held out and not learned from; rows that repeat doc_id and text are
scored alike and each learned from; without training texts every token has
probability 1 (0.1 / 0.1); texts are whole, however long; other columns, whatever
their names, are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, give_back, text_slices
from quarrylight.llm.wordhash import Words, mix, text_buffer

BASE, BITS, K, PRIOR = 1.5, 12, 7, 60.0
MOST_BYTES, WORD_BYTES, HEAD = 192 << 20, 32 << 20, 1 << 18
SEGMENT_BYTES, FLUSH, SLICE, SENT = 8 << 20, 3 << 20, 2 << 20, 2 << 20
U = np.uint64
#: Hashes of the end and the start of a text; words are mixed, so these are as any other's.
END, END2, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F), U(0xD1342543DE82EF95)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count of one or more; exact, as thresholds are whole numbers."""
    return np.searchsorted(_FROM, counts, "right")


def _thresholds() -> tuple[np.ndarray, np.ndarray]:
    """The least count of each level that holds one, and the mean of its counts."""
    edges = sorted({math.ceil(BASE**k) for k in range(int(62 / math.log2(BASE)))})
    return np.array(edges, np.int64), np.array([0.0] + [(a + b - 1) / 2 for a, b in zip(edges, edges[1:])] + [float(edges[-1])])


_FROM, MEAN = _thresholds()


def _places(grams: np.ndarray, level: int, size: np.uint64) -> Iterator[np.ndarray]:
    """K places of (gram, level) within its segment of ``size`` bits, one after the other."""
    a, b = _hashes(grams, level)
    for j in range(K):
        yield (a + U(j) * b) % size


def _hashes(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(grams + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return x >> U(32), (x & U(0xFFFFFFFF)) | U(1)


def slab(grams: np.ndarray, counts: np.ndarray, most_bits: int) -> np.ndarray:
    """The packed bits of one segment."""
    level = level_of(counts)
    size = min(BITS * int(level.sum()), most_bits) + 7 & ~7
    flags = np.zeros(size, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        for p in _places(grams[level >= at], at, U(size)):
            flags[p] = True
    return np.packbits(flags, bitorder="little")


class Filter:
    """Packed bits of some of ``segments`` ranges of hashes, one after another.
    ``sizes`` are their bytes; ``parts``, in any order, are put into place one by one."""

    def __init__(self, segments: int, sizes: dict[int, int], parts: Iterable[tuple[int, bytes]]):
        self.shift = U(64 - segments.bit_length() + 1)
        self.size = np.zeros(segments, U)
        for s, n in sizes.items():
            self.size[s] = 8 * n
        self.at = (np.cumsum(self.size) - self.size).astype(U)
        self.bits = np.zeros(sum(sizes.values()), np.uint8)
        for s, data in parts:
            a = int(self.at[s]) // 8
            self.bits[a : a + len(data)] = np.frombuffer(data, np.uint8)

    def segment(self, grams: np.ndarray) -> np.ndarray:
        return segment_of(grams, self.shift)

    def levels(self, grams: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Levels read by probing, up to ``most`` of each gram."""
        out = np.zeros(len(grams), np.int64)
        where = self.segment(grams)
        size, base = self.size[where], self.at[where]
        live, level = np.flatnonzero((size > 0) & (most > 0)), 0
        while len(live):
            level += 1
            sized = size[live]
            start = base[live]
            a, b = _hashes(grams[live], level)
            for j in range(K):
                p = start + (a + U(j) * b) % sized
                hit = np.flatnonzero((self.bits[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1)
                if len(hit) < len(live):
                    live, sized, start, a, b = live[hit], sized[hit], start[hit], a[hit], b[hit]
            out[live] = level
            live = live[most[live] > level]
        return out


def segment_of(grams: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (grams >> shift if shift < 64 else np.zeros(len(grams), U)).astype(np.int64)


class Tokens:
    """Words of texts in lower case (A-Z only) and an end after each: ``hash``,
    ``hash2``, ``before`` (the hash of the token before, or START) and ``of``, the text."""

    def __init__(self, column: pa.Array):
        raw, off = text_buffer(column)
        raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        words = Words(raw, off)
        n = len(off) - 1
        self.of = np.concatenate([np.repeat(np.arange(n), np.diff(words.off)), np.arange(n)])
        order = np.argsort(self.of, kind="stable")
        self.of = self.of[order]
        self.hash = np.concatenate([words.hash, np.full(n, END, U)])[order]
        self.hash2 = np.concatenate([words.hash2, np.full(n, END2, U)])[order]
        self.before = np.concatenate([np.full(min(n, 1), START, U), self.hash[:-1]])
        self.before[1:][np.diff(self.of) > 0] = START
        self.count = np.bincount(self.of, minlength=n)

    def pairs(self) -> np.ndarray:
        return mix(self.before * U(0xC6A4A7935BD1E995) + self.hash)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts (of ones)."""
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


COUNTED = "kind int, segment int, grams binary, grams2 binary, counts binary, texts long"
WORD, PAIR = 1, 2


def _counted(segments: int):
    """Counts of words and pairs, a row for each kind and segment met."""
    shift = U(64 - segments.bit_length() + 1)

    def rows(kind: int, grams: np.ndarray, other: np.ndarray | None, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Batches of about ``SENT`` bytes, as the executor holds each beside the worker."""
        cut, held, size = np.searchsorted(segment_of(grams, shift), np.arange(segments + 1)), [], 0
        for s in np.flatnonzero(np.diff(cut)):
            a, b = cut[s], cut[s + 1]
            held.append((kind, int(s), _bytes(grams[a:b]), b"" if other is None else _bytes(other[a:b]), _bytes(counts[a:b].astype(np.int32)), 0))
            size += 20 * int(b - a)
            if size >= SENT:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def flush(held: list[list[np.ndarray]], texts: int) -> Iterator[pa.RecordBatch]:
        """Takes the parts out of ``held``, so that each is held once."""
        one, two, both = held
        pairs, m = summed(_joined(both))
        yield from rows(PAIR, pairs, None, m)
        del pairs, m
        words, first, n = np.unique(_joined(one), return_index=True, return_counts=True)
        yield from rows(WORD, words, _joined(two)[first], n)
        yield _batch([(0, 0, b"", b"", b"", texts)])
        del words, first, n
        give_back()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = ([], [], []), 0, 0
        for batch in text_slices(batches, "text", SLICE):
            t = Tokens(batch.column("text"))
            for part, x in zip(held, (t.hash, t.hash2, t.pairs())):
                part.append(x)
            size, texts = size + len(t.hash), texts + batch.num_rows
            del t, x
            if size >= FLUSH:
                yield from flush(held, texts)
                size, texts = 0, 0
        if held[0]:
            yield from flush(held, texts)
        give_back()

    return scan


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; ``parts`` is empty afterwards."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in zip(*rows)], schema=_COUNTED)


_COUNTED = pa.schema([("kind", pa.int32()), ("segment", pa.int32()), ("grams", pa.binary()), ("grams2", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64())])
MERGED = "kind int, segment int, texts long, types long, tokens long, levels binary, slab binary, bytes long, grams binary, grams2 binary, counts binary"


def _merged(most_word_bits: int, most_pair_bits: int):
    """One segment: exact counts of its words, and its part of the filter."""

    def merge(table: pa.Table) -> pa.Table:
        kind, segment = table.column("kind")[0].as_py(), table.column("segment")[0].as_py()
        join = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t)
        grams, counts = join("grams", U), join("counts", np.int32).astype(np.int64)
        second = np.empty(0, U)
        if kind == WORD:
            order = np.lexsort((join("grams2", U), grams))
            grams, second, counts = grams[order], join("grams2", U)[order], counts[order]
            edge = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (second[1:] != second[:-1])]))
            grams, second, counts = grams[edge], second[edge], np.add.reduceat(counts, edge)
        elif kind == PAIR:
            grams, counts = summed(grams, counts)
        bits = slab(grams, counts, most_word_bits if kind == WORD else most_pair_bits).tobytes()
        own = kind == WORD
        row = (kind, segment, sum(table.column("texts").to_pylist()), len(grams), int(counts.sum()) if own else 0, _bytes(np.bincount(level_of(counts), minlength=len(MEAN)).astype(np.int64)) if own else b"", bits, len(bits), _bytes(grams) if own else b"", _bytes(second) if own else b"", _bytes(counts) if own else b"")
        del grams, second, counts
        give_back()
        return pa.table([[x] for x in row], schema=_MERGED)

    return merge


_MERGED = pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in MERGED.split(", "))])
FLAT = "h1 long, h2 long, c long"


def _exact(least: int, head: bool):
    """The words of at least (``head``) or under a level, with their counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, c in zip(*(batch.column(x) for x in ("grams", "grams2", "counts"))):
                one, two, c = np.frombuffer(one.as_py(), np.int64), np.frombuffer(two.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                at = (level_of(c) >= least) == head
                yield pa.record_batch([pa.array(one[at]), pa.array(two[at]), pa.array(c[at])], ["h1", "h2", "c"])
        give_back()

    return scan


class Model:
    """What scoring needs besides pairs: the words' filter, the exact counts of
    frequent words (sorted by hash), and the totals."""

    def __init__(self, words: Filter, head: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: int, types: int, texts: int):
        self.words, self.head, self.tokens, self.types, self.texts = words, head, tokens, types, texts

    @property
    def below(self) -> float:
        return self.tokens + 0.1 * (self.types + 1)

    def exact(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        grams, second, counts = self.head
        if not len(grams):
            return np.zeros(len(one), np.int64)
        at = np.minimum(np.searchsorted(grams, one), len(grams) - 1)
        return np.where((grams[at] == one) & (second[at] == two), counts[at], 0)


def log_probabilities(tokens: Tokens, model: Model, pairs: Filter) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(w | v) of each token whose pair lies in ``pairs``' segments, and
    where those are."""
    words, back = np.unique(tokens.hash, return_inverse=True)
    of_word = model.words.levels(words, np.full(len(words), len(MEAN) - 1))[back]
    of_before = np.concatenate([of_word[:1], of_word[:-1]])
    of_before[tokens.before == START] = level_of(np.array([model.texts]))[0] if model.texts else 0
    grams = tokens.pairs()
    most = np.minimum(of_word, of_before)
    distinct, first, again = np.unique(grams, return_index=True, return_inverse=True)
    found = pairs.levels(distinct, most[first])[again]
    word, before = MEAN[of_word], MEAN[of_before]
    both = np.minimum(MEAN[found], np.minimum(word, before))
    p = (both + PRIOR * (word + 0.1) / model.below) / (before + PRIOR)
    return np.log10(p), pairs.here[pairs.segment(grams)]


SCORED = "row long, doc_id long, mark binary, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<h1:long,h2:long,n:long>>"


def _scored(model, pairs, first: bool):
    """Scores of one slice; ``first`` adds what does not depend on slices."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part = model.value, pairs.value
        for batch in text_slices(batches, "text", SLICE):
            t = Tokens(batch.column("text"))
            n = batch.num_rows
            logs, here = log_probabilities(t, m, part)
            score = np.bincount(t.of[here], weights=logs[here], minlength=n)
            marks = pa.array([xxhash.xxh3_128_digest(x.as_buffer() if x.is_valid else b"") for x in batch.column("text").cast(pa.large_binary())], pa.binary())
            if not first:
                yield pa.record_batch([batch.column("doc_id"), marks, pa.array(score)], ["doc_id", "mark", "score"])
                continue
            c = m.exact(t.hash, t.hash2)
            base = np.bincount(t.of, weights=np.where(c > 0, np.log10((c + 0.1) / m.below), 0.0), minlength=n)
            rare = np.flatnonzero(c == 0)
            order = rare[np.lexsort((t.hash2[rare], t.hash[rare], t.of[rare]))]
            of, one, two = t.of[order], t.hash[order], t.hash2[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(of) else np.empty(0, bool)
            edge = np.flatnonzero(new)
            values = pa.StructArray.from_arrays([pa.array(one[edge].view(np.int64)), pa.array(two[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(of))))], ["h1", "h2", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[edge], np.arange(n + 1)).astype(np.int32)), values)
            known = np.bincount(t.of, weights=c > 0, minlength=n).astype(np.int64)
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), marks, batch.column("held_out"), pa.array(t.count), pa.array(known), pa.array(base), pa.array(score), tail], [x.split()[0] for x in SCORED.split(", ")[:8]] + ["tail"])
        give_back()

    return scan


class PairFilter(Filter):
    """A slice: ``here`` tells which segments it answers for."""

    def __init__(self, segments: int, sizes: dict[int, int], parts: Iterable[tuple[int, bytes]], of: list[int]):
        super().__init__(segments, sizes, parts)
        self.here = np.zeros(segments, bool)
        self.here[of] = True


def slices_of(sizes: dict[int, int], segments: int, most: int) -> list[list[int]]:
    """Consecutive segments in runs of at most ``most`` bytes."""
    out, total = [[]], 0
    for s in range(segments):
        if out[-1] and total + sizes.get(s, 0) > most:
            out.append([])
            total = 0
        out[-1].append(s)
        total += sizes.get(s, 0)
    return out


def lm_scores(docs: DataFrame, most_bytes: int = MOST_BYTES, word_bytes: int = WORD_BYTES, head: int = HEAD, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op11")
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.filter("NOT held_out").select("text")
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 64
    while segments * segment_bytes < size:
        segments *= 2
    counted = training.mapInArrow(_counted(segments), COUNTED)
    merged = counted.groupBy("kind", "segment").applyInArrow(_merged(8 * word_bytes // segments, 8 * most_bytes), MERGED)
    merged = scratch.stage(merged, "counts")
    words, pairs = merged.filter(f"kind = {WORD}"), merged.filter(f"kind = {PAIR}")
    texts = merged.agg(F.sum("texts")).first()[0] or 0
    # a row for each segment, of a few numbers
    heads = words.select("types", "tokens", "levels").toArrow()
    levels = np.sum([np.frombuffer(x.as_py(), np.int64) for x in heads.column("levels")] or [np.zeros(len(MEAN), np.int64)], axis=0)
    at_least = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(at_least <= head)) if (at_least <= head).any() else len(levels)
    flat = words.select("grams", "grams2", "counts")
    top = flat.mapInArrow(_exact(least, True), FLAT).toArrow()
    one, two, c = (top.column(k).to_numpy() for k in ("h1", "h2", "c"))
    order = np.argsort(one.view(U), kind="stable")
    sizes = {(r.kind, r.segment): r.bytes for r in merged.select("kind", "segment", "bytes").collect()}
    # part by part, so that the driver holds a filter once
    slabs = lambda df: ((r.segment, r.slab) for r in df.select("segment", "slab").toLocalIterator())
    model = Model(
        Filter(segments, {s: n for (k, s), n in sizes.items() if k == WORD}, slabs(words)),
        (one.view(U)[order], two.view(U)[order], c[order]),
        sum(heads.column("tokens").to_pylist()),
        sum(heads.column("types").to_pylist()),
        texts,
    )
    shared = spark.sparkContext.broadcast(model)
    sizes = {s: n for (k, s), n in sizes.items() if k == PAIR}
    found = scored = None
    for k, of in enumerate(slices_of(sizes, segments, most_bytes)):
        held = {s: n for s, n in sizes.items() if of[0] <= s <= of[-1]}
        part = spark.sparkContext.broadcast(PairFilter(segments, held, slabs(pairs.filter(F.col("segment").between(of[0], of[-1]))), of))
        if k == 0:
            source = rows.withColumn("row", F.monotonically_increasing_id())
            scored = scratch.stage(source.mapInArrow(_scored(shared, part, True), SCORED), "scored")
        else:
            more = rows.select("doc_id", "text").mapInArrow(_scored(shared, part, False), "doc_id long, mark binary, score double").dropDuplicates(["doc_id", "mark"])
            more = scratch.stage(more, "slice").select("doc_id", "mark", F.col("score").alias("more"))
            keyed = lambda df: F.struct(df["doc_id"].isNull(), F.coalesce(df["doc_id"], F.lit(0)), df["mark"])
            found = scored if found is None else found
            found = found.withColumn("key", keyed(found)).join(more.select(keyed(more).alias("key"), "more"), "key").withColumn("score", F.col("score") + F.col("more")).drop("key", "more")
            found = scratch.stage(found, "scored")
        part.unpersist()
    found = scored if found is None else found
    rest = flat.mapInArrow(_exact(least, False), FLAT)
    rest = scratch.stage(rest, "rare")  # a join can split hot keys only of what it reads
    scratch.drop("counts")
    tail = found.select("row", F.explode("tail").alias("x")).select("row", "x.h1", "x.h2", "x.n").join(rest, ["h1", "h2"], "left")
    term = f"x.n * log10((x.c + 0.1D) / {model.below!r}D)"
    unseen = F.expr(f"coalesce(sum(CASE WHEN c IS NULL THEN n END), 0) * log10(0.1D / {model.below!r}D)")
    # the seen ones in the order of their counts, so that reruns add in one order
    tails = tail.groupBy("row").agg(F.expr("coalesce(sum(CASE WHEN c IS NOT NULL THEN n END), 0)").alias("tail_known"), unseen.alias("tail_unseen"), F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "n")))).alias("seen"))
    tails = tails.select("row", "tail_known", (F.col("tail_unseen") + F.expr(f"aggregate(seen, 0D, (s, x) -> s + {term})")).alias("tail_base"))
    return found.drop("tail").join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
