"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Signature: each distinct run of five words starts a Poisson process at the rate
of its weight. An arrival picks one of ``m`` registers, which keeps the element
whose arrival came first; a text's processes end as soon as the next arrival is
later than every register. Equal registers of two texts estimate their
probability Jaccard. With equal weights that is the Jaccard similarity of the
sets, by which classes are made. A text that has some runs more often than
others gets a second signature, weighted by how often it has each.

Banding: registers in ``bands`` groups of ``rows``; texts that agree on a group
of any signature share a bucket. In each bucket every text is compared with the bucket's hub,
the text whose buckets are the largest in sum, so the work grows with the
bucket, not with its square. Where a bucket still holds several classes, the
texts concerned go through exact filters (see ``_rest``) that propose every pair
that can reach the threshold and few others: rare shingles in common, for texts
of one hub those that the hub has not. What both steps propose is verified by
the exact Jaccard similarity of shingle sets (0.8 or more); connected texts form
a class.

One measure decides: the Jaccard similarity of shingle sets. The signatures of
sets estimate it and bound what banding may miss; those weighted by counts add
candidates, texts that agree in what they repeat. Shingles are compared by 64
bits (see ``wordhash``), texts by 128 bits of SHA-256.

Texts of equal words are one node from the start. Defined results: a text under
five words is one shingle of all its words; texts without a word are copies of
each other; a null text is a class of its own; rows repeated with one doc_id
get the same class if their words are equal; class_id is the least doc_id of
the class (null where all are null); extra columns are ignored, whatever their
names; a text of any length is taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import BLANKS, Scratch, maybe_in, split_by, text_slices
from quarrylight.llm.wordhash import Words, mix, runs, text_buffer

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
U = np.uint64


def shingles(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, ascending, and their counts."""
    n = len(words)
    if n == 0:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.unique(runs(words, min(k, n)), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers: the element that arrives first at each. of[i] is the
    text of elements[i]; a text without elements keeps zeros."""
    first = np.full(n * m, np.inf)
    held = np.zeros(n * m, U)
    clock = np.zeros(len(elements))
    live, step = np.arange(len(elements)), 0
    while len(live):
        block = int(np.clip(32768 // len(live), 1, 64))
        steps = np.arange(step, step + block, dtype=U)
        seeds = mix(elements[live])[:, None] + steps * U(0x9E3779B97F4A7C15)
        times = clock[live][:, None] + np.cumsum(-np.log(_uniform(seeds)) / weights[live][:, None], axis=1)
        slots = of[live][:, None] * m + (mix(seeds ^ U(0xA5A5A5A5DEADBEEF)) % U(m)).astype(np.int64)
        t, s = times.ravel(), slots.ravel()
        np.minimum.at(first, s, t)
        won = np.flatnonzero(first[s] == t)
        held[s[won]] = np.repeat(elements[live], block)[won]
        clock[live] = times[:, -1]
        last = first.reshape(n, m).max(axis=1)
        live = live[clock[live] < last[of[live]]]
        step += block
    return held.reshape(n, m)


def _buckets(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands keys, each of a band's number and its registers."""
    held = signatures(elements, weights, of, n, bands * rows).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (n, bands)).copy()
    for r in range(rows):
        key = mix(key + held[:, :, r])
    return key


def _sign(k: int, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            raw, off = text_buffer(batch.column("text"))
            words, n = Words(raw, off, shas=True), batch.num_rows
            parts = [shingles(words.hash[words.off[i] : words.off[i + 1]], k) for i in range(n)]
            elements, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            of = np.repeat(np.arange(n), [len(p[0]) for p in parts])
            sets = _buckets(elements, np.ones(len(elements)), of, n, bands, rows)
            some = np.diff(words.off) > 0
            keys = [sets[i] if some[i] else np.empty(0, U) for i in range(n)]
            # equal counts lead to the same registers as no counts
            uneven = np.flatnonzero([len(p[1]) > 0 and p[1].min() < p[1].max() for p in parts])
            if len(uneven):
                at = np.full(n, -1)
                at[uneven] = np.arange(len(uneven))
                mine = at[of] >= 0
                weighted = _buckets(elements[mine], counts[mine].astype(np.float64), at[of[mine]], len(uneven), bands, rows)
                for i, more in zip(uneven, weighted):
                    keys[i] = np.unique(np.concatenate([keys[i], more]))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            null = batch.column("text").is_null().to_pylist()
            digests = [None if null[i] else words.shas[i][:16] for i in range(n)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(p[0]) for p in parts], pa.int64()), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(keys).view(np.int64)))],
                ["doc_id", "digest", "n", "bands"],
            )

    return scan


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        shas = Words(*text_buffer(batch.column("text")), shas=True).shas
        yield pa.record_batch([pa.array([x[:16] for x in shas], pa.binary()), batch.column("text")], ["digest", "text"])


def _one(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingles(Words(raw, np.array([0, len(raw)])).hash, k)[0]


def _compare(k: int):
    """Sizes of two texts' shingle sets and of what they share; the hub's weight travels along."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(digest: bytes, text: str) -> np.ndarray:
            if digest not in cache:
                cache[digest] = _one(text, k)
                while len(cache) > 64:
                    cache.popitem(last=False)
            return cache[digest]

        for batch in batches:
            a, b, s, t = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            out = []
            for i in range(batch.num_rows):
                x, y = of(a[i].as_py(), s[i].as_py()), of(b[i].as_py(), t[i].as_py())
                out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pa.record_batch([batch.column("weight"), a, b, *(pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [])))], ["weight", "a", "b", "na", "nb", "shared"])

    return scan


def _grams(k: int):
    """(num, gram, of_hub): a text's shingles, and whether its hub has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes | None, np.ndarray] = (None, np.empty(0, U))
        for whole in batches:
            for batch in text_slices(iter([whole]), "text"):
                nums, out = batch.column("num").to_pylist(), []
                for num, text, family, hub in zip(nums, batch.column("text"), batch.column("family"), batch.column("hub_text")):
                    family = family.as_py()
                    if held[0] != family:  # rows come sorted by family from the join
                        held = (family, _one(hub.as_py(), k))
                    own = _one(text.as_py(), k)
                    out.append((np.full(len(own), num), own.view(np.int64), np.isin(own, held[1], assume_unique=True)))
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["num", "gram", "of_hub"])

    return scan


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, comp): the least node reachable over ``edges``, by alternating
    large-star and small-star steps, each staged in the shared folder. They end
    when every node has only larger neighbours or a single one: then each
    component is a star about its least node."""
    scratch = scratch or Scratch(edges.sparkSession, "stars")
    now, step = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v"), 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.stage(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), f"low-{step}")
        least = low.select("u", F.least("u", "lo").alias("w"))
        if low.filter("lo < u AND lo != hi").isEmpty():
            scratch.drop(str(step))
            return least.select(F.col("u").alias("node"), F.col("w").alias("comp"))
        large = now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("w").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("w"))
        moved = large.join(small, "u").filter("v != w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        now = scratch.stage(moved.unionByName(small.withColumnRenamed("w", "v")).distinct(), str(step + 1))
        scratch.drop(f"low-{step}", str(step))
        step += 1


def _meet(scratch: Scratch, rows: DataFrame, key: list[str], apart: str, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, digest, comp, n) that share a key, differ in
    ``apart`` and in comp, and are near enough in size. Of a key's holders, those
    of its most frequent ``apart`` meet the others only."""
    major = rows.groupBy(*key, apart).agg(F.count("*").alias("c")).groupBy(*key).agg(F.max(F.struct("c", apart)).alias("x"), F.count("*").alias("kinds"))
    major = scratch.stage(major.filter("kinds > 1").select(*key, F.col(f"x.{apart}").alias("major")), "major")
    # staged, so that both sides of the next join are read and a hot key is split
    rows = scratch.stage(rows.withColumn("part", F.col(apart)).join(major, key), "meet")
    left = rows.select(*key, F.col("digest").alias("a"), F.col("comp").alias("ca"), F.col("part").alias("pa"), F.col("n").alias("na"))
    right = rows.filter("part != major").select(*key, F.col("digest").alias("b"), F.col("comp").alias("cb"), F.col("part").alias("pb"), F.col("n").alias("nb"))
    found = left.join(right, key).filter(f"pa != pb AND ca != cb AND na >= {threshold}D * nb AND nb >= {threshold}D * na")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _rest(scratch: Scratch, own: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of different classes that may still reach ``threshold``, exactly:
    none that can is left out. ``own``: (digest, num, comp, family, na, n,
    shared), with na the shingles of the family's hub, n the text's and shared both's.

    Any pair that reaches it has, with t = threshold / (1 + threshold), at least
    t (n_i + n_j) shingles in common, so under any one order of shingles the
    least that they share is within the first n - ceil(threshold n) + 1 of each.
    * Of different families: the order is by rising frequency.
    * Of one family with hub M: what they share within M is at most the smaller
      of their overlaps with M. If that falls short, they share a shingle that M
      has not; with those ordered first, it is within both prefixes. If not,
      min(shared_i, shared_j) >= t (n_i + n_j), which bounds n_j from n_i and
      shared_i, and one of the two is not linked to M."""
    t = threshold / (1 + threshold)
    mine = texts.join(own.select("digest", "family", "num"), "digest").select("num", "family", "text")
    hub_texts = scratch.stage(texts.join(own.select(F.col("family").alias("digest")).distinct(), "digest", "left_semi").select(F.col("digest").alias("family"), F.col("text").alias("hub_text")), "hub-texts")
    grams = scratch.stage(mine.join(hub_texts, "family").mapInArrow(_grams(k), "num long, gram long, of_hub boolean"), "grams")
    counts = scratch.stage(grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    ranked = grams.join(counts, "gram", "left").select("num", F.struct(F.coalesce("df", F.lit(1)).cast("int").alias("df"), "gram", "of_hub").alias("x"))
    lists = ranked.groupBy("num").agg(F.sort_array(F.collect_list("x")).alias("all"))
    first = f"cast(size(all) - ceil({threshold}D * size(all) - 0.000001D) + 1 AS int)"
    rare = lists.select("num", F.expr(f"filter(slice(all, 1, {first}), x -> x.df > 1)").alias("across"), F.expr(f"filter(slice(filter(all, x -> NOT x.of_hub), 1, {first}), x -> x.df > 1)").alias("within"))
    rare = scratch.stage(rare.filter("size(across) + size(within) > 0").join(own.select("num", "digest", "comp", "family", "n"), "num"), "rare")
    scratch.drop("hub-texts", "grams", "counts")
    keep = ["digest", "comp", "family", "n"]
    across = rare.select(*keep, F.explode("across").alias("x")).select(*keep, F.col("x.gram").alias("gram"))
    within = rare.select(*keep, F.explode("within").alias("x")).select(*keep, F.col("x.gram").alias("gram"))
    one = _meet(scratch, across, ["gram"], "family", threshold)
    two = _meet(scratch, within, ["family", "gram"], "comp", threshold)
    stray = own.filter(f"shared IS NOT NULL AND shared < {threshold}D * (na + n - shared)")
    low, high = f"cast(ceil({threshold}D * n - 0.000001D) AS long)", f"cast(least(floor(shared / {t}D + 0.000001D) - n, floor(n / {threshold}D)) AS long)"
    stray = stray.filter(f"{high} >= {low}").select("family", F.col("digest").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.explode(F.expr(f"sequence({low}, {high})")).alias("n"))
    mates = own.filter("shared IS NOT NULL").select("family", "n", F.col("digest").alias("b"), F.col("comp").alias("cb"), F.col("shared").alias("sb"))
    three = stray.join(mates, ["family", "n"]).filter(f"ca != cb AND sb >= {t}D * (na + n) - 0.000001D").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return one.unionByName(two).unionByName(three).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest (of its words, null for a
    null text), class_id, n_links (verified links of its text to others), first
    (whether its text is the one that stays for its class)."""
    scratch = Scratch(docs.sparkSession, "op4")
    stage = scratch.stage
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_sign(k, bands, rows), "doc_id long, digest binary, n long, bands array<long>"), "signed")
    ids = stage(signed.select("doc_id", "digest"), "ids")
    banded = stage(signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "banded")
    scratch.drop("signed")
    nodes = stage(banded.select("digest", "least", "n"), "nodes")
    flat = banded.select("digest", "least", "n", F.explode("bands").alias("bucket"))
    # what a join takes from an aggregate is staged first: only then can the join split hot keys
    sizes = stage(flat.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    # most buckets hold one text; a bounded bitmap keeps those from the shuffle
    multi = stage(maybe_in(flat, "bucket", sizes, "bucket", sizes.count()).join(sizes, "bucket"), "buckets")
    scratch.drop("banded", "sizes")
    # a text has at most 2 * bands rows here, so a window over it holds few
    of_text = Window.partitionBy("digest")
    weighed = stage(multi.select("bucket", "digest", "least", "n", F.sum("size").over(of_text).alias("weight"), (F.min("bucket").over(of_text) == F.col("bucket")).alias("lead")), "weighed")
    scratch.drop("buckets")
    hubs = stage(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "digest", "n")).alias("hub")), "hubs")
    # sizes that differ by more than the threshold allows rule a pair out; a little below it the overlap still serves
    near_size = f"n >= {0.9 * threshold}D * hub.n AND hub.n >= {0.9 * threshold}D * n"
    tried = weighed.join(hubs, "bucket").filter("hub.digest != digest").filter(near_size).select("hub.weight", F.col("hub.digest").alias("a"), F.col("digest").alias("b"))
    tried = stage(tried.distinct(), "tried")
    scratch.drop("hubs")

    wanted = weighed.filter("lead").select("digest", "least")  # a row for each text
    near = maybe_in(docs.filter("text IS NOT NULL"), "doc_id", wanted, "least", wanted.count())
    texts = stage(near.mapInArrow(_digest, "digest binary, text string").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "texts")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        # both sides of the join on the hub are read from tables, so that a hub of many texts is split
        some = stage(texts.join(pairs.select(F.col("a").alias("digest")).distinct(), "digest", "left_semi"), "compared")
        left, right = some.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
        found = pairs.join(right, "b").join(left, "a").select("weight", "a", "b", "text_a", "text_b").mapInArrow(_compare(k), "weight long, a binary, b binary, na long, nb long, shared long")
        found = stage(found, name)
        scratch.drop("compared")
        return found

    near_enough = f"shared >= {threshold}D * (na + nb - shared)"
    checked = compared(tried, "checked")
    links = checked.filter(near_enough).select("a", "b")
    stars = [Scratch(docs.sparkSession, "stars") for _ in range(2)]
    comps = components(links, scratch=stars[0])
    labelled = stage(weighed.select("bucket", "digest", "n").join(comps, F.col("digest") == F.col("node"), "left").select("bucket", "digest", "n", F.coalesce("comp", "digest").alias("comp")), "labelled")
    scratch.drop("weighed", "tried")
    mixed = stage(labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("bucket"), "mixed")
    open_texts = labelled.join(mixed, "bucket", "left_semi").select("digest", "comp", "n").dropDuplicates(["digest"])
    # the family of a text: the heaviest hub that it was compared with, or itself
    heaviest = checked.groupBy("b").agg(F.max(F.struct("weight", "a", "na", "shared")).alias("x")).select(F.col("b").alias("digest"), F.col("x.a").alias("family"), "x.na", "x.shared")
    own = open_texts.join(heaviest, "digest", "left").withColumn("family", F.coalesce("family", "digest"))
    own = stage(own.select("digest", "comp", "family", "na", "n", "shared", F.monotonically_increasing_id().alias("num")), "open")
    scratch.drop("labelled", "mixed")
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _rest(scratch, own, texts, k, threshold).join(done, ["a", "b"], "left_anti").select(F.lit(0).cast("long").alias("weight"), "a", "b")
    more = stage(more, "more")
    scratch.drop("rare", "major", "meet", "open")
    extra = compared(more, "extra").filter(near_enough).select("a", "b")
    scratch.drop("texts", "more")
    if extra.isEmpty():
        final = comps
    else:
        links = links.unionByName(extra)
        # the classes so far are stars already, so few steps are left
        final = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(extra), scratch=stars[1])
    degree = links.select(F.col("a").alias("digest")).unionByName(links.select(F.col("b").alias("digest"))).groupBy("digest").agg(F.count("*").alias("n_links"))
    named = nodes.select("digest", "least").join(final, F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("comp", "digest").alias("comp"))
    named = stage(named, "named")
    best = named.groupBy("comp").agg(F.min("least").alias("class_id"), F.min(F.struct(F.expr("least IS NULL"), "least", "digest")).alias("x")).select("comp", "class_id", F.col("x.digest").alias("stays"))
    best = stage(best, "best")
    classes = named.join(best, "comp").join(degree, "digest", "left")
    classes = stage(classes.select("digest", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.expr("digest = stays").alias("first")), "classes")
    scratch.drop("named", "best", "checked", "extra", "nodes")
    for x in stars:
        x.drop(*list(x.paths))
    out = ids.join(classes, "digest", "left")
    return out.select("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", F.lit(True)).alias("first"))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. Rows with
    a null text stay."""
    scratch = Scratch(docs.sparkSession, "op4")
    classes = scratch.stage(near_duplicates(docs, **settings).select("doc_id", "digest", F.expr("first AND (digest IS NULL OR doc_id <=> class_id)").alias("stays")), "rows")
    gone = scratch.stage(classes.filter("NOT stays").select(F.col("doc_id").alias("id"), F.coalesce("digest", F.lit(b"")).alias("of")).distinct(), "gone")
    repeated = classes.filter("stays AND digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    scratch.drop("rows")
    # the columns of docs travel in one struct, so that none can clash with those of the join
    whole = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    words = F.regexp_replace(F.btrim(F.col("row.text").cast("string"), F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    own = F.coalesce(F.unhex(F.substring(F.sha2(words, 256), 1, 32)), F.lit(b""))
    # most rows surely stay; only those whose doc_id may go take part in the join
    may, never = split_by(whole, "key", gone, "id", gone.count())
    may = may.withColumn("own", own)
    kept = never.unionByName(may.join(gone, may["key"].eqNullSafe(gone["id"]) & (may["own"] == gone["of"]), "left_anti").select("key", "row"))
    if repeated:
        kept = kept.withColumn("own", own)
        kept = kept.filter("row.text IS NOT NULL").dropDuplicates(["key", "own"]).unionByName(kept.filter("row.text IS NULL"))
    return kept.select("row.*")
