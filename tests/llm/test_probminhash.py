import random
import re

import numpy as np

from quarrylight.llm.probminhash import components, deduplicated, near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def brute(rows, threshold=0.8):
    sets = [None if t is None else shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows)) if rows[i][0] is not None)


def made(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, d = [], 0
    for size in (40, 25, 6, 3, 2):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        rows.append((d, " ".join(base)))
        d += 1
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((d, " ".join(w)))
            d += 1
    for _ in range(60):
        rows.append((d, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(20, 200))])))
        d += 1
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rows = made(3)
    rows += [(900, ""), (901, " \n"), (902, None), (903, "one two"), (904, "one  two\n"), (905, "one three"), (906, None), (rows[0][0], rows[0][1]), (None, rows[0][1]), (907, "z " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "a": F.lit("q"), "comp": F.lit(0)})
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == brute(rows)
    assert len(got) == len(rows)
    kept = deduplicated(df).collect()
    expected = {c for _, c in brute(rows)}
    assert sorted(r.doc_id for r in kept) == sorted(expected)
    assert len(kept[0]) == 5


def test_copies_that_repeat_a_line(spark):
    """The sets agree by 0.98, the counts by less than a half."""
    rng = random.Random(11)
    rows = []
    for d in range(0, 60, 2):
        words = [f"v{rng.randrange(5000)}" for _ in range(300)]
        at = rng.randrange(280)
        rows += [(d, " ".join(words)), (d + 1, " ".join(words[: at + 12] + words[at : at + 12] * 30 + words[at + 12 :]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows) == [(d, d - d % 2) for d in range(60)]


def test_one_word_a_thousand_times_and_thue_morse(spark):
    """Set Jaccard 0.975 and more, probability Jaccard near nothing; and two
    wholly different texts of words whose polynomial hashes are equal."""
    rng = random.Random(4)
    rows = []
    for d in range(0, 80, 2):
        words = [f"v{rng.randrange(9000)}" for _ in range(200)]
        rows += [(d, " ".join(words)), (d + 1, " ".join(words + ["again"] * 1000))]
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows += [(90, " ".join(f"{one}{i}" for i in range(20))), (91, " ".join(f"{two}{i}" for i in range(20)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows) == [(d, d - d % 2) for d in range(80)] + [(90, 90), (91, 91)]


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = made(5)[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("id", "of", "own", "key", "row", "_doc", "_bw", "_hit", "first")})
    kept = deduplicated(df)
    assert kept.columns == df.columns
    out = kept.collect()
    assert {r.doc_id for r in out} == {c for _, c in brute(rows)} and all(r["key"] == r["row"] == 3 for r in out)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == [] and deduplicated(empty).collect() == []


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(100, 300)
    wa, wb = rng.integers(1, 5, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    held = signatures(np.concatenate([x[a], x[b]]), np.concatenate([wa, wb]), np.repeat([0, 1], 200), 2, 4096)
    pa, pb = dict(zip(a, wa)), dict(zip(b, wb))
    true = sum(1 / sum(max(pa.get(j, 0) / pa[i], pb.get(j, 0) / pb[i]) for j in range(300)) for i in range(100, 200))
    assert abs((held[0] == held[1]).mean() - true) < 0.03


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_star_ends_without_a_round_to_confirm_it(spark, monkeypatch):
    from quarrylight.llm.common import Scratch

    written, stage = [], Scratch.stage
    monkeypatch.setattr(Scratch, "stage", lambda self, df, name: written.append(name) or stage(self, df, name))
    edges = spark.createDataFrame([(50, i) for i in range(100) if i != 50], "a long, b long")
    assert {(r.node, r.comp) for r in components(edges).collect()} == {(i, 0) for i in range(100)}
    assert len(written) <= 3
