import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarrylight.llm import lm_scoring as lm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def plain(rows, prior=lm.PRIOR):
    """The contract and the docstring in words, with dictionaries."""
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    words, pairs, texts = collections.Counter(), collections.Counter(), 0
    for (_, t), h in zip(rows, held):
        if not h:
            w = tokens(t)
            words.update(w)
            pairs.update(zip([0, *w], w))
            texts += 1
    n, v = sum(words.values()), len(words)
    below = n + 0.1 * (v + 1)
    mean = lambda c: float(lm.MEAN[int(lm.level_of(np.array([c]))[0])]) if c else 0.0
    for (d, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10((words[x] + 0.1) / below) for x in w)
        score = 0.0
        for a, b in zip([0, *w], w):
            before = mean(texts if a == 0 else words[a])
            both = min(mean(pairs[a, b]), before, mean(words[b]))
            score += math.log10((both + prior * (mean(words[b]) + 0.1) / below) / (before + prior))
        yield d, h, len(w), sum(words[x] > 0 for x in w), n, base, score


def made(seed=0, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "a", "Ünit", f"w{int(rng.paretovariate(0.7)) % 4000}", "x" * 40 + str(rng.randint(0, 3))])
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    long = " ".join(f"q{i % 5000}" for i in range(60_000))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "the a the"), (3, rows[3][1]), (n + 3, long), (n + 4, long), (n + 5, "z\u00a0z \u2003 end")]


@pytest.mark.parametrize("options", [{}, {"head": 7}, {"head": 0, "most_bytes": 6000, "segment_bytes": 4096}])
def test_equals_a_plain_model_in_any_number_of_slices(spark, options):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS mark", "3 AS score", "4 AS held_out").repartition(5)
    got = sorted((tuple(r) for r in lm.lm_scores(df, **options).collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-7 for g, w in zip(got, want))
    # a false positive raises a count: rare, and so the sums are near
    off = sum(abs(g[6] - w[6]) > 1e-6 for g, w in zip(got, want))
    assert off < len(rows) / 4 and abs(sum(g[6] for g in got) / sum(w[6] for w in want) - 1) < 1e-3
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_filter_never_reads_too_low_and_seldom_too_high():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) << np.uint64(1))
    counts = np.minimum(rng.zipf(1.5, len(grams)), 1 << 40)
    part = lm.slab(grams, counts, 1 << 31).tobytes()
    held = lm.Filter(1, {0: len(part)}, [(0, part)])
    most = np.full(len(grams), len(lm.MEAN) - 1)
    read, true = held.levels(grams, most), lm.level_of(counts)
    assert (read >= true).all() and (read > true).mean() < 0.005
    assert (held.levels(grams + np.uint64(1), most) > 0).mean() < 0.005
    assert (held.levels(grams, np.minimum(most, 1)) == 1).all()


def test_levels():
    assert lm.level_of(np.array([1, 2, 3, 4, 5, 6])).tolist() == [1, 2, 3, 4, 4, 5] and lm.MEAN[:5].tolist() == [0, 1, 2, 3, 4.5]
    assert lm.slices_of({0: 5, 1: 5, 3: 12}, 4, 10) == [[0, 1, 2], [3]]


def test_no_training_and_empty(spark):
    got = lm.lm_scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_counts_leave_in_small_batches():
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(400000))
    batch = pa.record_batch([pa.array([text[a : a + 100000] for a in range(0, len(text), 100000)])], ["text"])
    sent = list(lm._counted(64)(iter([batch])))
    assert max(x.nbytes for x in sent) < 2 * lm.SENT < sum(x.nbytes for x in sent)
    assert sum(x for b in sent for x in b.column("texts").to_pylist()) == batch.num_rows
    counted = {k: sum(np.frombuffer(c, np.int32).sum() for b in sent for j, c in zip(b.column("kind").to_pylist(), b.column("counts").to_pylist()) if j == k) for k in (lm.WORD, lm.PAIR)}
    n = sum(len(lm.Tokens(batch.column("text").slice(i, 1)).hash) for i in range(batch.num_rows))
    assert counted == {lm.WORD: n, lm.PAIR: n}
