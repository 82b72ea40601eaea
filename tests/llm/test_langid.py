import math
import random

import numpy as np

from quarrylight.llm import langid
from quarrylight.llm.langid import counts, fit_temperature, predict_languages, remainder, train_ftrl, vector

TONGUES = {"aa": ["kor", "tun", "bel", "mak"], "bb": ["ése", "ill", "oua", "eau"], "cc": ["ßer", "ung", "sch", "äch"]}


def made(n):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        words = ["".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words) + ".", lang if i % 9 else None))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    rows = made(900)
    odd = [(2000, None, "aa"), (2001, "123 --- !", "bb"), (2002, "", "cc"), (None, "kortun bel", "aa"), (3, rows[3][1], "aa"), (2003, "eau " * 300000, "bb")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS fold", "1 AS place", "2 AS held_out")
    got = predict_languages(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for d in (2000, 2001, 2002):
        assert by[d].lang_pred == "und" and by[d].score == 0.0
    true = {i: next(k for k, v in TONGUES.items() if any(t.startswith(x) for x in v)) for i, t, _ in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if remainder(i) == 2}
    right = np.mean([r.lang_pred == true[r.doc_id] for r in held])
    assert right > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert abs(np.mean([r.score for r in held]) - right) < 0.05


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in predict_languages(df).collect()} == {("und", 0.0)}
    assert predict_languages(df.limit(0)).collect() == []


def test_counts_and_temperature():
    assert counts("abcab").sum() == 5 + 4 + 3
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = (rng.random(4000)[:, None] > p.cumsum(1)).sum(1)
    assert abs(fit_temperature(5 * z, y) - 5) < 0.5


def plain_ftrl(rows, n_classes, buckets, epochs):
    """Coordinate by coordinate, from the closed form of each weight."""
    z, n = {}, {}

    def weight(i, c):
        zi = z.get((i, c), 0.0)
        if abs(zi) <= langid.L1:
            return 0.0
        return -(zi - math.copysign(langid.L1, zi)) / ((langid.BETA + math.sqrt(n.get((i, c), 0.0))) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, value, label = rows[r]
            x = [*zip(at.tolist(), value.tolist()), (buckets, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(n_classes)}
            s = [sum(v * w[i, c] for i, v in x) for c in range(n_classes)]
            e = [math.exp(t - max(s)) for t in s]
            for i, v in x:
                for c in range(n_classes):
                    g = v * (e[c] / sum(e) - (c == label))
                    before = n.get((i, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * w[i, c]
                    n[i, c] = before + g * g
    return [[weight(i, c) for c in range(n_classes)] for i in range(buckets + 1)]


def test_training_equals_a_plain_one():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        at = np.sort(rng.choice(30, 6, replace=False))
        rows.append((at, vector(rng.integers(1, 5, 6), np.linspace(1, 2, 6)), k % 3))
    weights, bias = train_ftrl(rows, 3, 30, epochs=2)
    want = np.array(plain_ftrl(rows, 3, 30, 2))
    assert np.allclose(weights, want[:-1], atol=1e-9) and np.allclose(bias, want[-1], atol=1e-9)


def test_counts_equal_plain_ones():
    """The occurrences of every 1- to 3-gram of a text, by string."""
    text = " añb ñb añ b "
    grams = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            grams[text[i : i + n]] = grams.get(text[i : i + n], 0) + 1
    found = counts(text)
    assert sorted(found[found > 0].tolist()) == sorted(grams.values()) and (found > 0).sum() == len(grams)
