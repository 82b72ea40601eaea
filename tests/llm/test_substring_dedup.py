import hashlib
import random
import re

import pytest

from quarrylight.llm.substring_dedup import deduplicated, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, texts):
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(40, 130))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 30)
                w += p[a : a + rng.randint(45, 130)]
            else:
                w += [rng.choice(words) for _ in range(rng.randint(0, 80))]
        rows.append((d, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 120)
    rows += [(500, rows[7][1]), (501, rows[7][1]), (7, rows[7][1]), (3, rows[8][1]), (None, rows[7][1]), (600, None), (601, ""), (602, "x " * 400), (603, "x " * 399), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    from pyspark.sql import functions as F

    df = df.withColumns({"places": F.lit(1), "anchor": F.lit("x"), "sha": F.lit(2)})
    found = substring_dedup(df).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute(rows, 50)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= 50 for a, b in r.spans) for r in found)


def order(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_and_runs_in_thue_morse_order(spark):
    """Unequal words of 1024 and 2048 letters that any polynomial hash takes for equal."""
    flip = str.maketrans("ab", "ba")
    rows = []
    for k, n in enumerate((1024, 2048)):
        same = [f"s{k}x{i}" for i in range(49)]
        rows += [(10 * k, " ".join([*same, order(n)])), (10 * k + 1, " ".join([*same, order(n).translate(flip)]))]
    rows += [(30, " ".join(order(2048))), (31, " ".join("x" + order(2048).translate(flip)))]
    got = sorted((tuple(r)[:4] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows, 50)
    assert all(r[2] == 0 for r in got if r[0] < 30)


def test_long_text_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"n{i}" for i in range(300_000))
    rows = [(1, " ".join(f"n{i}" for i in range(1000, 1100)) + " tail"), (2, long), (3, "a" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "of", "kept", "row", "mark", "_bw", "_hit")})
    out = {r.doc_id: r for r in deduplicated(df).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert len(out[2].text.split()) == 300_000 - 100 and out[2].kept == out[2].row == 7


def test_tables_are_dropped(spark):
    from quarrylight.llm import common

    common.release(spark)
    before = list(common._LIVE)
    rows = made(3, 40)
    df = deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    common.release(spark, keep=df)
    n = df.count()
    assert n and common._LIVE
    common.release(spark)
    assert before == [] and not common._LIVE


def test_empty_and_kept_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).collect() == []
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first\n{passage} end"), (2, f"other start\n{passage}\n\nother end"), (3, passage)]
    out = {r.doc_id: r for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) n_chars")).collect()}
    assert out[1].text == rows[0][1]
    assert out[2].text == "other start\nother end" and out[2].n_chars == len(out[2].text)
    assert 3 not in out
