"""The pipeline against plain versions of its stages, and stage by stage."""

import random

from test_packing import plain
from test_probminhash import brute as near_classes
from test_substring_dedup import WORD

import corpus_pipeline


def made():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(700)]

    def prose(n):
        out = []
        while len(out) < n:
            k = rng.randint(6, 14)
            out += [rng.choice(words) for _ in range(k - 1)] + [rng.choice(words) + "."]
        return out

    rows, shared = [], prose(70)
    for i in range(60):
        body = prose(rng.randint(60, 200))
        if i % 6 == 0:
            body = body[:30] + shared + body[30:]
        rows.append((i, " ".join(body) if body[-1].endswith(".") else " ".join(body) + ".", "en", f"s{i % 3}"))
    for i in range(60, 80):  # exact and near copies
        w = rows[i - 60][1].split()
        if i % 2:
            w[5] = "changed"
        rows.append((i, " ".join(w), "en", "s1"))
    rows += [(80, "menu | home | about | shop | news | mail | jobs | help " * 10, "en", "s0"), (81, None, "en", "s0"), (82, "too short.", "en", "s0"), (83, "Good morning all here now.\nAll rights reserved.\n" + " ".join(prose(80)), "en", None)]
    return [(*r, len(r[1] or "")) for r in rows]


def written(df, path):
    """As the contract has it: each stage's result is written and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    quality, near, substring, mixing, packing = [f for _, f in corpus_pipeline.STAGES]

    one = written(quality(spark, docs, str(tmp_path)), f"{tmp_path}/1")
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == set(range(80)) | {83} and "rights" not in kept[83]
    assert all(kept[i] == rows[i][1] for i in range(80))

    two = written(near(spark, one, str(tmp_path)), f"{tmp_path}/2")
    left = {r.doc_id: r.text for r in two.collect()}
    assert set(left) == {c for _, c in near_classes(sorted(kept.items()))}

    three = written(substring(spark, two, str(tmp_path)), f"{tmp_path}/3")
    texts, first = {d: WORD.findall(t) for d, t in left.items()}, {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = {}
    for d, w in texts.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[d] = [x for j, x in enumerate(w) if j not in gone]
    got = {r.doc_id: WORD.findall(r.text) for r in three.collect()}
    assert got == {d: w for d, w in want.items() if w} and sum(map(len, want.values())) < sum(map(len, texts.values()))

    four = mixing(spark, three, str(tmp_path)).collect()
    times = {}
    for r in four:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    ids = {r.doc_id: len(plain().encode(r.text, add_special_tokens=False).ids) + 1 for r in four}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = {}
    for r in out:
        assert r.doc_tokens == ids[r.doc_id]
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: ids[d] * n for d, n in times.items()}


def test_lazy_stages_keep_what_they_read(spark, tmp_path):
    """A stage drops no table that its input reads, nor any of other operators."""
    from quarrylight.llm.common import live
    from quarrylight.llm.substring_dedup import substring_dedup

    docs = spark.createDataFrame(made()[:40], SCHEMA)
    other, out = substring_dedup(docs), docs
    n = other.count()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert out.count() > 0 and other.count() == n and live()


def test_odd_rows(spark, tmp_path):
    """No rows; repeated doc_ids and rows, null columns, ties; clashing names."""
    from pyspark.sql import functions as F

    quality, near, substring, mixing, packing = [f for _, f in corpus_pipeline.STAGES]
    extra = {c: F.lit(5) for c in ("q_text", "q_words", "q_kept", "row", "key", "id", "of", "own", "kept", "n", "copy", "rank", "s", "bucket", "size", "edge", "_bw", "_hit", "mark", "start")}
    empty = spark.createDataFrame([], SCHEMA).withColumns(extra)
    text = made()[1][1]
    rows = [(1, text), (1, text), (1, made()[2][1]), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, " \n")]
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).withColumns(extra)
    for df in (empty, odd):
        for k, f in enumerate((quality, near, substring, mixing)):
            assert f(spark, df, str(tmp_path)).columns == df.columns
        assert packing(spark, df, str(tmp_path)).count() >= df.count()
    kept = quality(spark, odd, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 1, 1, 2, None] and all(r.q_text == r.q_kept == 5 for r in kept)
    assert sorted(((r.doc_id, r.text) for r in near(spark, odd, str(tmp_path)).collect()), key=str) == sorted([(1, text), (1, made()[2][1]), (None, None), (3, None), (4, "")], key=str)
