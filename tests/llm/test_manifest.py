import hashlib
import random
import zlib

import duckdb
import pytest

from quarrylight.llm import manifest as mf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain(rows):
    """The contract in words, a tree at a time."""

    def leaf(d, t, g, s, n):
        return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, g, n, t)))

    def rise(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            yield run[: i % 3], run[i % 3 + 1 :]
            i //= 3

    by = {}
    for d, t, g, s, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        by.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, g, s, n), d, leaf(d, t.replace("\n", "") if hit else t, g, s, n)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: rise([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = rise([trees[s][-1][0] for s in names])
    root = top[-1][0]
    for s in names:
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, names.index(s))]
            folded = x[4]
            for before, after in steps:
                folded = H(*before, folded, *after)
            yield x[3], x[2], trees[s][-1][0], root, H(*(y for b, a in steps for y in b + a)), folded, folded == root


def made(n=700, seed=0):
    rng = random.Random(seed)
    text = lambda i: rng.choice([None, "", "one\ntwo", f"ä {i}\n\n", "plain", "- 3:abc", "\n"])
    rows = [(i, text(i), rng.choice([None, "en", "dé"]), rng.choice(["big"] * 8 + [None, "", "é", "z", "lone" if i == 7 else "big"]), rng.choice([None, i])) for i in range(n)]
    rows += [(None, "x\ny", "en", "big", 1), (None, "x\nz", "en", None, 1), (5, "other", "en", rows[5][3], 2), (9, "a\nb", None, "only", 0), (-4, "a\nb", None, "big", 0), (n + 1, "long \n" * 200_000, "en", "é", None)]
    return rows + [rows[11]] * 30 + [(900 + k, "t\n", "en", f"s{k}", k) for k in range(25)]


@pytest.mark.parametrize("depth", [2, 6])
def test_equals_a_plain_version_and_the_sql(spark, depth):
    rows = made()
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS n").repartition(7)
    want = sorted(plain(rows), key=str)
    assert sorted((tuple(r) for r in mf.manifest(df, depth).collect()), key=str) == want
    assert 0 < sum(not w[6] for w in want) < len(want) and len({w[3] for w in want}) == 1
    if depth == 6:
        db = duckdb.connect()
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        assert sorted(db.execute(mf.SQL).fetchall(), key=str) == want


@pytest.mark.parametrize("n", [1, 3, 10])
def test_small_trees(spark, n):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(n)]
    assert sorted(tuple(r) for r in mf.manifest(spark.createDataFrame(rows, SCHEMA), 1).collect()) == sorted(plain(rows))


def test_empty(spark):
    assert mf.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
