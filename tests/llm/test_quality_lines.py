import re

import duckdb

from quarrylight.llm.quality_lines import SQL, cleaned, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + j for i in at for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


ROWS = [
    (1, "A good line of prose stands here.\n" + " ".join(f"word{i}" for i in range(60)) + "."),
    (2, None),
    (3, ""),
    (4, " \t\x0b\n\r"),
    (5, "a b c a b c a b c " * 30),
    (6, "home | about | news | mail | shop.\n" * 3 + " ".join(f"x{i}" for i in range(9)) + "."),
    (7, "Same line here.\nSame line here.\n\nSame line here.\n" + " ".join(f"é{i}" for i in range(80)) + "!"),
    (8, " ".join(f"STOP{i}!!" for i in range(80))),
    (9, "ab ab ab ab"),
    (10, "All rights reserved.\n" + " ".join(f"t{i}" for i in range(70)) + " 😀."),
    (1, "A good line of prose stands here.\n" + " ".join(f"word{i}" for i in range(60)) + "."),
    (None, "x " * 20000),
    (11, " ".join(f"t{i}" for i in range(70))),
    (13, "Tous droits RÉSERVÉS.\nAlle Rechte vorbehalten.\nPolítica de privacidad.\n" + " ".join(f"t{i}" for i in range(70)) + "."),
    (12, "z" * 500000),
]


def test_base_counts_and_sql(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS q_text", "2 AS i", "3 AS n_words")
    got = sorted((tuple(r) for r in quality(df).collect()), key=str)
    assert sorted(((d, *base(t)) for d, t in ROWS), key=str) == sorted((g[:6] for g in got), key=str)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert sorted((tuple(r) for r in db.execute(SQL).fetchall()), key=str) == got
    kept = {g[0] for g in got if g[7]}
    assert kept == {1, 7, 10, 13}


def test_cleaned(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) AS n_chars", "'s' AS source")
    out = {r.doc_id: r for r in cleaned(df).collect()}
    assert out[1].text == ROWS[0][1]
    assert out[13].text.startswith("t0 t1")
    assert "reserved" not in out[10].text and out[10].n_chars == len(out[10].text)
    assert quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_line_is_lowered_once(spark):
    plan = quality(spark.createDataFrame(ROWS[:1], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
