import base64
import hashlib
import shutil

from quarrylight.llm.warc import Writer, archive, read_archives, record, records, round_trip, train


def expect(rows, least=0):
    groups = {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r)
    out = []
    for h, own in groups.items():
        raw = h.encode()
        own.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or ""))
        for k, r in enumerate(own):
            revisit = k > 0 and len(raw) >= least
            out.append((r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", own[0][0] if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<html>{'é' * (i % 7)}<p>page {i % 60} some common words here</p></html>" * (1 + i % 5)) for i in range(300)]
ROWS += [(1000, None, None), (1001, "u\r\nX: y", ""), (1002, "u", "big " * 400000), (None, "n", ROWS[0][2]), (None, "n", "only here"), (5, "again", ROWS[5][2]), (1003, "c", "\r\n\r\nWARC/1.1\r\n\x00")]
ROWS += [(2000, u, "tied") for u in ("b", "a", "a", "a", None)] + [(1999, "a", "tied"), (None, "a", "nulls"), (None, None, "nulls"), (None, "a", "nulls")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4).selectExpr("*", "1 AS sha", "2 AS refers_to", "'x' AS name")
    assert sorted(map(tuple, round_trip(df).collect()), key=str) == expect(ROWS)
    assert sorted(map(tuple, round_trip(df, least=40).collect()), key=str) == expect(ROWS, 40)
    assert round_trip(df.limit(0)).collect() == []


def test_texts_and_rolling(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:300], "page_id long, url string, html string").repartition(2)
    root = f"file://{tmp_path}/w"
    written = archive(df, root, roll=4000).collect()
    assert len(written) > 3 and sum(r.n_records for r in written) == 300
    out = {r.page_id: r for r in read_archives(spark, root).collect()}
    for p, u, h in ROWS[:300]:
        r = out[p]
        assert r.url == u and (r.html if r.record_type == "response" else out[r.refers_to].html) == h


def test_files_that_no_finished_task_reported_are_not_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:40], "page_id long, url string, html string").repartition(2)
    root = f"file://{tmp_path}/w"
    first = archive(df, root).collect()[0].name
    for stale in ("part-00000-0001-77.warc.zst", "part-00007-0000-3.warc.zst"):  # a lost attempt, a partition that is gone
        shutil.copy(f"{tmp_path}/w/{first}", f"{tmp_path}/w/{stale}")
    (tmp_path / "w" / "part-00001-0000-9.warc.zst").write_bytes(b"cut off")
    assert sorted(r.page_id for r in read_archives(spark, root).collect()) == list(range(40))


def test_dictionary_helps_and_records_stand_alone():
    raws = [record(i, f"http://x/{i}", f"<html><head><title>{i}</title></head><body>{i * 7919}</body></html>".encode(), None, False) for i in range(500)]
    with_it, without = Writer(train(raws)), Writer(b"")
    for raw in raws:
        with_it.add(raw)
        without.add(raw)
    assert len(b"".join(with_it.parts[2:])) < 0.6 * len(b"".join(without.parts[2:]))
    whole = b"".join(with_it.parts[:1] + with_it.parts[-1:])  # dictionary and the last record only
    assert [f["X-Page-Id"] for f, _ in records(whole)] == ["499"]
