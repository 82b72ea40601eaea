import json

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarrylight.sources import files

SCHEMA = StructType([StructField("id", LongType()), StructField("x", StringType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":1,"x":"a"}\n\nnot json\n{"id":2}\n')
    rows = files.read_jsonl(spark, str(p), SCHEMA).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r._corrupt_record is not None) for r in rows] == [(1, 1, False), (3, None, True), (4, 2, False)]
    with pytest.raises(Exception, match="a.jsonl:3: bad JSON"):
        files.read_jsonl(spark, str(p), SCHEMA, strict=True).collect()
    files.write_jsonl(spark.createDataFrame([(1, "b")], "z int, a string"), str(tmp_path / "o"), sort_keys=True)
    assert spark.read.text(str(tmp_path / "o")).first().value == '{"a":"b","z":1}'


def test_lines_by_splits(spark, tmp_path):
    """Files of many splits, Windows ends, lone carriage returns, blank lines and
    lines longer than a split have the numbers that a plain reader gives."""
    (tmp_path / "d").mkdir()
    texts = {
        "a.log": "".join(f"line {i} {'x' * (i % 97)}\n" if i % 13 else "\n" for i in range(4000)),
        "b.log": "one\r\n\r\n two\rhalf \r\n" + "y" * 70_000 + "\n\nlast é no end",
        "c.log": "", "d.log": "\n \n", "e.log": "z\n\n\n",
    }
    for name, text in texts.items():
        (tmp_path / "d" / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        plain = {n: [(i + 1, x[:-1] if x.endswith("\r") else x) for i, x in enumerate(t.split("\n"))] for n, t in texts.items()}
        kept = {n: [(i, x) for i, x in rows if x.strip(" ")] for n, rows in plain.items()}
        df = files.read_lines(spark, f"{tmp_path}/d")
        assert df.rdd.getNumPartitions() >= 1 and spark.read.text(f"{tmp_path}/d").rdd.getNumPartitions() > 20
        got = df.collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in got) == sorted((n, i, x) for n, rows in kept.items() for i, x in rows)
        tail = files.read_lines(spark, f"{tmp_path}/d", tail=5).collect()
        want = {n: [(i, x) for i, x in rows if i > rows[-1][0] - 5] for n, rows in kept.items() if rows}
        assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in tail) == sorted((n, i, x) for n, rows in want.items() for i, x in rows)
        whole, shift = [], 0
        for n, rows in sorted(plain.items()):
            whole += [(i + shift, x) for i, x in kept[n]]
            shift += len(rows) - texts[n].endswith("\n") - (texts[n] == "")
        assert sorted((r.line_no, r.line) for r in files.read_lines(spark, f"{tmp_path}/d", across=True).collect()) == whole
        assert [r.line for r in files.read_lines(spark, f"{tmp_path}/d", across=True, tail=1).collect()] == ["z"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x, ""y""","line\nend"\n')
    assert tuple(files.read_csv(spark, str(tmp_path / "a.csv")).first()) == ('x, "y"', "line\nend")


def test_hooks_and_transcripts(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text("\n".join(json.dumps({"ts": f"2024-01-0{1 + i // 3}T0{i}", "hook": f"h{i}"}) for i in range(6)) + "\nbroken")
    assert [r.hook for r in files.read_hook_events(spark, str(p), "2024-01-02", 2).collect()] == ["h4", "h5"]
    q = tmp_path / "t.jsonl"
    q.write_text("\n".join(json.dumps(x) for x in [{"role": "assistant", "text": "old"}, {"payload": {"last_agent_message": "newest"}}, {"role": "user", "text": "u"}, {"payload": {"role": "assistant", "content": " "}}]))
    assert [r.text for r in files.last_assistant_messages(files.read_lines(spark, str(q), tail=files.TAIL)).collect()] == ["newest"]


def test_sessions_and_samples(spark, tmp_path):
    text = "long enough " * 10
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in [{"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": text}, {"type": "image"}]}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": text}}, {"type": "assistant", "message": {"role": "assistant", "content": text}}]))
    lines = files.read_lines(spark, str(p))
    assert [r.line_no for r in files.session_turns(lines, "rollout").collect()] == [1] and [r.line_no for r in files.session_turns(lines, "session").collect()] == [3]
    sample = {"session_2": [{"dia_id": "D2:1", "speaker": "A", "text": "b"}], "session_10": [{"dia_id": "D10:1", "speaker": "B", "text": "c"}], "session_2_date_time": "8 May, 2023", "speaker_a": "A"}
    df = spark.createDataFrame([("s", json.dumps(sample), json.dumps({"events_session_10": {"date": "9 May"}}))], "sample_id string, conversation string, event_summary string")
    assert [(r.session_no, r.dia_id, r.session_time) for r in files.flatten_samples(df).orderBy("session_no").collect()] == [(2, "D2:1", "8 May, 2023"), (10, "D10:1", "9 May")]


def test_archive_and_newest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    files.export_archive({"semantic": df}, str(tmp_path / "arc"))
    assert files.import_archive(spark, str(tmp_path / "arc"), {"semantic": SCHEMA})["semantic"].collect() == df.collect()
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/x.jsonl").write_text("{}")
    assert files.newest_file(spark, f"{tmp_path}/d").first().path.endswith("d/e/x.jsonl")


def test_message_logs(spark, tmp_path):
    part = {"text": " two "}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"type": "user", "content": " one "}), "", "{bad", json.dumps({"content": ["", " x ", part, {"text": files.ATTACHED + " y"}, {"image": 1}, 4, {"text": 5}]}), json.dumps({"content": [{"text": " "}]}), json.dumps([1]), json.dumps({"content": {"text": "z"}})]))
    got = files.message_lines(files.read_lines(spark, f"{tmp_path}/a.jsonl")).orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(1, "one"), (4, "x\n\ntwo")]
    docs = [("p", json.dumps({"messages": [{"type": "Gemini", "content": "a"}, {"type": "user", "content": "b"}, 3, {"type": "model", "content": [part]}, {"type": "model", "content": []}, {"content": "c"}]})), ("q", json.dumps({"messages": {}})), ("r", "no"), ("s", None)]
    got = files.message_documents(spark.createDataFrame(docs, "path string, text string")).orderBy("path", "place").collect()
    assert [(r.path, r.place, r.text) for r in got] == [("p", 1, "a"), ("p", 4, "two")]
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "sample_id string")
    assert files.some_samples(ids, None).count() == 3 and [r.sample_id for r in files.some_samples(ids, ["b", "z"]).collect()] == ["b"]


def test_scratch_folders_are_dropped(spark, tmp_path):
    import os

    from quarrylight.session import release_scratch, scratch_folder

    release_scratch(spark)
    path = scratch_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file://")) and release_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file://")) and release_scratch(spark) == 0
