import collections
import random

import pytest

from quarrylight.llm.sharding import Shards, sharded


def test_append_compact_and_manifest(spark, tmp_path):
    table = Shards(spark, f"file://{tmp_path}/t", target=200_000, least=1000, fanout=3)
    assert table.read() is None and table.compact() == 0
    rows = []
    for batch in range(7):
        new = [(batch * 1000 + i, f"text {batch} {i * 7919 % 1013}" * 3, None if i % 5 else "s") for i in range(400)]
        rows += new
        table.append(spark.createDataFrame(new, "doc_id long, text string, path string").repartition(3))
        if batch % 2:
            before = table.manifest()["shards"]
            table.compact()
            after = table.manifest()["shards"]
            assert len(after) < len(before) and sum(s["rows"] for s in after) == len(rows)
    assert collections.Counter(map(tuple, table.read().collect())) == collections.Counter(rows)
    assert not table.plan() or len(table.plan()) < 2
    version = table.log.latest()[0]
    group = table.manifest()["shards"][:2]
    assert table._commit({g["path"] for g in group}, [])
    assert not table._commit({g["path"] for g in group}, [])  # replaced meanwhile
    assert table.log.latest()[0] == version + 1


def _noise(n: int, size: int, seed: int):
    rng = random.Random(seed)
    return [(seed * 100_000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=size))) for i in range(n)]


def test_files_come_to_the_target_size_from_both_sides(spark, tmp_path):
    """Many small shards, and one arrival of many times the target: afterwards every
    file is of half to one and a half targets, but for one rest in each tier."""
    target = 256 << 10
    table = Shards(spark, f"file://{tmp_path}/t", target=target, least=16 << 10, fanout=4)
    small, large = _noise(2000, 1500, 1), _noise(2000, 1500, 2)
    table.append(spark.createDataFrame(small, "doc_id long, text string").repartition(60))
    assert len(table.manifest()["shards"]) == 60 and max(s["bytes"] for s in table.manifest()["shards"]) < target / 2
    assert table.compact() > 4
    sizes = [s["bytes"] for s in table.manifest()["shards"]]
    assert sum(not target / 2 <= x <= 1.5 * target for x in sizes) <= 1 and len(sizes) > 4
    table.append(spark.createDataFrame(large, "doc_id long, text string").coalesce(1))
    assert max(s["bytes"] for s in table.manifest()["shards"]) > 6 * target
    table.compact()
    sizes = [s["bytes"] for s in table.manifest()["shards"]]
    assert sum(not target / 2 <= x <= 1.5 * target for x in sizes) <= 2 and len(sizes) > 12
    assert not table.plan() and sum(s["rows"] for s in table.manifest()["shards"]) == 4000
    assert sorted(map(tuple, table.read().collect())) == sorted(small + large)
    # long texts: a shard of few rows is split down to single ones
    table.append(spark.createDataFrame(_noise(3, 2 * target, 3), "doc_id long, text string").coalesce(1))
    assert table.compact() == 1 and table.compact() == 0 and table.read().count() == 4003


def test_two_compactors(spark, tmp_path):
    """Of two that merge the same shards one commits, and no row is lost or doubled."""
    make = lambda: Shards(spark, f"file://{tmp_path}/t", target=1 << 20, least=1000, fanout=3)
    one, two = make(), make()
    rows = _noise(300, 100, 4)
    one.append(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    plain = one._written
    one._written = lambda path: (two.compact(), plain(path))[1]
    assert one.compact() == 0 and len(one.manifest()["shards"]) == 1
    assert sorted(map(tuple, one.read().collect())) == sorted(rows)


def test_columns_come_and_go_and_old_manifests_stay_readable(spark, tmp_path):
    table = Shards(spark, f"file://{tmp_path}/t", target=200_000, least=1000, fanout=2)
    a = spark.createDataFrame([(i, f"t{i}", i * 2) for i in range(10)], "doc_id long, text string, extra long")
    b = spark.createDataFrame([(i, f"t{i}") for i in range(10, 20)], "doc_id long, text string")
    c = spark.createDataFrame([("n", f"t{i}", i) for i in range(20, 30)], "note string, text string, doc_id long")
    table.append(a)
    table.append(b)
    first = table.log.latest()[0]
    old = table.read()
    table.append(c.limit(0))
    table.append(c)
    with pytest.raises(ValueError, match="extra is bigint, not string"):
        table.append(spark.createDataFrame([("x",)], "extra string"))
    assert table.compact() >= 1
    want = [(i, f"t{i}", i * 2 if i < 10 else None, "n" if i >= 20 else None) for i in range(30)]
    out = table.read()
    assert out.columns == ["doc_id", "text", "extra", "note"] and sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, old.collect())) == [w[:3] for w in want[:20]]  # a reader of the former manifest
    assert table.read(first).count() == 20
    assert table.vacuum() > 0
    assert sorted(map(tuple, table.read().collect())) == want and table.log.versions() == table.log.versions()[-1:]


def test_long_text(spark, tmp_path):
    table = Shards(spark, f"file://{tmp_path}/t")
    table.append(spark.createDataFrame([(1, "x " * 3_000_000)], "doc_id long, text string"))
    assert len(table.read().first().text) == 6_000_000


def test_query(spark):
    df = spark.createDataFrame([(i % 90, f"t{i}", None) for i in range(100)] + [(None, None, "x")], "doc_id long, text string, shard string")
    out = sharded(df).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter([i % 90 for i in range(100)] + [None])
    by = collections.Counter(r.shard for r in out)
    assert all(by[r.shard] == r.shard_rows for r in out)
    assert sharded(df.limit(0)).collect() == []
