"""A Merkle manifest of a dataset: subroots by source, one root, a proof for each row.

H is the lowercase hex SHA-256 of its inputs in a row. A row's leaf is H of its
fields; of a source, leaves ascend by doc_id, and every ``FAN`` neighbours become
their H, level by level, until one node remains, the subroot; subroots, in the
order of their sources, become the root likewise.

How it runs. Leaves are native expressions and written without their texts. A sort
by ranges of (source, doc_id, leaf) and the counts of its parts give each leaf its
place in its source, so no source is sorted or numbered in one task. ``FAN **
DEPTH`` consecutive places are a bucket. As buckets begin at multiples of that, the
lowest ``DEPTH`` levels of a tree never cross them: tasks hold a bucket as an Arrow
table, and DuckDB computes its levels there by queries of ordered ``string_agg`` and
``sha256``. Bucket roots, one for each 729 leaves, go up by Spark's own expressions,
a group of three rows at a time; then the siblings met on the way go down from
parents to children, so that each bucket has its outer proof. Buckets meet those
in a cogroup, where DuckDB folds each leaf, or what tampering makes of it, by its
own siblings and the outer ones. A node has three children at most, so no
join or group grows with a source.

Defined results: null fields are ``-``; a null source comes first, a null doc_id
first in its source, and is not tampered with (it has no remainder); equal doc_ids
of a source are in the order of their leaves, and equal rows have neighbouring
leaves; a lone leaf is its subroot and a lone subroot the root, with the proof H of
nothing; texts are whole, however long; extra columns are ignored, whatever their
names; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, give_back

FAN, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source as a key, null first), leaf, and the leaf of the
    row as tampering leaves it."""
    fields = [F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS]
    leaf = lambda text: F.sha2(F.concat(*map(field, fields[:-1]), field(text)), 256)
    hit = F.pmod(F.crc32(fields[0].cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(hit & F.contains(fields[4], F.lit("\n")), leaf(F.replace(fields[4], F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    tree = F.coalesce(F.concat(F.lit("+"), fields[1]), F.lit(""))
    return docs.withColumn("leaf", leaf(fields[4])).select(fields[0].alias("doc_id"), tree.alias("tree"), "leaf", tampered.alias("tampered"))


def ranked(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``place``, from 0 within each ``tree`` by ``order``, and ``n``, the
    tree's rows. Parts of a sort by ranges are numbered where they lie; the rows
    before a part come from a sum over parts."""
    df = df.withColumn("tie", F.monotonically_increasing_id())  # spreads equal rows
    by = ["tree", *order, "tie"]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.stage(dealt.drop("tie").withColumn("part", F.shiftright("at", 33)), f"{name}-sorted")
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    trees = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(trees.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(trees).alias("n"))
    return dealt.join(parts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def depth_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


@lru_cache(maxsize=1)
def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "64MB"})


def _levels(depth: int) -> str:
    """CTEs l0 .. of the levels of the bucket in ``leaves``."""
    rise = [f"l{k + 1} AS MATERIALIZED (SELECT i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY i // {FAN})" for k in range(depth)]
    return ", ".join(["l0 AS MATERIALIZED (SELECT i, h FROM leaves)", *rise])


def _folds(depth: int, outer: list[tuple[str, str]]) -> str:
    """Each leaf with its siblings in a row and the root that it folds to."""
    steps = ["s0 AS (SELECT i, tampered AS folded, '' AS proof FROM leaves)"]
    own = lambda f, by: " || ".join(f"coalesce({f}(h, {d}) OVER w, '')" for d in by)
    for k in range(depth):
        steps.append(f"n{k} AS (SELECT i, {own('lag', range(FAN - 1, 0, -1))} AS b, {own('lead', range(1, FAN))} AS a FROM l{k} WINDOW w AS (PARTITION BY i // {FAN} ORDER BY i))")
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT s.i, sha256(b || folded || a) AS folded, proof || b || a AS proof FROM s{k} AS s JOIN n{k} AS n ON n.i = s.i // {FAN**k})")
    folded = "folded"
    for before, after in outer:
        folded = f"sha256('{before}' || {folded} || '{after}')"
    rest = "".join(b + a for b, a in outer)
    return f"WITH {_levels(depth)}, {', '.join(steps)} SELECT v.doc_id, v.h AS leaf, sha256(proof || '{rest}') AS proof_sha256, {folded} AS folded_root FROM leaves AS v JOIN s{depth} USING (i)"


def _bucket(table: pa.Table, most: int) -> tuple[pa.Table, int]:
    """The bucket's leaves for the engine, and its levels."""
    total = table.column("n")[0].as_py()
    return table.select(["doc_id", "i", "leaf", "tampered"]).rename_columns(["doc_id", "i", "h", "tampered"]), min(most, depth_of(total))


def _run(leaves: pa.Table, sql: str) -> list[tuple]:
    engine = _engine()
    engine.register("leaves", leaves)
    try:
        return engine.execute(sql).fetchall()
    finally:
        engine.unregister("leaves")
        give_back()


def _roots(most: int):
    def rise(table: pa.Table) -> pa.Table:
        own, depth = _bucket(table, most)
        ((h,),) = _run(own, f"WITH {_levels(depth)} SELECT h FROM l{depth}")
        buckets = -(-table.column("n")[0].as_py() // FAN**most)
        return pa.table({"tree": table.column("tree")[:1], "idx": table.column("bucket")[:1], "n": pa.array([buckets], pa.int64()), "h": pa.array([h])})

    return rise


def _proofs(root: str, most: int):
    def prove(table: pa.Table, outer: pa.Table) -> pa.Table:
        own, depth = _bucket(table, most)
        path = [(x["b"], x["a"]) for x in outer.column("path")[0].as_py()]
        rows = _run(own, _folds(depth, path))
        doc_id, leaf, proof, folded = zip(*rows)
        n = len(rows)
        columns = [pa.array(doc_id, pa.int64()), pa.array(leaf), pa.array([outer.column("subroot")[0].as_py()] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])]
        return pa.table(columns, RESULT)

    return prove


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
NODE = "tree string, idx long, n long, h string"


def _climbed(nodes: DataFrame, steps: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each step above ``nodes`` (NODE) that a tree has, and at each
    step the roots of the trees that end there."""
    runs, roots = [], []
    for k in range(steps + 1):
        roots.append(nodes.filter("n = 1").select("tree", "idx", "h"))
        if k < steps:
            members = F.sort_array(F.collect_list(F.struct("idx", "h")))
            group = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up")).agg(F.any_value("n").alias("n"), members.alias("members"))
            runs.append(scratch.stage(group, f"{name}-runs"))
            nodes = runs[-1].select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.concat_ws("", F.col("members.h")), 256).alias("h"))
    return runs, roots


def _descended(runs: list[DataFrame], roots: list[DataFrame], above: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """tree, idx, path of each node that the climb began with: the siblings before
    and after, level by level, then ``above``, the path of the tree's root if any."""
    nothing = F.array().cast("array<struct<b:string,a:string>>").alias("path")
    at_root = lambda k: roots[k].select("tree", "idx", nothing) if above is None else roots[k].drop("h").join(above, "tree").select("tree", "idx", "path")
    paths = at_root(len(runs))
    for k in range(len(runs) - 1, -1, -1):
        met = runs[k].join(paths.withColumnRenamed("idx", "up"), ["tree", "up"]).select("tree", "members", "path", F.posexplode("members").alias("at", "own"))
        side = lambda c: F.expr(f"concat_ws('', transform(filter(members, (x, i) -> i {c} at), x -> x.h))")
        down = met.select("tree", "own.idx", F.concat(F.array(F.struct(side("<").alias("b"), side(">").alias("a"))), "path").alias("path"))
        paths = scratch.stage(down.unionByName(at_root(k)), f"{name}-paths")
    return paths


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every
    row; buckets are of ``FAN ** depth`` leaves."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op12")
    plain = scratch.stage(leaves(docs), "leaves")
    placed = ranked(plain, ["doc_id", "leaf"], scratch, "leaves")
    size = FAN**depth
    placed = scratch.stage(placed.select("tree", "n", "doc_id", "leaf", "tampered", F.expr(f"place div {size}").alias("bucket"), (F.col("place") % size).alias("i")), "placed")
    scratch.drop("leaves", "leaves-sorted")
    buckets = scratch.stage(placed.groupBy("tree", "bucket").applyInArrow(_roots(depth), NODE), "buckets")
    most = buckets.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    runs, roots = _climbed(buckets, depth_of(most), scratch, "buckets")
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = scratch.stage(subroots.select("tree", F.col("h").alias("subroot")), "subroots")
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "subroot")
    sources = scratch.stage(ranked(named, ["source"], scratch, "sources").select("tree", "source", F.col("place").alias("idx"), "n", F.col("subroot").alias("h")), "sources")
    count = sources.agg(F.max("n")).first()[0]
    up, ends = _climbed(sources.drop("source"), depth_of(count), scratch, "sources")
    root = ends[-1].first()["h"]
    of_source = _descended(up, ends, None, scratch, "sources").join(sources, "idx").select(F.col("source").alias("tree"), "path")
    of_source = scratch.stage(of_source, "of-source")
    outer = _descended(runs, roots, of_source, scratch, "buckets").join(subroots, "tree").select("tree", F.col("idx").alias("bucket"), "path", "subroot")
    outer = scratch.stage(outer, "outer")
    both = placed.groupBy("tree", "bucket").cogroup(outer.groupBy("tree", "bucket"))
    out = scratch.stage(both.applyInArrow(_proofs(root, depth), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "proofs")
    scratch.drop(*[x for x in scratch.paths if x != "proofs"])
    return out


def _sql() -> str:
    """The contract in DuckDB: levels and folds by recursion."""
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(f(c) for c in FIELDS[:-1])} || {f(text)})"
    # CRC-32, bit by bit, of the decimal doc_id
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    sides = "coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS b, coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS a"
    return f"""
WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} & 1 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS tampered FROM documents),
l0 AS MATERIALIZED (SELECT rid, source, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM base),
lv AS (SELECT source, 0 AS lvl, i, n, leaf AS h FROM l0 UNION ALL
  SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY source, lvl, n, i // 3),
sub AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS lvl, i, n, h FROM sub UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE n > 1 GROUP BY lvl, n, i // 3),
ls AS MATERIALIZED (SELECT source, lvl, i, {sides} FROM lv WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, i // 3 ORDER BY i)),
ts AS MATERIALIZED (SELECT lvl, i, {sides} FROM tv WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 3 ORDER BY i)),
w1 AS (SELECT rid, source, 0 AS lvl, i, tampered AS f, '' AS proof FROM l0 UNION ALL
  SELECT rid, w1.source, w1.lvl + 1, w1.i // 3, sha256(b || f || a), proof || b || a FROM w1 JOIN ls ON ls.source IS NOT DISTINCT FROM w1.source AND ls.lvl = w1.lvl AND ls.i = w1.i),
e1 AS (SELECT rid, source, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM w1 GROUP BY rid, source),
w2 AS (SELECT rid, 0 AS lvl, sub.i, f, proof, sub.h AS subroot FROM e1 JOIN sub ON sub.source IS NOT DISTINCT FROM e1.source UNION ALL
  SELECT rid, w2.lvl + 1, w2.i // 3, sha256(b || f || a), proof || b || a, subroot FROM w2 JOIN ts ON ts.lvl = w2.lvl AND ts.i = w2.i),
e2 AS (SELECT rid, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof, any_value(subroot) AS subroot FROM w2 GROUP BY rid),
top AS (SELECT h AS root FROM tv WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM e2 JOIN base USING (rid), top"""


SQL = _sql()
