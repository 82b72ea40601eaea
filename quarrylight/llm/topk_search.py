"""Exact top-k inner product search with a pivot-distance index.

Components become floor(256 x). A vector v gets one more component,
sqrt(M - |v|^2) with M the largest squared norm, and a query gets 0 there; then
the squared distance is |q|^2 + M - 2 q.v, so the nearest vectors are those of
the highest inner product and the triangle inequality may be used.

Index: ``PIVOTS`` pivots, chosen farthest-first from a bounded sample of
``SAMPLE`` rows, key each vector by (nearest pivot, distance). Vectors are
range-partitioned and sorted by that key, vec_id last, and cut into annuli: runs
of one pivot between two radii. A pivot that holds most rows is just many
annuli. At most about ``ANNULI`` annuli exist at any size (they get larger, as
several chunks), so their directory, the least and the greatest distance of each
to every pivot, is bounded and may be shared. Components are kept in the smallest
integer type that holds them.

Search: a query's annuli are sorted by their lower bound, the most that any pivot
p allows: |d(q, p) - [least, greatest]|. ``ROUNDS`` expand the nearest, then the
next few, then more, each time only those whose bound does not exceed the
distance of the k-th best so far; the search stops where none is left, as the
others can't hold a better or equal score. Queries travel in blocks to the groups of
consecutive annuli of which they need any, once each and with a bit for each annulus; a
task does one matrix product for a block and a chunk. The planner takes the blocks for
small, as the queries are, but all in all they may be larger than any table, so they
meet the chunks in a sort-merge join that is never a broadcast.

Defined results: vectors that are null or hold null or non-finite components
take no part, neither do rows with null vec_id; shorter vectors are padded with
zeros; a query's own vec_id is no candidate; rows that repeat a vec_id are
candidates each, and as queries count once (the least vector); extra columns are
ignored; an empty table gives an empty result. Scores are exact: where they may
pass 2^53 products are taken in whole numbers, and vectors so long that a score
may pass 2^63 raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import hash_sample, staged

K, SCALE, EVERY = 5, 256, 50
PIVOTS, SAMPLE, ANNULI, CHUNK, BLOCK = 32, 1024, 4096, 256, 256
GROUP, GROUPS, TASKS, HITS = 8192, 512, 8, 1 << 17
ROUNDS = ((0, 1), (1, 4), (4, 32), (32, None))
VALID = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
INDEX = "annulus long, low array<double>, high array<double>, n int, ids binary, vectors binary"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of each vector, padded to ``dim``."""
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = flat
    return out


def choose_pivots(sample: np.ndarray, most: float, n: int) -> np.ndarray:
    """Farthest-first choice among lifted sample vectors."""
    lifted = lift(sample, most)
    chosen = [0]
    far = ((lifted - lifted[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(lifted)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    return lifted[chosen]


def lift(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T)))


def packed(v: np.ndarray, kind: str) -> np.ndarray:
    """Components, whole numbers below 2^53 or beyond, as ``kind``."""
    return v if kind == "float64" else v.astype(kind)


def _keyed(dim: int, most: float, pivots: np.ndarray, kind: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("embedding"), dim)
            d = distances(lift(v, most), pivots)
            near = d.argmin(1)
            yield pa.record_batch(
                [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), batch.column("vec_id"), pa.array([r.tobytes() for r in packed(v, kind)], pa.binary())],
                ["pivot", "distance", "vec_id", "vector"],
            )

    return scan


def _annuli(limit: int, chunk: int, dim: int, most: float, pivots: np.ndarray, kind: str):
    """Chunks of consecutive vectors of one pivot; ``limit`` vectors an annulus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        number, filled, pivot, held = -1, 0, None, []

        def close() -> pa.RecordBatch:
            ids, vectors = np.array([h[0] for h in held], np.int64), b"".join(h[1] for h in held)
            d = distances(lift(np.frombuffer(vectors, kind).reshape(len(held), dim).astype(np.float64), most), pivots)
            row = [first + number, d.min(0).tolist(), d.max(0).tolist(), len(held), ids.tobytes(), vectors]
            held.clear()
            many = pa.list_(pa.float64())
            kinds = [pa.int64(), many, many, pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for p, i, v in zip(*(batch.column(c).to_pylist() for c in ("pivot", "vec_id", "vector"))):
                if p != pivot or filled == limit or len(held) == chunk:
                    if held:
                        yield close()
                    if p != pivot or filled == limit:
                        number, filled = number + 1, 0
                    pivot = p
                held.append((i, v))
                filled += 1
        if held:
            yield close()

    return scan


def _blocks(dim: int, most: float, pivots: np.ndarray, directory: tuple, lo: int, hi: int | None, block: int, per: int, kind: str):
    """For blocks of queries, groups of ``per`` annuli, with a bit for each annulus of
    rank lo to hi that may hold a better one; ``scored``: the pairs that are."""
    low, high, size = directory

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, block):
                batch = whole.slice(a, block)
                v = matrix(batch.column("embedding"), dim)
                d = distances(np.hstack([v, np.zeros((len(v), 1))]), pivots)
                bound = np.zeros((len(v), len(size)))
                for p in range(len(pivots)):
                    np.maximum(bound, np.maximum(low[:, p] - d[:, p : p + 1], d[:, p : p + 1] - high[:, p]), out=bound)
                rank = np.argsort(np.argsort(bound, axis=1, kind="stable"), axis=1, kind="stable")
                least = batch.column("least").to_numpy(zero_copy_only=False)  # NaN: fewer than k known
                reach = np.sqrt(np.maximum(0.0, (v * v).sum(1) + most - 2 * least))
                reach = np.where(np.isnan(reach), np.inf, reach * (1 + 1e-9) + 1e-6)
                wanted = (bound <= reach[:, None]) & (rank >= lo) & (True if hi is None else rank < hi)
                ids = batch.column("vec_id").to_numpy()
                floor = np.nextafter(np.nan_to_num(least, nan=-np.inf, neginf=-np.inf), -np.inf)
                for g in range(0, len(size), per):
                    own = wanted[:, g : g + per]
                    rows = np.flatnonzero(own.any(1))
                    if len(rows):
                        parts = [ids[rows].astype(np.int64), floor[rows], packed(v[rows], kind), np.packbits(own[rows], axis=1)]
                        yield pa.record_batch(
                            [pa.array([g // per]), *[pa.array([x.tobytes()]) for x in parts], pa.array([int((own @ size[g : g + per]).sum())])],
                            ["group", "query_ids", "leasts", "queries", "wanted", "scored"],
                        )

    return scan


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, own: int) -> np.ndarray:
    """Places of the k highest scores but of id ``own``, ties to smaller ids."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _products(dim: int, k: int, kind: str, whole: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                if sum(len(x[0]) for x in out) > HITS:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])
                    out = []
                qid = np.frombuffer(batch.column("query_ids")[i].as_py(), np.int64)
                place = batch.column("place")[i].as_py()
                bits = np.frombuffer(batch.column("wanted")[i].as_py(), np.uint8).reshape(len(qid), -1)
                rows = np.flatnonzero(bits[:, place >> 3] >> (7 - (place & 7)) & 1)
                if not len(rows):
                    continue
                ids, least = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), np.frombuffer(batch.column("leasts")[i].as_py(), np.float64)[rows]
                q = np.frombuffer(batch.column("queries")[i].as_py(), kind).reshape(len(qid), dim)[rows].astype(np.int64 if whole else np.float64)
                qid = qid[rows]
                v = np.frombuffer(batch.column("vectors")[i].as_py(), kind).reshape(len(ids), dim).astype(q.dtype)
                scores = q @ v.T  # exact: in whole numbers below 2^63, in floats below 2^53
                # what is below the k-th best so far can't be among the best
                good = (scores >= least[:, None]) & (ids != qid[:, None])
                many = good.sum(1) > k
                r, c = np.nonzero(good & ~many[:, None])
                out.append((qid[r], ids[c], scores[r, c].astype(np.int64)))
                for r in np.flatnonzero(many):
                    at = best_of(scores[r], ids, k, qid[r])
                    out.append((np.full(len(at), qid[r]), ids[at], scores[r, at].astype(np.int64)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    return scan


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id ``every`` divides.
    ``report`` is given the pairs of queries and vectors that were scored, and all."""
    spark = vectors.sparkSession
    valid = vectors.filter(VALID).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    norm = f"aggregate(embedding, 0D, (a, x) -> a + pow(cast(floor({SCALE} * x) AS double), 2))"
    largest = f"aggregate(embedding, 0D, (a, x) -> greatest(a, abs(floor({SCALE} * x))))"
    n, dim, most, top = valid.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.expr(norm)), F.max(F.expr(largest))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    sample = hash_sample(valid, "vec_id", n, SAMPLE).select("embedding").collect()
    dim = max(dim, 1)
    if most >= 2.0**63:
        raise ValueError("vectors are too long for scores of 64 bits")
    kind = next(t for t, bits in (("int16", 15), ("int32", 31), ("int64", 63)) if top < 2.0**bits)
    whole = most >= 2.0**53  # no score passes the largest squared length
    sample = sample or valid.select("embedding").limit(pivots).collect()
    points = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        points[i, : len(r[0])] = np.floor(SCALE * np.array(r[0], np.float64))
    centres = choose_pivots(points, most, pivots)
    limit = max(CHUNK, -(-n // ANNULI))
    keyed = valid.mapInArrow(_keyed(dim, most, centres, kind), "pivot int, distance double, vec_id long, vector binary")
    keys = ["pivot", "distance", "vec_id"]
    index = keyed.repartitionByRange(max(1, min(ANNULI, n // (4 * CHUNK))), *keys).sortWithinPartitions(*keys).mapInArrow(_annuli(limit, CHUNK, dim, most, centres, kind), INDEX)
    index = staged(index, "op1-index")
    ends = [F.array(*[f(F.col(c)[p]) for p in range(len(centres))]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    rows = index.groupBy("annulus").agg(*ends, F.sum("n").alias("n")).orderBy("annulus").collect()  # a row for each of ANNULI
    directory = tuple(np.array([r[c] for r in rows]) for c in ("low", "high", "n"))
    # groups of consecutive annuli, about GROUP vectors each
    groups = max(1, min(GROUPS, -(-n // GROUP), len(rows)))
    per = -(-len(rows) // groups)
    tasks = max(1, min(groups, TASKS * spark.sparkContext.defaultParallelism))
    places = spark.createDataFrame([(r.annulus, i // per, i % per) for i, r in enumerate(rows)], "annulus long, group long, place int")
    chunks = index.join(F.broadcast(places), "annulus").select("group", "place", "ids", "vectors").repartition(tasks, "group")
    queries = staged(valid.filter(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "op1-queries")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = None
    for r, (lo, hi) in enumerate(ROUNDS):
        if lo >= len(rows):
            break
        known = queries.withColumn("least", F.lit(None).cast("double"))
        if best is not None:
            least = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
            known = queries.join(least, "vec_id", "left")
        pairs = known.select("vec_id", "embedding", "least").mapInArrow(_blocks(dim, most, centres, directory, lo, hi, BLOCK, per, kind), "group long, query_ids binary, leasts binary, queries binary, wanted binary, scored long")
        if report is not None:
            report["scored"] = report.get("scored", 0) + int(pairs.agg(F.sum("scored")).first()[0] or 0)
            report["pairs"] = queries.count() * n
        # a number of partitions that is given is kept, as few bytes are much work here
        met = pairs.drop("scored").repartition(tasks, "group").hint("merge").join(chunks, "group")
        found = met.select("query_ids", "leasts", "queries", "wanted", "place", "ids", "vectors").mapInArrow(_products(dim, k, kind, whole), "query_id long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"op1-round{r}")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
