"""Lloyd's centroids by kd-tree filtering.

Each task keeps its vectors in blocks of at most ``BLOCK`` with a kd-tree over each:
a node has the box of its vectors, their number and their sum as whole numbers. The
blocks are written once to the shared folder. A round takes the centroids, some
``k`` times 64 numbers, down every tree: of a node's candidates the one nearest to
the box's middle stays, and so does any that is not strictly farther from the
corner of the box most in its favour; a node with a single candidate is assigned
whole, by its number and sum; at a leaf that has more the distances decide. So a
round is one pass, moves a row for each task, cluster and dimension, and gives what
plain assignment gives, exactly: all arithmetic is on whole numbers, ties go to the
smaller cluster, and only strictly dominated candidates are dropped.

Components become floor(1024 x). Vectors take part if they have exactly ``DIMS``
components, none null or not finite, each of a size of at most 65,536 (2 ** 26
after scaling), as squared distances of larger ones would not fit a long.

Defined results: vectors of a null vec_id are clustered but never start a cluster;
rows that repeat vec_id count each, and if they are among the first, each starts a
cluster (equal ones leave the later empty); fewer vectors than clusters make fewer
clusters; an empty cluster keeps its centroid; an empty table, or one without a fit
vector, gives an empty result; extra columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
BLOCK, LEAF, MOST = 4096, 24, 65_536


class Tree:
    """A kd-tree over rows of ``points``, which are put into its order. Node i has
    the rows start[i]:stop[i], its box low[i], high[i], their sum and its children
    left[i], right[i] (-1 at a leaf); ``order`` has the rows' former places."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.start, self.stop, self.left, self.right = [], [], [], []
        low, high, sums = [], [], []
        stack = [(0, len(points), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            own, here = points[self.order[a:b]], len(low)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = here
            least, most = own.min(axis=0), own.max(axis=0)
            low.append(least)
            high.append(most)
            sums.append(own.sum(axis=0))
            self.start.append(a)
            self.stop.append(b)
            self.left.append(-1)
            self.right.append(-1)
            wide = int((most - least).argmax())
            if b - a > LEAF and most[wide] > least[wide]:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], middle)]
                stack += [(a + middle, b, here, True), (a, a + middle, here, False)]
        self.points = points[self.order]
        self.low, self.high, self.sums = np.array(low), np.array(high), np.array(sums)

    NUMBERS = ("start", "stop", "left", "right")

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Points, boxes and sums, and the shape of the tree, as bytes."""
        shape = np.array([getattr(self, x) for x in self.NUMBERS], np.int32)
        return self.points.astype(np.int32).tobytes(), np.concatenate([self.low, self.high, self.sums]).astype(np.int64).tobytes(), shape.tobytes()

    @classmethod
    def unpacked(cls, points: bytes, boxes: bytes, shape: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.points = np.frombuffer(points, np.int32).reshape(-1, DIMS).astype(np.int64)
        tree.low, tree.high, tree.sums = np.frombuffer(boxes, np.int64).reshape(3, -1, DIMS)
        for name, row in zip(cls.NUMBERS, np.frombuffer(shape, np.int32).reshape(4, -1)):
            setattr(tree, name, row)
        return tree

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its candidates), disjoint nodes that cover the tree: one candidate
        for a node assigned whole, all that are left at a leaf."""
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            node, left = stack.pop()
            if len(left) > 1:
                left = self._undominated(node, left, centroids)
            if len(left) > 1 and self.left[node] >= 0:
                stack += [(self.right[node], left), (self.left[node], left)]
            else:
                yield node, left

    def _undominated(self, node: int, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        low, high, own = self.low[node], self.high[node], centroids[left]
        off = 2 * own - (low + high)
        best = own[int((off * off).sum(axis=1).argmin())]
        corner = np.where(own > best, high, low)
        near, far = corner - best, corner - own
        return left[(far * far).sum(axis=1) <= (near * near).sum(axis=1)]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a column for each centroid."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _blocks(most: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                points = np.floor(SCALE * part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, DIMS)
                tree = Tree(points)
                ids = part.column("vec_id").take(pa.array(tree.order))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in tree.packed())], ["vec_ids", "points", "boxes", "shape"])

    return scan


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("vec_ids")[i].values, Tree.unpacked(*(batch.column(c)[i].as_py() for c in ("points", "boxes", "shape")))


def _moments(centroids: np.ndarray):
    """Numbers and sums of the clusters of a task, and the distances measured."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, measured = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for _, tree in _trees(batches):
            for node, left in tree.assigned(centroids):
                a, b = tree.start[node], tree.stop[node]
                if len(left) == 1:
                    count[left[0]] += b - a
                    sums[left[0]] += tree.sums[node]
                    continue
                own = left[distances(tree.points[a:b], centroids[left]).argmin(axis=1)]
                measured += (b - a) * len(left)
                count += np.bincount(own, minlength=len(centroids))
                np.add.at(sums, own, tree.points[a:b])
        numbers = np.concatenate([sums, count[:, None], np.full((len(centroids), 1), measured)], axis=1)
        width = numbers.shape[1]
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(centroids)), width)), pa.array(np.tile(np.arange(width), len(centroids))), pa.array(numbers.ravel())], ["cluster", "place", "n"])

    return scan


def _final(centroids: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            own, far = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
            for node, left in tree.assigned(centroids):
                a, b = tree.start[node], tree.stop[node]
                found = distances(tree.points[a:b], centroids[left])
                best = found.argmin(axis=1)
                own[a:b], far[a:b] = left[best], found[np.arange(b - a), best]
            yield pa.record_batch([ids, pa.array(own), pa.array(far)], ["vec_id", "cluster", "distance"])

    return scan


def digest_of(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each
    vector that takes part. ``report`` gets ``vectors`` and ``measured``, the
    distances to single vectors that each round had to take."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "op13")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # NaN compares as greater than any number
    kept = kept.filter(f"size(embedding) = {DIMS} AND forall(embedding, x -> x IS NOT NULL AND abs(x) <= {MOST}D)")
    place = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    firsts = kept.filter("vec_id IS NOT NULL").withColumn("place", place).orderBy("place", "embedding").limit(clusters).collect()
    if not firsts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.floor(SCALE * np.array([r.embedding for r in firsts])).astype(np.int64)
    blocks = scratch.stage(kept.mapInArrow(_blocks(block), "vec_ids array<long>, points binary, boxes binary, shape binary"), "blocks")
    for _ in range(rounds):
        moved = blocks.mapInArrow(_moments(centroids), "cluster long, place long, n long")
        found = {(r.cluster, r.place): int(r.n) for r in moved.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
        if report is not None:
            report["vectors"] = sum(found[c, DIMS] for c in range(len(centroids)))
            report.setdefault("measured", []).append(found[0, DIMS + 1])
        centroids = np.array([[found[c, d] // found[c, DIMS] for d in range(DIMS)] if found[c, DIMS] else row.tolist() for c, row in enumerate(centroids)], np.int64)
    last = scratch.stage(blocks.mapInArrow(_final(centroids), "vec_id long, cluster int, distance long"), "assigned")
    scratch.drop("blocks")
    inertia = {r.cluster: int(r.n) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), digest_of(row.tolist())) for c, row in enumerate(centroids)]
    return last.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds spelled out, with all distances."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT v.rid, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, "
            f"min(CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * {CLUSTERS} + c.cluster) AS best FROM v, c{r} AS c GROUP BY v.rid)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY dim) AS e FROM (SELECT cluster, dim, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n "
                f"FROM (SELECT best % {CLUSTERS} AS cluster, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM a{r}) GROUP BY cluster, dim) GROUP BY cluster), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} AS c LEFT JOIN m{r} AS m ON m.cluster = c.cluster)"
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)) AND abs(x) <= {MOST})) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), e) - 1 AS cluster, e FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {CLUSTERS}),
{", ".join(steps)},
f AS (SELECT vec_id, CAST(best % {CLUSTERS} AS INT) AS cluster, CAST((best - best % {CLUSTERS}) / {CLUSTERS} AS BIGINT) AS distance FROM a{ROUNDS})
SELECT vec_id, f.cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} AS c ON c.cluster = f.cluster"""


SQL = _sql()
