"""Nearest vectors by blocked matrix products.

Rows of a user are packed into blocks of one dimension, each a matrix with its rows'
norms; blocks of queries meet blocks of vectors by user, and a task multiplies two
blocks at a time and keeps the best ``limit`` of each query. So work is the products,
what moves is blocks and not pairs, and a user of any size is spread over tasks by the
blocks. The best of all blocks are cut again by rank.

A cosine is taken over the shorter of two lengths, as stored text embeddings of
different models may meet; it is 0 where that or a norm is 0. A null component
counts as 0, a null vector as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

HELD, ASKED, PLACES = 4096, 256, 12


def _packed(most: int, out: pa.Schema):
    """Blocks of at most ``most`` rows of a user and dimension, of a task's rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def block(key: tuple) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(key))
            matrix = np.array(rows, np.float64).reshape(len(rows), key[1])
            return pa.RecordBatch.from_pylist([{"user_id": key[0], "dim": key[1], "ids": list(ids), "matrix": matrix.tobytes()}], out)

        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("user_id", "embedding")]
            for user, v, *ids in zip(batch.column("user_id").to_pylist(), batch.column("embedding").to_pylist(), *(batch.column(n).to_pylist() for n in names)):
                v = [0.0 if x is None else x for x in v or []]
                rows = held.setdefault((user, len(v)), [])
                rows.append((dict(zip(names, ids)), v))
                if len(rows) == most:
                    yield block((user, len(v)))
        for key in list(held):
            yield block(key)

    return scan


def _blocks(df: DataFrame, ids: list[str], most: int) -> DataFrame:
    rows = df.select("user_id", F.col("embedding").cast("array<double>").alias("embedding"), *ids)
    schema = StructType([df.schema["user_id"], StructField("dim", IntegerType()), StructField("ids", ArrayType(StructType([df.schema[c] for c in ids]))), StructField("matrix", BinaryType())])
    return rows.mapInArrow(_packed(most, to_arrow_schema(schema)), schema)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all of ``b`` over the shorter length."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return np.where(norms > 0, a @ b.T / np.where(norms > 0, norms, 1.0), 0.0).round(PLACES)


def _best(limit: int, out: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in batch.schema.names}
                asked, held = (np.frombuffer(r[m].as_py(), np.float64).reshape(len(r[k]), r[d].as_py()) for m, k, d in (("q_matrix", "q_ids", "q_dim"), ("matrix", "ids", "dim")))
                found, q, ids = cosines(asked, held), r["q_ids"].as_py(), r["ids"].as_py()
                order = np.array(sorted(range(len(ids)), key=lambda j: (str(ids[j].get("table")), ids[j]["id"])), np.int64)  # ties go by table and id
                rows = []
                for k, row in enumerate(found[:, order]):
                    top = np.argsort(-row, kind="stable")[:limit]
                    rows += [{"user_id": r["user_id"].as_py(), "qid": q[k]["qid"], **ids[order[j]], "vector": float(row[j])} for j in top]
                yield pa.RecordBatch.from_pylist(rows, out)

    return scan


def vector_top(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(user_id, qid, table, id, vector, rank) of the ``limit`` best cosines
    of each query, ties by table and id. ``queries``: user_id, qid, q_embedding;
    ``vectors``: user_id, table, id, embedding, ids not null."""
    held = _blocks(vectors, ["table", "id"], HELD)
    asked = _blocks(queries.withColumnRenamed("q_embedding", "embedding"), ["qid"], ASKED)
    asked = asked.select("user_id", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    fields = [vectors.schema["user_id"], queries.schema["qid"], vectors.schema["table"], vectors.schema["id"], StructField("vector", DoubleType())]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    found = held.join(asked, "user_id").mapInArrow(_best(limit, to_arrow_schema(schema)), schema)
    order = Window.partitionBy("user_id", "qid").orderBy(F.col("vector").desc(), "table", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
