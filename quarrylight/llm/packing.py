"""Order-preserving packing into fixed windows by dynamic programming.

The ids of all documents of an input partition form one stream in reading
order. Windows are consecutive pieces of it, of at most ``size`` ids, and start
and end at a document or sentence end. With f(j) the least cost up to boundary
j at position x(j),

    f(j) = penalty(j) + size - x(j) + min over x(j) - x(i) <= size of f(i) + x(i)

so the minimum over the sliding range is kept by a monotone queue, and each
boundary costs constant time. The penalty is nothing at a document end,
``SENTENCE`` ids at a sentence end and ``FORCED`` within a long
sentence. At the end of a partition the windows of a power of two,
which need no padding, are added as transitions and positions within sentences
as boundaries, so the tail costs little.

The stream is taken in blocks of about ``BLOCK`` ids; what lies behind a block's
last window is carried to the next, so memory does not grow with the partition. Each
partition packs on its own: there is no shuffle, nothing meets in one task, and
a task run again after a loss gives the same windows.

Defined results: a null or empty text has one id, the end id; repeated rows and
null doc_ids are packed like others; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tokens import END, encode, sentence_ends

SIZE, SENTENCE, FORCED, BLOCK = 2048, 2, 64, 1 << 19
#: In a sentence of more than WIDE ids, each STEP-th position is a boundary too.
WIDE, STEP = 512, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padding(n: int, size: int = SIZE) -> int:
    return 0 if n & (n - 1) == 0 else size - n


def cuts(at: np.ndarray, penalty: np.ndarray, size: int, powers: bool = False, more: bool = False) -> list[int]:
    """Positions of the window ends of least cost. ``at``: ascending boundaries,
    from 0 to the end; no two neighbours are more than ``size`` apart. ``more``:
    the stream goes on, so the last window may end anywhere in the last ``size``."""
    x, pay = at.tolist(), penalty.tolist()
    n = len(x)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    index = {p: i for i, p in enumerate(x)} if powers else {}
    steps = [1 << b for b in range(size.bit_length() - 1) if 1 << b < size] if powers else []
    for j in range(1, n):
        here = x[j]
        low = here - size
        while x[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        cost = value + size - here
        for s in steps:
            k = index.get(here - s)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += pay[j]
        best[j], back[j] = cost, i
        value = cost + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], n - 1
    if more:
        j = min((k for k in range(n - 1, 0, -1) if x[k] >= x[-1] - size), key=best.__getitem__)
    while j:
        out.append(x[j])
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, size: int, ends: np.ndarray, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a stream and their penalties; ``tail``: also each
    position of the last windows."""
    n = len(ids)
    mark = np.zeros(n + 1, np.int8)
    mark[1:][ends[ids]] = 1
    if tail:
        near = mark[max(1, n - size) :]
        near[near == 0] = 3
    mark[doc_ends] = 2
    mark[0] = mark[n] = 2
    at = np.flatnonzero(mark)
    wide = np.flatnonzero(np.diff(at) > min(WIDE, size))
    if len(wide):
        more = np.concatenate([np.arange(at[i] + STEP, at[i + 1], STEP) for i in wide])
        mark[more] = 3
        at = np.flatnonzero(mark)
    cost = np.array([0, SENTENCE, 0, FORCED], np.float64)[mark[at]]
    return at, cost


def _pack(size: int, block: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        ends = sentence_ends()
        # documents not yet packed whole: [doc_id, ids left, ids before them, ids of the document]
        open_docs: list[tuple] = []
        total = 0

        def flush(last: bool):
            nonlocal open_docs, total, sequence
            ids = np.concatenate([d[1] for d in open_docs])
            doc_ends = np.cumsum([len(d[1]) for d in open_docs])
            at, cost = boundaries(ids, doc_ends, size, ends, last)
            found = cuts(at, cost, size, last, not last)
            rows, a, d, done = [], 0, 0, 0
            for c in found:
                p = a
                while p < c:
                    doc_id, own, before, whole = open_docs[d]
                    take = min(c - p, done + len(own) - p)
                    s = p - done
                    rows.append((doc_id, before + s, take, zlib.crc32(own[s : s + take].tobytes()), whole, sequence, p - a))
                    p += take
                    if p == done + len(own):
                        done += len(own)
                        d += 1
                a = c
                sequence += 1
            rest = open_docs[d:]
            if rest and a > done:
                doc_id, own, before, whole = rest[0]
                rest[0] = (doc_id, own[a - done :], before + a - done, whole)
            open_docs, total = rest, sum(len(r[1]) for r in rest)
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                open_docs.append((doc_id, ids, 0, len(ids)))
                total += len(ids)
                if total >= block:
                    yield flush(False)
        if open_docs:
            yield flush(True)

    return scan


def packed(docs: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(size, block), SCHEMA)
