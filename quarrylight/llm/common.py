"""Helpers that the pipeline operators share: staged tables in the shared
folder, an atomic commit log, and a bounded membership filter."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: maximal runs of anything but ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20


#: Folders of staged tables that this process wrote and has not dropped.
_LIVE: dict[str, None] = {}
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where that is unset, a local session gets a private folder,
    removed at exit; any other raises, as its executors could not read one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quarrylight-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        found = f"file://{_OWN[0]}"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quarrylight/{label}-{uuid.uuid4().hex}"
    _LIVE[path] = None
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage:
    a lost executor costs no recomputation of what lies before."""
    return _stage(df, label)[0]


def _stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LIVE.pop(path, None)


def live() -> list[str]:
    """Folders of staged tables that this process wrote and has not dropped."""
    return list(_LIVE)


def release(spark: SparkSession, keep: DataFrame | None = None, among: list[str] | None = None) -> None:
    """Drop what this process staged (or of it those ``among``), but what ``keep``
    reads. For callers that have written an operator's result and need its tables
    no more."""
    paths = [p for p in _LIVE if among is None or p in among]
    read = keep.inputFiles() if keep is not None and paths else []
    for path in paths:
        if not any(f"{path.split('://', 1)[-1]}/" in f for f in read):
            drop_path(spark, path)


class Scratch:
    """The staged tables of one run of an operator, dropped by name once their
    last reader has been written. What a lazy result still reads stays until
    ``release``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _stage(df, f"{self.label}-{name}")
        self.paths.setdefault(name, []).append(path)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                drop_path(self.spark, path)


class CommitLog:
    """Numbered immutable JSON entries under ``root/_log``.

    An entry becomes visible by a rename that fails if the number is taken, so
    of two writers one wins and the other must reread; readers see an entry
    whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (-1, None)

    def commit(self, version: int, entry: dict) -> bool:
        """True if ``entry`` is now version ``version``; False if it was taken."""
        target = self._path(f"{self.root}/_log/{version:020d}.json")
        if self._fs.exists(target):
            return False
        temp = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, target, none)
        except Exception:
            self._fs.delete(temp, False)
            if self._fs.exists(target):
                return False
            raise
        return True


def _flagged(df: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int, most_bits: int) -> DataFrame:
    bits = 1 << 16
    while bits < most_bits and bits < 64 * max(1, n_keys):
        bits <<= 1
    place = f"pmod(xxhash64(`{{}}`), {bits})"
    bitmap = (
        keys.selectExpr(f"shiftright({place.format(key)}, 6) AS _bw", f"shiftleft(1L, cast({place.format(key)} & 63 AS int)) AS _bm")
        .groupBy("_bw")
        .agg(F.expr("bit_or(_bm)").alias("_bm"))
    )
    found = df.withColumn("_bh", F.expr(place.format(column))).withColumn("_bw", F.expr("shiftright(_bh, 6)"))
    return found.join(F.broadcast(bitmap), "_bw", "left").withColumn("_hit", F.expr("coalesce(shiftright(_bm, cast(_bh & 63 AS int)) & 1L = 1L, false)"))


def split_by(df: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int, most_bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(may, never): rows of ``df`` whose ``column`` may be among ``keys[key]``, and
    those where it surely is not. A one-hash bitmap decides, so nothing of ``df``
    is shuffled; it has at most ``most_bits / 64`` rows (512 Ki) and may be
    broadcast at any input size. A join that decides exactly must follow for the
    first part."""
    flagged = _flagged(df, column, keys, key, n_keys, most_bits)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return flagged.filter("_hit").select(*columns), flagged.filter("NOT _hit").select(*columns)


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int, most_bits: int = 1 << 25) -> DataFrame:
    """The first part of ``split_by``."""
    return split_by(df, column, keys, key, n_keys, most_bits)[0]


def hash_sample(df: DataFrame, key: str, n_rows: int, size: int) -> DataFrame:
    """About 1.5 ``size`` rows, cut to ``size``, by hash of ``key``. The bound is
    met before rows move, so what reaches the driver does not grow with ``df``."""
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40))
    bound = (1 << 40) if n_rows <= 2 * size else int((1 << 40) * 1.5 * size / n_rows)
    return df.withColumn("_place", place).filter(F.col("_place") < bound).orderBy("_place", key).limit(size).drop("_place")


def give_back() -> None:
    """Return what a worker has freed to the machine: workers live on from stage to
    stage, and the C library keeps freed blocks of up to 32 MB."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        a, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(a, i - a)
                a, total = i, 0
            total += int(n)
        if a < batch.num_rows:
            yield batch.slice(a)
