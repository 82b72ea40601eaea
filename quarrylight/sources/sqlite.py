"""SQLite files as a source and a sink.

``SqliteSource`` is a Spark data source, ``spark.read.format("sqlite")``: each file is
dealt to tasks by ranges of rowid, of which the driver reads only the ends; a task
opens the file read-only and takes the columns of the schema, so give one that has
just those that are needed. Filters that Spark offers narrow what SQLite returns and
are checked again by Spark, as SQLite's columns may hold values of any type; a value
that its column's type can't hold is null. A file without the table gives no rows.
Files have local paths that all executors see."""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

ROWS, BATCH = 50_000, 10_000
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: The parts of declared types that decide a column's affinity, in order.
_KINDS = {"INT": LongType(), "CHAR": StringType(), "CLOB": StringType(), "TEXT": StringType(), "BLOB": BinaryType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else sorted(glob.glob(path))


def _has(db: sqlite3.Connection, table: str) -> bool:
    return db.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (table,)).fetchone() is not None


class RowRange(InputPartition):
    """Rows of one file; ``first`` is None for a table without rowids."""

    def __init__(self, path: str, first: int | None, last: int | None):
        self.path, self.first, self.last = path, first, last


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table, self.paths, self.rows = schema, options["table"], options["path"], int(options.get("rows", ROWS))
        self.where, self.values = [], []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            sign, name = _OPERATORS.get(type(f)), getattr(f, "attribute", ())
            kind = kinds.get(name[0]) if len(name) == 1 else None
            plain = (kind == "string" and isinstance(f.value, str)) or (kind in ("bigint", "double") and isinstance(f.value, (int, float)) and not isinstance(f.value, bool)) if sign else False
            if plain:  # values of another type than the column's pass, for Spark to judge
                own = "('text')" if kind == "string" else "('integer', 'real')"
                self.where.append(f"({_quoted(name[0])} {sign} ? OR typeof({_quoted(name[0])}) NOT IN {own})")
                self.values.append(f.value)
            yield f

    def partitions(self) -> list[RowRange]:
        found = []
        for path in _files(self.paths):
            with closing(_open(path)) as db:
                if not _has(db, self.table):
                    continue
                try:
                    first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:
                    found.append(RowRange(path, None, None))
                    continue
                if first is not None:
                    found += [RowRange(path, a, min(last, a + self.rows - 1)) for a in range(first, last + 1, self.rows)]
        return found

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where there is no range at all
            return
        schema = to_arrow_schema(self.schema)
        where = [*self.where, *(["rowid BETWEEN ? AND ?"] if partition.first is not None else [])]
        values = [*self.values, *([partition.first, partition.last] if partition.first is not None else [])]
        with closing(_open(partition.path)) as db:
            db.text_factory = lambda raw: raw.decode("utf-8", "replace")
            names = {r[1] for r in db.execute(f"PRAGMA table_info({_quoted(self.table)})")}
            columns = [_quoted(n) if n in names else "NULL" for n in schema.names]
            rows = db.execute(f"SELECT {', '.join(columns) or 'NULL'} FROM {_quoted(self.table)}{' WHERE ' + ' AND '.join(where) if where else ''}", values)
            while part := rows.fetchmany(BATCH):
                arrays = [pa.array([_fit(r[k], f.type) for r in part], f.type) for k, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _fit(value: object, kind: pa.DataType) -> object:
    """``value`` as the column's type, or None."""
    try:
        if value is None:
            return None
        if pa.types.is_integer(kind):
            return int(value) if not isinstance(value, (bytes, float)) or value == int(value) else None
        if pa.types.is_floating(kind):
            return float(value)
        if pa.types.is_binary(kind):
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (ValueError, OverflowError, TypeError):
        return None


class SqliteSource(DataSource):
    """Options: ``path`` (a file, a pattern, or a folder of .db files), ``table``,
    ``rows`` (rowids a task). Without a schema, the table's own in the first file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        for path in _files(self.options["path"]):
            with closing(_open(path)) as db:
                if _has(db, self.options["table"]):
                    fields = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
                    kind = lambda t: next((k for part, k in _KINDS.items() if part in t.upper()), StringType())
                    return StructType([StructField(r[1], kind(r[2] or "")) for r in fields])
        raise ValueError(f"no file has a table {self.options['table']}")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, rows: int = ROWS) -> DataFrame:
    """A table of SQLite files; no rows where it is in none and ``schema`` is given."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("table", table).option("rows", str(rows))
    return (reader.schema(schema) if schema else reader).load(path)


def _written(folder: str, table: str, columns: list[tuple[str, str]]):
    names = [_quoted(n) for n, _ in columns]
    made = f"CREATE TABLE {_quoted(table)} ({', '.join(f'{n} {k}' for n, (_, k) in zip(names, columns))})"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}"
        with closing(sqlite3.connect(f"{path}.part")) as db:
            db.execute(made)
            n = 0
            for batch in batches:
                db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns)))
                n += batch.num_rows
            db.commit()
        os.rename(f"{path}.part", f"{path}.db")
        yield pa.record_batch([pa.array([f"{path}.db"]), pa.array([n])], ["path", "n_rows"])

    return scan


def write_sqlite(df: DataFrame, folder: str, table: str) -> list[str]:
    """A file for each partition of ``df``; the paths of those of tasks that ended well.
    Others, of tasks that ran twice, are removed."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}
    columns = [(f.name, kinds.get(f.dataType.simpleString(), "TEXT")) for f in df.schema]
    kept = [r.path for r in df.mapInArrow(_written(folder, table, columns), "path string, n_rows long").collect()]
    for path in glob.glob(f"{glob.escape(folder)}/*"):
        if path not in kept:
            os.remove(path)
    return kept
