"""Dictionary-compressed WARC archives: write and read back.

Each archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that
holds the Zstandard dictionary, then one frame for each record, so any record
can be read alone once the dictionary is known. The dictionary is trained on a
bounded sample of the records to be archived: ``SAMPLE`` records by hash of
page_id, the first ``SAMPLE_BYTES`` of each; what is archived is whole.

Records of equal payloads (SHA-1 and length) of at least ``LEAST`` bytes are
stored once: that with the largest page_id is a response, the others revisit
it. The groups are partial aggregates over payload hashes; pages are joined only
with those of two rows or more, a join that splits hot payloads, and not at all
where every payload is unique.

A task writes its archives to the shared folder under names that hold its
attempt, so a task run again or twice at once touches no file of another, and
reports them as it ends. Spark commits these reports to an index, and archives
that it does not list are never read.

Defined results: a null html is an empty payload; a null page_id is left out of
the header and read back as null, and never is what others revisit unless all
are null (then one is the response); of rows that repeat the largest page_id of
a payload one is the response and the others revisit it; payloads of any length
are kept whole; a null url is written as ``urn:none``; extra columns are
ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import fresh_dir, hash_sample, staged

MAGIC, ROLL, LEVEL = 0x184D2A5D, 16 << 20, 6
SAMPLE, SAMPLE_BYTES, DICTIONARY, LEAST = 1000, 4096, 64 << 10, 0
FILES, INDEX = 4096, "name string, n_records long, n_bytes long"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response, or a revisit of the page ``refers_to``."""
    digest = digest32(payload)
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers_to)))
    block = HTTP if revisit else HTTP + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; raises if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of ``samples``, or nothing if there are too few to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Bytes of one archive."""

    def __init__(self, dictionary: bytes):
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self.parts, self.size = [struct.pack("<II", MAGIC, len(packed)) + packed], len(packed) + 8
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'warcinfo')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "18")]) + b"format: WARC/1.1\r\n" + b"\r\n\r\n")

    def add(self, raw: bytes) -> None:
        frame = self._compressor.compress(raw)
        self.parts.append(frame)
        self.size += len(frame)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, each decompressed on its own."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + n])
    maker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    at, view = 8 + n, memoryview(archive)
    while at < len(archive):
        one = maker.decompressobj()
        raw, start = one.decompress(view[at : at + 65536]), at
        at += 65536
        parts = [raw]
        while not one.eof:
            if at >= len(archive):
                raise ValueError("a record is cut off")
            parts.append(one.decompress(view[at : at + 65536]))
            at += 65536
        at = min(at, len(archive)) - len(one.unused_data)
        if at <= start:
            raise ValueError("an empty frame")
        yield parse(b"".join(parts))


def _write(root: str, dictionary: bytes, roll: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        store.create_dir(path, recursive=True)
        number, writer, count, done = 0, None, 0, []

        def close() -> None:
            nonlocal number, writer, count
            name = f"part-{part:05d}-{number:04d}-{attempt}.warc.zst"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:  # compressed already
                for x in writer.parts:
                    out.write(x)
            done.append((name, count, writer.size))
            number, writer, count = number + 1, None, 0

        for batch in batches:
            for row in batch.to_pylist():
                writer = writer or Writer(dictionary)
                writer.add(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"]))
                count += 1
                if writer.size >= roll:
                    close()
        if writer:
            close()
        yield pa.RecordBatch.from_pylist([{"name": n, "n_records": c, "n_bytes": b} for n, c, b in done], schema=pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return scan


def _read(root: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_file(f"{path}/{name}") as f:
                    content = f.read()
                out = []
                for fields, payload in records(content):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError("a payload does not match its digest")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    out.append((page and int(page), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, refers and int(refers), payload.decode() if kind == "response" else None))
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return scan


def _with_references(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, refers_to and revisit of every row."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keys = {"sha": F.sha1(body.cast("binary")), "n": F.octet_length(body).cast("long")}
    where = F.struct(F.col("url").isNull().alias("none"), F.coalesce("url", F.lit("")).alias("url"))
    hashed = pages.select("page_id", where.alias("w"), *[v.alias(k) for k, v in keys.items()]).filter(F.col("n") >= least)
    by_page = hashed.groupBy("sha", "n", "page_id").agg(F.count("*").alias("c"), F.min("w").alias("w"))
    share = by_page.groupBy("sha", "n").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "c", "w")).alias("top"), F.sum("c").alias("copies"))
    share = staged(share.filter("copies > 1").select("sha", "n", F.col("top.page_id").alias("refers_to"), F.col("top.c").alias("c"), F.col("top.w").alias("w")), "op10-shared")
    many, ties = share.agg(F.count("*"), F.count_if(F.col("c") > 1)).first()
    if not many:
        return pages.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    rows = pages.withColumns(keys).join(share, ["sha", "n"], "left")
    lead = F.col("c").isNotNull() & F.col("page_id").eqNullSafe(F.col("refers_to"))
    out = rows.withColumn("revisit", F.col("c").isNotNull() & ~lead)
    if ties:
        # rows that repeat the largest page_id: equal rows are one row and a count until one is picked
        tied = rows.filter(lead & (F.col("c") > 1)).groupBy("sha", "n", "page_id", "url", "refers_to", "w").agg(F.first("html").alias("html"), F.count("*").alias("k"))
        tied = tied.withColumn("i", F.explode(F.expr("sequence(1L, k)"))).withColumn("revisit", (F.col("i") > 1) | ~F.col("w").eqNullSafe(where))
        names = ["page_id", "url", "html", "refers_to", "revisit"]
        out = out.filter(~lead | (F.col("c") == 1)).select(names).unionByName(tied.select(names))
    return out.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit")


def archive(pages: DataFrame, root: str, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` to archives under the folder ``root``, and under
    ``root/_index`` the names, records and bytes of those that finished tasks
    reported; returns the index."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = hash_sample(pages.withColumn("html", F.substring("html", 1, SAMPLE_BYTES)), "page_id", pages.count(), SAMPLE).collect()
    dictionary = train([record(r.page_id, r.url, (r.html or "").encode(), None, False)[:SAMPLE_BYTES] for r in sample])
    _with_references(pages, least).mapInArrow(_write(root, dictionary, roll), INDEX).write.parquet(f"{root}/_index")
    return spark.read.schema(INDEX).parquet(f"{root}/_index")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """All page records of the archives that ``root``'s index lists: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, html (null for a
    revisit, whose payload its response holds)."""
    names = spark.read.schema(INDEX).parquet(f"{root}/_index").select("name")
    return names.repartition(max(1, min(names.count(), FILES)), "name").mapInArrow(_read(root), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    root = fresh_dir(spark, "warc")
    root = root if "://" in root else f"file://{root}"
    archive(pages, root, least)
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 has 32 characters of five bits each.
SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY s, n) AS top, row_number() OVER (PARTITION BY s, n ORDER BY page_id DESC NULLS LAST, url NULLS LAST) AS place FROM p
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to
FROM g
"""
