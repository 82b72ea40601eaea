"""Size-tiered compaction of immutable shards under a versioned manifest.

``append`` writes arrivals as small shards and commits a manifest that lists
them beside those already there. ``compact`` takes, tier by tier, the shards of
similar size (tier t: ``LEAST * FANOUT**t`` bytes and up) where a tier holds
``FANOUT`` runs or more, and deals them, oldest first, into bins of about ``TARGET``
bytes, of which each becomes one file; shards from a half to one and a half of the
target are final and never rewritten, so a byte is rewritten about once for each
tier. A larger shard, as a large arrival may leave, is split by rows into files of
the target size. Both read files and write them with no shuffle, a task for each
bin, which holds at most ``FULL`` targets; up to ``AT_ONCE`` bins are one job. A manifest is a numbered log entry that becomes visible whole, by a
rename that fails if the number is taken; a writer that loses rereads and tries
again, and files no manifest lists are never read. Merged shards stay, so that a
reader of an earlier manifest finds them, until ``vacuum`` drops all manifests
before a version and what only they list.

Defined results: the table has the columns of all arrivals, in the order in which
they first came; a row lacks none of its own and is null where its arrival had no
such column; a column that comes with another type is refused before anything is
committed. Order within a shard is that of arrival, repeated rows and nulls are
stored as they are, texts of any length are stored whole; an empty arrival adds
no shard (but its columns); an empty table gives an empty manifest and an empty
result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarrylight.llm.common import CommitLog, drop_path, fresh_dir

TARGET, LEAST, FANOUT = 32 << 20, 1 << 20, 4
FULL, OVER, AT_ONCE = 1.25, 1.5, 64


def merged_schema(known: str | None, new: StructType) -> str:
    """The columns of both, as JSON; raises if one changes its type."""
    fields = list(StructType.fromJson(json.loads(known)).fields) if known else []
    types = {f.name: f.dataType for f in fields}
    for f in new.fields:
        if f.name not in types:
            fields.append(StructField(f.name, f.dataType, True))
        elif types[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return StructType(fields).json()


class Shards:
    """A table of Parquet shards under ``root``."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)
        self.target, self.least, self.fanout = target, least, fanout

    def manifest(self) -> dict:
        return self.log.latest()[1] or {"shards": [], "schema": None}

    def tier(self, n_bytes: int) -> int:
        """-1: final or larger. Else the number of times ``fanout`` fits above ``least``."""
        if n_bytes >= self.target // 2:
            return -1
        t, bound = 0, self.least
        while n_bytes >= bound * self.fanout:
            t, bound = t + 1, bound * self.fanout
        return t

    def _written(self, path: str) -> list[dict]:
        """Shards of a folder just written: path, bytes, rows."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        sizes = {s.getPath().getName(): s.getLen() for s in listed if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        rows = self.spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).count().collect()
        return [{"path": f"{path}/{r['name']}", "bytes": sizes[r["name"]], "rows": r["count"]} for r in sorted(rows)]

    def _commit(self, gone: set[str], new: list[dict], columns: StructType | None = None, tries: int = 20) -> bool:
        """Replace ``gone`` by ``new``; False if some of ``gone`` was replaced
        meanwhile. ``columns``: those of an arrival."""
        for _ in range(tries):
            version, state = self.log.latest()
            state = state or {"shards": [], "schema": None}
            if not gone <= {s["path"] for s in state["shards"]}:
                return False
            schema = merged_schema(state["schema"], columns) if columns is not None else state["schema"]
            if self.log.commit(version + 1, {"shards": [s for s in state["shards"] if s["path"] not in gone] + new, "schema": schema}):
                return True
        raise RuntimeError("the manifest could not be committed")

    def append(self, arrivals: DataFrame) -> int:
        """Store ``arrivals`` as new shards; returns how many."""
        merged_schema(self.manifest()["schema"], arrivals.schema)
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        arrivals.write.parquet(path)
        new = self._written(path)
        self._commit(set(), new, arrivals.schema)
        return len(new)

    def plan(self) -> list[list[dict]]:
        """What to rewrite: bins of similarly sized shards, oldest first, that become
        one file each, and single shards beyond ``OVER`` targets, which are split."""
        tiers: dict[int, list[dict]] = {}
        shards = self.manifest()["shards"]
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        bins = [[s] for s in shards if s["bytes"] > OVER * self.target and s["rows"] > 1]
        for t, runs in sorted(tiers.items()):
            if t >= 0 and len(runs) >= self.fanout:
                bins += [b for b in self._bins(runs) if len(b) > 1]
        return bins

    def _bins(self, runs: list[dict]) -> list[list[dict]]:
        out, total = [[]], 0
        for s in runs:
            if total and total + s["bytes"] > FULL * self.target:
                out.append([])
                total = 0
            out[-1].append(s)
            total += s["bytes"]
        return out

    def compact(self) -> int:
        """Rewrite until no tier is full; returns the number of bins rewritten."""
        done = 0
        while bins := self.plan():
            found = sum(self._rewrite(bins[k : k + AT_ONCE]) for k in range(0, len(bins), AT_ONCE))
            done += found
            if not found:
                break
        return done

    def _rewrite(self, bins: list[list[dict]]) -> int:
        """Write each bin by a task of its own and commit it; returns how many were not
        replaced meanwhile. A file's name tells its task, and so its bin."""
        path, schema, rows, most = f"{self.root}/merged-{uuid.uuid4().hex}", self.manifest()["schema"], None, 0
        splits = [b for b in bins if len(b) == 1]
        if splits and len(splits) < len(bins):
            return self._rewrite(splits) + self._rewrite([b for b in bins if len(b) > 1])
        for group in bins:
            own = self._read([s["path"] for s in group], schema).coalesce(1)
            rows = own if rows is None else rows.union(own)
        if splits:  # rows a file such that the largest bytes a row come to a target
            most = max(1, min(int(s["rows"] / max(2, round(s["bytes"] / self.target))) + 1 for b in splits for s in b))
        rows.write.option("maxRecordsPerFile", most).parquet(path)
        files: dict[int, list[dict]] = {}
        for s in self._written(path):
            files.setdefault(int(s["path"].rsplit("/part-", 1)[1][:5]), []).append(s)
        return sum(self._commit({s["path"] for s in group}, files.get(k, [])) for k, group in enumerate(bins))

    def vacuum(self, version: int | None = None) -> int:
        """Drop manifests before ``version`` (the latest, if not given) and the
        shards that none from there on lists; returns how many shards."""
        versions = self.log.versions()
        version = versions[-1] if version is None and versions else version
        old, kept = [v for v in versions if v < version], [v for v in versions if v >= version] if versions else []
        used = {s["path"] for v in kept for s in self.log.read(v)["shards"]}
        gone = {s["path"] for v in old for s in self.log.read(v)["shards"]} - used
        for path in sorted(gone):
            drop_path(self.spark, path)
        for v in old:
            drop_path(self.spark, f"{self.root}/_log/{v:020d}.json")
        return len(gone)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table of the latest manifest, or of ``version``; None before the
        first shard."""
        state = self.manifest() if version is None else self.log.read(version)
        return self._read([s["path"] for s in state["shards"]], state["schema"]) if state["shards"] else None


def sharded(docs: DataFrame, arrivals: int = 4) -> DataFrame:
    """Store ``docs`` in ``arrivals`` appends with compaction after each, then
    read the table back: doc_id, shard (its file), shard_rows, shard_bytes and
    manifest_version of every row."""
    spark = docs.sparkSession
    table = Shards(spark, fresh_dir(spark, "shards"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for a in range(arrivals):
        table.append(docs.filter(part == a))
        table.compact()
        table.vacuum()
    schema = "doc_id long, shard string, shard_rows long, shard_bytes long, manifest_version long"
    rows = table.read()
    if rows is None:
        return spark.createDataFrame([], schema)
    listed = [(s["path"].rsplit("/", 1)[-1], s["rows"], s["bytes"]) for s in table.manifest()["shards"]]
    sizes = F.broadcast(spark.createDataFrame(listed, "shard string, shard_rows long, shard_bytes long"))  # one row a file
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard")).join(sizes, "shard")
    return found.select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(table.log.latest()[0]).cast("long").alias("manifest_version"))
