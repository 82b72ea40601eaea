"""The durable request queue as Structured Streaming, and event-time windows.

Requests are files appended to a folder; draining is a stream over it. A bad row
gets an error and never holds up its batch; processed rows go to the output once,
by the checkpoint and a batch folder that is overwritten when a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as t
from quarrylight.operators.segment import segmented

SCHEMA = "id string, user_id string, llm_response string, user_message string, source_id string, created_at timestamp"


def enqueue(requests: DataFrame, path: str) -> None:
    """Append pending requests."""
    requests.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def processed(rows: DataFrame, most: int = 1200, least: int = 200) -> DataFrame:
    """A row for each segment, or one with status failed and an error."""
    bad = F.coalesce(t.strip("llm_response"), F.lit("")) == ""
    failed = rows.filter(bad).select("id", F.lit(0).alias("index"), F.lit("failed").alias("status"), F.lit("empty response").alias("error"), F.lit(None).cast("string").alias("text"), F.col("source_id"))
    done = segmented(rows.filter(~bad), "id", "llm_response", most, least).join(rows.select("id", "source_id"), "id")
    source = F.when(F.col("n_segments") > 1, t.chunk_source(F.col("source_id"), F.col("index"))).otherwise(F.col("source_id"))
    return done.select("id", "index", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), "text", source.alias("source_id")).unionByName(failed)


OUT = "id string, index int, status string, error string, text string, source_id string"


def drained(spark: SparkSession, out: str) -> DataFrame:
    """What ``drain`` wrote; no rows where no batch was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(out)


def drain(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 10, wait: bool = True, every: str = "5 seconds", most: int = 1200, least: int = 200):
    """Process what is pending; ``wait`` drains once and returns, else
    the query polls. Each batch writes a folder of its own, so a batch run again
    replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        processed(batch, most, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start() if wait else stream.trigger(processingTime=every).start()
    if wait:
        query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by tumbling window and type, with a watermark; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of a user by gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
