"""Streaming twins of the batch operators: ingest, scoring, gates, upserts, windows, sessions, alarms.

Every job is a function from a streaming frame to a streaming frame, so that sink, trigger and
checkpoint are the caller's. ``drain`` runs one to the end of what is available.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark.functions import scores as S
from quillspark.operators import gating, metrics as M
from quillspark.operators.sessions import latest_per_key
from quillspark.session import shared_folder
from quillspark.sources import keyed, writers
from quillspark.streaming.stateful import beat, ended_sessions, session_turns, streak_alarms

__all__ = [
    "activity_sessions", "drain", "ended_sessions", "events_stream", "first_requests", "gate_stream", "hit_counts", "impact_stream",
    "ingest_log", "keep_latest", "rolling", "score_stream", "session_turns", "streak_alarms", "upsert_to", "wizard_stream",
]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """One of the general tables as a stream of its files."""
    base = folder.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    # a bracket makes the path a pattern, which the file source takes for a single file too
    pattern = f"{base}/{name[:-1]}[{name[-1]}].parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def ingest_log(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as they are appended: rows that parse, and the text of those that do not."""
    lines = spark.readStream.text(folder)
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", marked, {"columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    return parsed.filter("_r._bad is null").select("_r.*").drop("_bad"), parsed.filter("_r._bad is not null").select("value")


def score_stream(history: DataFrame) -> DataFrame:
    """Scores of events as they arrive; stateless, prices are a broadcast of a fixed table."""
    return M.score_events(history)


def gate_stream(outputs: DataFrame, text: str, template: str) -> DataFrame:
    return gating.gate_report(outputs, text, template)


def impact_stream(events: DataFrame) -> DataFrame:
    """Reactions per user as they come in."""
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    totals = events.groupBy("user_id").agg(
        count("click").alias("copy_count"), count("error").alias("regeneration_count"), count("view").alias("reuse_count")
    )
    user = F.col("user_id")
    return M.with_impact(totals.withColumn("feedback_score", F.when(user % 7 != 0, (1 + user % 5).cast("int"))))


def first_requests(requests: DataFrame, key: str, time: str, within: str = "10 minutes") -> DataFrame:
    """Requests not seen before within the delay."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def hit_counts(requests: DataFrame, key: str) -> DataFrame:
    """Repeats per key: accesses less the first."""
    return requests.groupBy(key).agg((F.count("*") - 1).alias("hits"))


def rolling(events: DataFrame, time: str, value: str, keys: Sequence[str], size: str, slide: str | None, delay: str) -> DataFrame:
    """Mean of a value over tumbling or sliding windows of event time."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        events.withWatermark(time, delay)
        .groupBy(span.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean")
    )


def activity_sessions(events: DataFrame, key: str, time: str, gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Spans of activity of a key without a pause of ``gap``."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def wizard_stream(turns: DataFrame, max_turns: int = 3, clear: Column | None = None, delay: str = "10 minutes") -> DataFrame:
    """Wizard state after every message of ``conv_id, turn, role, ts``; a day's pause starts it anew."""
    states = session_turns(turns, "conv_id", "ts", "turn", max_turns, clear, delay=delay)
    out = states.select("conv_id", "turn", "turn_number", "current_turn", "resolved", "remaining")
    out.heartbeats = states.heartbeats
    return out


def upsert_to(path: str):
    """A batch writer whose repeats replace themselves."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.upsert_metrics(batch, path, batch_id)

    return write


def keep_latest(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = keyed.BUCKETS
) -> DataFrame:
    """Puts a stream into a table with one row per key, batch by batch, and returns the table.

    A batch that a restart repeats is recognised by its id. Neither the stream nor a batch keeps state for a key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(batch, path, batch_id, keys, order, buckets)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return keyed.read_keyed(stream.sparkSession, path, stream.schema)


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] | None = None, stateful_python: bool = False) -> DataFrame:
    """Runs a stream over all that is available and returns what it wrote.

    With ``keys`` the rows are updates, of which the last per key counts. A stream that waits for its
    watermark is then told that the input has ended, so that rows and timers still waiting are dealt with.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/quillspark/stream-{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    if stateful_python:
        spark.conf.set(name, ROCKSDB)
    try:
        def run() -> None:
            query = (
                stream.writeStream.outputMode(mode).foreachBatch(upsert_to(f"{base}/rows"))
                .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()

        run()
        if heartbeats := getattr(stream, "heartbeats", None):
            beat(spark, heartbeats)
            run()
    finally:
        spark.conf.set(name, before)
    shape = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    written = spark.read.schema(shape).parquet(f"{base}/rows")
    if keys is None:
        return written.drop("batch")
    return latest_per_key(written, list(keys), [F.desc("batch")]).drop("batch")
