"""Incremental feeds as Structured Streaming: trace tail, latest status, windowed throughput, exactly-once merge.

Each feed is a transformation from a streaming DataFrame, so it runs on any source; `drain` runs one to the end of
what is there (availableNow) and returns its rows, for tests and batch callers.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.registry import query
from lakewright.plans.written import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of Parquet files."""
    folder, name = os.path.split(path)
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(folder if path.startswith("/") and os.path.isfile(path) else path)
    own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (stream.where(own == name) if name.endswith(".parquet") and os.path.isfile(path) else stream).withColumn("ts", F.col("ts").cast("timestamp"))


def trace_tail(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Steps in arrival order, each step id once within the watermark; state older than it is freed."""
    steps = events.select(F.concat(F.lit("step:"), F.col("event_id").cast("string")).alias("step_id"), "ts", "user_id", "event_type")
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["step_id"])


def status_latest(events: DataFrame) -> DataFrame:
    """The newest state per user: (user_id, state, at, changes)."""
    newest = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(newest.alias("n"), F.count("*").alias("changes")).select("user_id", F.col("n.event_type").alias("state"), F.unix_micros(F.col("n.ts")).alias("at_us"), "changes")


def throughput(events: DataFrame, size: str = "60 minutes", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Steps and failures per sliding window; rows later than the watermark are dropped by the engine."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return windows.select(F.unix_micros(F.col("window.start")).alias("start_us"), "steps", "failures")


def sessions(events: DataFrame, gap: str = "10 hours", late: str = "1 day") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros(F.col("session_window.start")).alias("first_us"), "n")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all that is there and returns its output, which executors write and read: nothing of it passes the driver.

    A batch that is tried again replaces its own rows.  Of a complete output only the last batch counts.
    """
    spark, path, batches = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/feeds/{uuid.uuid4().hex}", set()

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        batches.add(number)

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    found = [f"{path}/rows/{number}" for number in sorted(batches)]
    return spark.read.schema(stream.schema).parquet(*(found if mode == "append" else found[-1:])) if found else spark.createDataFrame([], stream.schema)


@query("stream_trace_tail", "SELECT 'step:' || CAST(event_id AS VARCHAR) AS step_id, user_id, event_type FROM events")
def stream_trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(trace_tail(read_events(spark, f"{sf_dir}/events.parquet")), "append").select("step_id", "user_id", "event_type")


@query("stream_status_latest", "SELECT user_id, max_by(event_type, epoch_us(ts) * 1000 + event_id % 1000) AS state, max(epoch_us(ts)) AS at_us, count(*) AS changes FROM events GROUP BY user_id")
def stream_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(status_latest(read_events(spark, f"{sf_dir}/events.parquet")), "complete")


@query(
    "stream_throughput",
    """SELECT start_us, count(*) AS steps, count_if(event_type = 'error') AS failures FROM (
    SELECT event_type, unnest([epoch_us(ts) // 900000000 * 900000000 - CAST(900000000 AS BIGINT) * k FOR k IN [0, 1, 2, 3]]) AS start_us FROM events) GROUP BY start_us""",
)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(throughput(read_events(spark, f"{sf_dir}/events.parquet")), "complete")


@query("stream_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed twice over: every step counts once."""
    events = read_events(spark, f"{sf_dir}/events.parquet")
    return drain(trace_tail(events.union(read_events(spark, f"{sf_dir}/events.parquet"))), "append").groupBy("event_type").agg(F.count("*").alias("n"))
