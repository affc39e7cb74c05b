"""Continuous ingest and tagging with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tagging import tag


def deduplicated(stream: DataFrame, key: str = "hash", time: str = "occurred_at", delay: str = "1 day") -> DataFrame:
    """A stream without repeats of a natural key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, key: str = "hash"):
    """Merge each micro-batch of new keys; ``merge`` must be idempotent by key."""
    return deduplicated(stream, key).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tagged(stream: DataFrame, rules: list[dict], fields: tuple[str, ...]) -> DataFrame:
    """The batch tagging expression on a stream (stateless)."""
    return tag(stream, rules, fields)


def activity(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and value per window and type, for data that is late by at most ``delay``."""
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def activity_table(stream: DataFrame, path: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Run ``activity`` over all that has arrived, and return its table: for each window and type the latest state.

    Every micro-batch writes the states that it changed to its own folder below ``path``, so a repeated batch
    replaces its rows; both folders lie in shared storage.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark = stream.sparkSession
    running = activity(stream, window, delay)
    running.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{running.schema.simpleString()[7:-1].replace(':', ' ')}, batch bigint").parquet(path)
    latest = F.max_by(F.struct("events", "value"), "batch").alias("s")
    return rows.groupBy("start", "event_type").agg(latest).select("start", "event_type", "s.events", "s.value")
