"""Frozen rankings in one table, partitioned by snapshot.

A ranking of any length is numbered over all tasks (``keyed.numbered``) and written as the partition of its snapshot, over what a broken attempt
may have left there. Reading some snapshots reads their partitions alone; comparing two joins two partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .keyed import numbered
from .scoring import compare, delta
from .store import begun


class Snapshots:
    """The table at ``path``: (id, rank, score, occurred_at, snapshot_id)."""

    SCHEMA = "id long, rank long, score double, occurred_at timestamp, snapshot_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        begun(spark, path, self.SCHEMA)

    def freeze(self, scored: DataFrame, snapshot_id: str) -> None:
        """Rank (id, score, occurred_at) by score, then by time, then by id, all falling, and keep it as ``snapshot_id``."""
        order = [F.desc("score"), F.col("occurred_at").desc_nulls_last(), F.desc("id")]
        rows = scored.select(F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.col("occurred_at").cast("timestamp").alias("occurred_at"))
        ranked = numbered(rows, order, "rank", lambda df: stored(df, "ranking")).select("id", "rank", "score", "occurred_at", F.lit(snapshot_id).alias("snapshot_id"))
        ranked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self.path)

    def items(self, *snapshot_ids: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("snapshot_id").isin(*snapshot_ids))

    def delta(self, old: str, new: str) -> DataFrame:
        return delta(self.items(old), self.items(new))

    def compare(self, base: str, target: str) -> DataFrame:
        return compare(self.items(base), self.items(target))
