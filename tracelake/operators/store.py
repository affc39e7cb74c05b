"""A keyed event table in hash buckets that small batches are merged into.

The table is Parquet, partitioned by ``bucket``, the hash of the key modulo a fixed number. A batch is merged as insert-if-absent with blanks
filled: rows of new keys are appended, and only buckets in which some row changes are written again, by
Spark's dynamic partition overwrite. The store is never shuffled: of the buckets that a batch touches, key and fillable columns are read and met
by the batch's rows, broadcast while they are at most ``BROADCAST_ROWS`` (beyond that, a batch is no longer small and
Spark joins by shuffle).

Merging is idempotent by key, so a batch that broke off is merged again; rewritten buckets are kept aside and noted before they replace the old ones, so that this too can be done again. One writer at a time; a ledger keeps one row for each attempt, counted by the writes
themselves (``Observation``), with the status success, failed (records, but none that could be normalised) or aborted (an error). A batch whose number has succeeded is not merged twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import is_blank
from ..storage import new_folder, stored
from .merge import first_rows

BUCKETS = 256
BROADCAST_ROWS = 1_000_000
INTENTS = "written string, done boolean"
LEDGER = "batch long, fetched long, normalized long, inserted long, backfilled long, status string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def begun(spark: SparkSession, path: str, schema: str | T.StructType) -> None:
    """An empty table at ``path``, unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


class EventStore:
    """The table at ``path`` (rows of ``schema``, known by ``key``) and its ledger."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "hash", columns: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path, key, columns, buckets
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        for name, kind in (("rows", self.schema), ("ledger", LEDGER), ("intents", INTENTS)):
            begun(spark, f"{path}/{name}", kind)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.table().drop("bucket")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def merged(self, batch: int) -> dict | None:
        """The ledger row of a batch that has succeeded."""
        done = self.ledger().where((F.col("batch") == batch) & (F.col("status") == "success")).limit(1).collect()
        return done[0].asDict() if done else None

    def present(self, batch: DataFrame) -> DataFrame:
        """(key, bucket, fillable columns) of the store's rows that the batch's keys meet."""
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
        rows = self.table().where(F.col("bucket").isin(touched)).select("bucket", self.key, *self.columns)
        return rows.join(self._small(batch.select(self.key)), self.key, "left_semi")

    def _small(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if self.few else rows

    def _filled(self, column: str) -> Column:
        """True where the batch has what the store's row lacks."""
        return is_blank(F.col(column).cast("string")) & ~is_blank(F.col(f"_{column}").cast("string"))

    def merge(self, arriving: DataFrame, normalise: Callable[[DataFrame], DataFrame] | None = None, batch: int = 0, order: tuple[str, ...] = ()) -> dict:
        """Merge a batch and return its ledger row. Rows without a key aren't kept; of arriving rows with one key the first by ``order`` counts."""
        if done := self.merged(batch):
            return done
        row = {"batch": batch, "fetched": 0, "normalized": 0, "inserted": 0, "backfilled": 0, "status": "aborted"}
        try:
            self._recover()
            fetched, normalized = Observation(), Observation()
            seen = arriving.observe(fetched, F.count(F.lit(1)).alias("n"))
            good = (normalise(seen) if normalise else seen).where(F.col(self.key).isNotNull()).observe(normalized, F.count(F.lit(1)).alias("n"))
            new = stored(first_rows(good.select(*(f.name for f in self.schema.fields[:-1])), self.key, order).withColumn("bucket", bucket_of(F.col(self.key), self.buckets)), "batch")
            row |= {"fetched": fetched.get["n"], "normalized": normalized.get["n"]}
            self.few = new.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            met = stored(self.present(new), "present")
            row["backfilled"] = self._backfill(new, met)
            row["inserted"] = self._insert(new, met)
            row["status"] = "failed" if row["fetched"] and not row["normalized"] else "success"
        finally:
            self.spark.createDataFrame([tuple(row.values())], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return row

    def _backfill(self, new: DataFrame, met: DataFrame) -> int:
        offers = new.select(F.col(self.key), *[F.col(c).alias(f"_{c}") for c in self.columns])
        changes = None
        for c in self.columns:
            changes = self._filled(c) if changes is None else changes | self._filled(c)
        if changes is None:
            return 0
        fills = stored(met.join(self._small(offers), self.key).where(changes).select("bucket", self.key, *[f"_{c}" for c in self.columns]), "fills")
        where = [r["bucket"] for r in fills.select("bucket").distinct().collect()]
        if not where:
            return 0
        counted = Observation()
        old = self.table().where(F.col("bucket").isin(where))
        joined = old.join(self._small(fills.drop("bucket")), self.key, "left")
        kept = [F.when(self._filled(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in self.columns else F.col(c) for c in old.columns]
        written = new_folder(self.spark, "buckets")
        joined.observe(counted, F.count(F.when(changes, 1)).alias("n")).select(*kept).write.parquet(written)
        self._intend(written, False)
        self._replace(written)
        return counted.get["n"]

    def _intend(self, written: str, done: bool) -> None:
        self.spark.createDataFrame([(written, done)], INTENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/intents")

    def _replace(self, written: str) -> None:
        """Put rewritten buckets, kept in ``written``, in the place of the old ones."""
        rows = self.spark.read.schema(self.schema).parquet(written)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        self._intend(written, True)

    def _recover(self) -> None:
        """Replacing buckets again is harmless, and needed if it broke off between taking the old ones away and putting the new ones there."""
        open_ones = self.spark.read.schema(INTENTS).parquet(f"{self.path}/intents").groupBy("written").agg(F.bool_or("done").alias("done")).where("NOT done")
        for r in open_ones.collect():  # one at most: the next merge begins here
            self._replace(r["written"])

    def _insert(self, new: DataFrame, met: DataFrame) -> int:
        counted = Observation()
        missing = new.join(self._small(met.select(self.key)), self.key, "left_anti").select(*new.columns)
        missing.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/rows")
        return counted.get["n"]
