"""Restartable landing of pages: a file stream merged into a keyed store, each micro-batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import EventStore


def pages(spark: SparkSession, folder: str, schema: str | T.StructType, files: int | None = None, glob: str = "*.json") -> DataFrame:
    """Records of JSON-lines pages as they land below ``folder``, with ``arrived``, the time of their micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.json(folder).withColumn("arrived", F.current_timestamp())


def without_repeats(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without records that came in the same words within ``delay``, by arrival, so that none is too late to be seen."""
    words = [c for c in stream.columns if c != "arrived"]
    marked = stream.withColumn("_same", F.sha2(F.to_json(F.struct(*words), {"ignoreNullFields": "false"}), 256))
    return marked.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["_same"]).drop("_same")


def land(stream: DataFrame, store: EventStore, checkpoint: str, normalise: Callable[[DataFrame], DataFrame] | None = None, order: tuple[str, ...] = (), delay: str = "1 day"):
    """Start landing all that is there; the query ends by itself and goes on from its checkpoint when started again.

    The number of a micro-batch is its number in the store's ledger: a batch that was merged before the
    stream could note it isn't merged again after a restart.
    """

    def merge(rows: DataFrame, number: int) -> None:
        if store.merged(number):
            rows.write.format("noop").mode("overwrite").save()  # the stream's own state still has to take the batch up
        else:
            store.merge(rows.drop("arrived"), normalise, number, order)

    return without_repeats(stream, delay).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
