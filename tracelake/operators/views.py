"""Views of clusters: their leading values and their whole picture in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import is_blank


def top_values(members: DataFrame, by: tuple[str, ...], column: str, top: int = 5) -> DataFrame:
    """(by, value, n, place): the most frequent values of a column per cluster, by count and then by value."""
    n = members.where(~is_blank(F.col(column).cast("string"))).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value")))
    return n.withColumn("place", place).where(F.col("place") <= top)


def cluster_view(found: DataFrame, links: DataFrame, events: DataFrame, columns: tuple[str, ...] = ("recipient_name", "agency_name", "psc", "naics"), top: int = 5, min_events: int = 2) -> DataFrame:
    """Clusters with the leading values of each column as an array of (value, n)."""
    out = found.where(F.col("event_count") >= min_events)
    members = links.join(events.select(F.col("id").alias("event_id"), *columns), "event_id")
    for c in columns:
        few = top_values(members, ("correlation_key",), c, top)
        listed = few.groupBy("correlation_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(f"top_{c}"))
        out = out.join(listed, "correlation_key", "left")
    return out
