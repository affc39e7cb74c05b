"""Evaluation of rankings against reviewer labels, and data-health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, coverage and acceptance rate (keep of keep and reject), over groups or all."""
    keep, reject = F.count_if(F.col("decision") == "keep"), F.count_if(F.col("decision") == "reject")
    out = rows.groupBy(*by).agg(F.count("*").alias("items"), keep.alias("keep"), reject.alias("reject"), F.count_if(F.col("decision").isNotNull()).alias("reviewed"))
    return out.withColumn("coverage_pct", F.bround(100 * F.col("reviewed") / F.col("items"), 2)).withColumn("acceptance_rate", F.bround(F.try_divide(F.col("keep"), F.col("keep") + F.col("reject")), 4))


def precision_at(rows: DataFrame, ks: tuple[int, ...] = (5, 10, 25, 50)) -> DataFrame:
    """Precision of the first k of every snapshot, pooled; undecided items don't count."""
    place = F.row_number().over(Window.partitionBy("snapshot").orderBy("rank", "doc_id"))
    placed = rows.withColumn("place", place).where(F.col("place") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("place <= k")
    out = placed.groupBy("k").agg(F.count_if(F.col("decision") == "keep").alias("keep"), F.count_if(F.col("decision").isin("keep", "reject")).alias("decisive"))
    return out.withColumn("precision", F.bround(F.try_divide("keep", "decisive"), 4))


def grouped_metrics(rows: DataFrame) -> DataFrame:
    """Label summaries by family, by snapshot and over all, in one pass of grouping sets."""
    keep, reject = F.count_if(F.col("decision") == "keep"), F.count_if(F.col("decision") == "reject")
    by = rows.groupingSets([["family"], ["snapshot"], []], "family", "snapshot").agg(F.grouping_id().alias("level"), F.count("*").alias("items"), keep.alias("keep"), reject.alias("reject"))
    return by.withColumn("acceptance_rate", F.bround(F.try_divide(F.col("keep"), F.col("keep") + F.col("reject")), 4))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values with their share of the total in percent."""
    n = rows.groupBy(column).agg(F.count("*").alias("items"))
    total = n.agg(F.sum("items").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "items", F.bround(100 * F.col("items") / F.col("total"), 2).alias("share_pct"))


def health(events: DataFrame) -> DataFrame:
    """Totals and coverages of an event table, per source."""
    pct = lambda c: F.bround(100 * F.count_if(c) / F.count("*"), 2)
    return events.groupBy("source").agg(
        F.count("*").alias("events"),
        F.count_distinct("entity_id").alias("entities"),
        pct(F.col("entity_id").isNotNull()).alias("entity_pct"),
        pct(F.size("keywords") > 0).alias("keyword_pct"),
        pct(F.col("recipient_uei").isNotNull()).alias("identity_pct"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )


def top_keywords(events: DataFrame, top: int = 10) -> DataFrame:
    words = events.select("id", F.explode("keywords").alias("keyword"))
    return words.groupBy("keyword").agg(F.count_distinct("id").alias("events")).orderBy(F.desc("events"), F.asc("keyword")).limit(top)


def context_depth(events: DataFrame, fields: tuple[str, ...], research: int = 3) -> DataFrame:
    """Average number of filled context fields, share of events with enough, per source."""
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return events.withColumn("n", n).groupBy("source").agg(F.bround(F.avg("n"), 2).alias("avg_fields"), F.bround(100 * F.count_if(F.col("n") >= research) / F.count("*"), 2).alias("research_pct"))


def thresholds(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """Each policy row (metric, operator, bound, category, required) against its metric's value."""
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == ">=", v >= b).when(F.col("op") == "<=", v <= b).when(F.col("op") == ">", v > b).when(F.col("op") == "<", v < b).when(F.col("op") == "==", v == b)
    return F.broadcast(policy).join(metrics, "metric", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def outside_window(events: DataFrame, start: str, end: str) -> DataFrame:
    """How many events leak out of a requested window."""
    at = F.col("occurred_at")
    inside = at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return events.groupBy("source").agg(F.count("*").alias("events"), F.count_if(~inside).alias("outside"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
