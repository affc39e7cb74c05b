"""Lead scores (versions 1 and 2), their parts, rankings, deltas and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUPPRESSORS = ("operational_noise_terms", "sam_proxy_noise_expansion")


def tiered_sum(values: Column, top: int, rest_scale: float) -> Column:
    """The ``top`` greatest positive values in full and the rest scaled, rounded half to even."""
    ordered = F.sort_array(F.filter(values.cast("array<double>"), lambda v: v > 0), asc=False)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    rest = F.when(F.size(ordered) > top, total(F.slice(ordered, top + 1, F.greatest(F.size(ordered), F.lit(1))))).otherwise(0.0)
    return F.bround(total(F.slice(ordered, 1, top)) + rest * rest_scale).cast("int")


def pack_bucket(pack: Column) -> Column:
    return F.when(pack.isin(*SUPPRESSORS), "suppressor").when(pack.startswith("sam_proxy_"), "proxy").when(pack.startswith("sam_dod_"), "dod").when(pack == "sam_procurement_starter", "starter").otherwise("neutral")


def score_v1(weights: Column, keyword_count: Column, has_entity: Column) -> Column:
    """Sum of clause weights, else three a keyword; ten for a resolved entity."""
    base = F.aggregate(weights, F.lit(0), lambda a, w: a + w)
    return F.when(base != 0, base).otherwise(3 * keyword_count) + F.when(has_entity, 10).otherwise(0)


def score_v2(weights: Column, keyword_count: Column, has_entity: Column, pair_bonus: Column, top: int = 6, rest_scale: float = 0.5) -> Column:
    """The six greatest weights in full and half of the rest, truncated; then entity and pair bonus."""
    ordered = F.sort_array(weights, asc=False)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    base = (total(F.slice(ordered, 1, top)) + rest_scale * total(F.filter(ordered, lambda _, i: i >= top))).cast("int")
    return F.when(base != 0, base).otherwise(3 * keyword_count) + F.when(has_entity, 10).otherwise(0) + pair_bonus


def pair_bonus(pairs: DataFrame, min_signal: float = 0.15, min_events: int = 2) -> DataFrame:
    """(id, pair_count, strength, bonus) from (id, npmi, event_count) rows: min(12, round(6 * strength))."""
    strong = (F.col("npmi") >= min_signal) & (F.col("event_count") >= min_events)
    out = pairs.groupBy("id").agg(F.count("*").alias("pair_count"), F.bround(F.sum(F.when(strong, F.greatest(F.lit(0.0), F.col("npmi"))).otherwise(0.0)), 6).alias("strength"))
    return out.withColumn("bonus", F.least(F.lit(12), F.bround(6 * F.col("strength")).cast("int")))


def ranked(df: DataFrame, score: Column, min_score: int = 1, limit: int | None = None, scan: int | None = None) -> DataFrame:
    """Leads by score, time and id; ``scan`` limits by time before scoring, as the ranking defines it."""
    rows = df.orderBy(F.col("occurred_at").desc_nulls_last(), F.desc("id")).limit(scan) if scan else df
    rows = rows.withColumn("score", score).where(F.col("score") >= min_score)
    rows = rows.orderBy(F.desc("score"), F.col("occurred_at").desc_nulls_last(), F.desc("id"))
    return rows.limit(limit) if limit else rows


def snapshot(top: DataFrame, snapshot_id: str, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Freeze a ranking: ranks from 1.

    A bounded ranking is numbered by one task. With ``store``, which writes a table to shared storage and reads it
    back, a ranking of any length is: sorted rows are numbered inside their partitions, and only the
    partitions' sizes meet in one place.
    """
    order = [F.desc("score"), F.col("occurred_at").desc_nulls_last(), F.desc("id")]
    rows = top.withColumn("snapshot_id", F.lit(snapshot_id))
    if store is None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(*order)))
    rows = store(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("rank", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_part", "_at", "_before")


def delta(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Change of rank and score between two snapshots: new, removed, changed or same."""
    o = old.select(key, F.col("rank").alias("from_rank"), F.col("score").alias("from_score"))
    n = new.select(key, F.col("rank").alias("to_rank"), F.col("score").alias("to_score"))
    change = F.when(F.col("from_rank").isNull(), "new").when(F.col("to_rank").isNull(), "removed").when((F.col("from_rank") != F.col("to_rank")) | (F.col("from_score") != F.col("to_score")), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, change.alias("change_type"), "from_rank", "to_rank", (F.col("to_rank") - F.col("from_rank")).alias("rank_delta"), "from_score", "to_score", (F.col("to_score") - F.col("from_score")).alias("score_delta"))


def compare(base: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """State of each lead under two scoring versions; rank delta is base - target (up is positive)."""
    b = base.select(key, F.col("rank").alias("base_rank"), F.col("score").alias("base_score"))
    t = target.select(key, F.col("rank").alias("target_rank"), F.col("score").alias("target_score"))
    state = F.when(F.col("base_rank").isNull(), "entered").when(F.col("target_rank").isNull(), "dropped").otherwise("shared")
    return b.join(t, key, "full_outer").select(key, state.alias("state"), "base_rank", "target_rank", (F.col("base_rank") - F.col("target_rank")).alias("rank_delta"), "base_score", "target_score")


def score_spread(rows: DataFrame, top: int = 10) -> DataFrame:
    """Spread of the leading scores."""
    r = rows.where(F.col("rank") <= top)
    out = r.agg(F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.median("score").alias("median_score"), F.count_distinct("score").alias("unique_scores"))
    return out.withColumn("spread", F.col("max_score") - F.col("min_score"))


def pair_metrics(pairs: DataFrame, min_signal: float = 0.15, min_events: int = 2) -> DataFrame:
    """(id, pair_count, pair_count_total, pair_strength): strong pairs, all pairs, and the summed strength of the strong ones.

    ``pairs`` has (id, npmi, event_count). A pair without a signal (null) weighs 1 / sqrt(event_count).
    """
    strong = (F.col("npmi") >= min_signal) & (F.col("event_count") >= min_events)
    gain = F.when(F.col("npmi").isNull(), 1 / F.sqrt(F.greatest(F.col("event_count"), F.lit(1)))).when(strong, F.greatest(F.lit(0.0), F.col("npmi"))).otherwise(0.0)
    return pairs.groupBy("id").agg(F.count_if(strong | F.col("npmi").isNull()).alias("pair_count"), F.count("*").alias("pair_count_total"), F.bround(F.sum(gain), 6).alias("pair_strength"))


def noisy_v2(score: Column, bonus: Column, noise: Column) -> tuple[Column, Column]:
    """(score, bonus) of version 2 where an event is noise: a bonus of two at most, and eight points less."""
    less = F.when(noise, F.least(F.lit(2), bonus)).otherwise(bonus)
    return score - bonus + less - F.when(noise, 8).otherwise(0), less
