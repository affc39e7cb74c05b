"""Health of an event store and gaps in it: lane counts, identity coverage, last runs, hints, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lanes import LANE_ORDER

#: Lanes whose correlations are counted: all but the cross-source join.
COUNTED = tuple(x for x in LANE_ORDER if x != "sam_usaspending_candidate_join")
IDENTITY = ("uei", "duns", "cage", "recipient_id")


def lane_counts(correlations: DataFrame, source: str | None = None, days: int = 30) -> DataFrame:
    """(lane, correlations) for every counted lane, 0 included: keys ``lane|source|days|...`` of the source or of all (*)."""
    parts = F.split("correlation_key", r"\|")
    ours = (F.element_at(parts, 3) == str(days)) & F.element_at(parts, 1).isin(*COUNTED)
    if source is not None:
        ours &= F.element_at(parts, 2).isin(source, "*")
    n = correlations.where(ours).groupBy(F.element_at(parts, 1).alias("lane")).agg(F.count("*").alias("n"))
    lanes = correlations.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, COUNTED))).alias("lane"))
    return lanes.join(n, "lane", "left").select("lane", F.coalesce("n", F.lit(0).cast("bigint")).alias("correlations"))


def identity_coverage(events: DataFrame) -> DataFrame:
    """One row over ``entities.identity`` columns and entity_id: events with an identifier or a name, and how many of these are linked."""
    signal, named, linked = F.coalesce(*IDENTITY).isNotNull(), F.col("name").isNotNull(), F.col("entity_id").isNotNull()
    out = events.agg(F.count("*").alias("events"), F.count_if(signal).alias("identity"), F.count_if(signal & linked).alias("identity_linked"), F.count_if(named).alias("named"), F.count_if(named & linked).alias("named_linked"))
    pct = lambda a, b: F.coalesce(F.bround(F.try_divide(100 * F.col(a), F.col(b)), 1), F.lit(0.0))
    return out.withColumns({"identity_pct": pct("identity_linked", "identity"), "named_pct": pct("named_linked", "named")})


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of every kind."""
    others = [c for c in runs.columns if c not in ("kind", "run_id")]
    return runs.groupBy("kind").agg(F.max("run_id").alias("run_id"), *[F.max_by(c, "run_id").alias(c) for c in others])


def hints(metrics: DataFrame) -> DataFrame:
    """A row of store metrics with ``hints``: codes of what to do next.

    Metrics: events_total, events_window, with_keywords, with_entity, kw_pairs, over_cap (events with more
    keywords than pairs are made for), scanned, identity, identity_linked, snapshots.
    """
    c = F.col
    pct = lambda a, b: F.coalesce(F.try_divide(100.0 * c(a), c(b)), F.lit(0.0))
    rules: list[tuple[Column, str]] = [
        (c("events_total") == 0, "no_events"),
        ((c("events_total") > 0) & (c("events_window") == 0), "no_events_in_window"),
        ((c("events_window") > 0) & (c("with_keywords") == 0), "no_keywords"),
        ((c("kw_pairs") == 0) & (c("with_keywords") == 0), "pairs_need_keywords"),
        ((c("kw_pairs") == 0) & (c("with_keywords") > 0), "no_pairs"),
        ((c("kw_pairs") == 0) & (c("with_keywords") > 0) & (pct("over_cap", "scanned") >= 20), "too_many_keywords"),
        ((c("events_window") > 0) & (c("with_entity") == 0), "no_entities"),
        ((c("events_window") > 0) & (c("with_entity") > 0) & (pct("with_entity", "events_window") < 25), "few_entities"),
        ((c("identity") > 0) & (pct("identity_linked", "identity") < 50), "few_identities_linked"),
        (c("snapshots") == 0, "no_snapshots"),
    ]
    return metrics.withColumn("hints", F.array_compact(F.array(*[F.when(ok, F.lit(code)) for ok, code in rules])))


def gap_flags(events: DataFrame, covered: DataFrame, context: tuple[str, ...], least: int = 3) -> DataFrame:
    """(id, untagged, no_entity, no_lead, low_context) of every event; ``covered`` has the ids of the latest snapshot."""
    filled = sum((F.col(x).isNotNull().cast("int") for x in context), F.lit(0))
    flags = events.select("id", (F.coalesce(F.size("keywords"), F.lit(0)) <= 0).alias("untagged"), F.col("entity_id").isNull().alias("no_entity"), (filled < least).alias("low_context"))
    return flags.join(covered.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left").withColumn("no_lead", F.col("_c").isNull()).drop("_c")


def gap_report(flags: DataFrame, samples: int = 20) -> DataFrame:
    """(gap, events, pct, sample): how many events have each gap, and the least ids of those."""
    gaps = ("untagged", "no_entity", "no_lead", "low_context")
    total = flags.agg(F.count("*").alias("total"), *[F.count_if(F.col(g)).alias(g) for g in gaps])
    rows = total.select("total", F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), F.col(g).alias("events")) for g in gaps])).alias("x")).select("total", "x.*")
    firsts = None
    for g in gaps:  # a bounded top per gap, not a collected list of all
        part = flags.where(F.col(g)).orderBy("id").limit(samples).agg(F.sort_array(F.collect_list("id")).alias("sample")).withColumn("gap", F.lit(g))
        firsts = part if firsts is None else firsts.union(part.select("sample", "gap"))
    pct = F.coalesce(F.bround(F.try_divide(100 * F.col("events"), F.col("total")), 1), F.lit(0.0))
    return rows.join(F.broadcast(firsts), "gap", "left").select("gap", "events", pct.alias("pct"), F.coalesce("sample", F.array().cast("array<bigint>")).alias("sample"))


def status(metrics: DataFrame) -> DataFrame:
    """A row of run metrics with its ``status``: broken, degraded, rate_limited_degraded, sparse_valid, partially_useful or healthy.

    Metrics: store_ok, bundle_status, workflow_status, quality, partially_useful, pipeline_failed, advisory_failed,
    retries, events_window, keyword_pct, entity_pct.
    """
    c = F.col
    known = c("workflow_status").isin("ok", "warning")
    limited = c("quality").isin("rate_limited", "rate_limited_degraded") | (c("retries") > 0)
    sparse = c("quality").isin("sparse", "sparse_valid") | (c("events_window") == 0)
    no = lambda x: F.coalesce(x, F.lit(False))
    ladder = (
        F.when(~no(c("store_ok")), "broken")
        .when(no(c("bundle_status") != "ok"), "broken")
        .when(no(c("workflow_status") == "failed"), F.when(c("pipeline_failed"), "broken").otherwise("degraded"))
        .when(no(known & limited), "rate_limited_degraded")
        .when(no(known & sparse), "sparse_valid")
        .when(no(known & c("partially_useful")), "partially_useful")
        .when(no(known & c("quality").isin("partially_useful", "degraded")), c("quality"))
        .when(no(c("workflow_status") == "warning"), "degraded")
        .when(no((c("workflow_status") == "ok") & (c("quality") == "healthy")), "healthy")
        .when(no((c("workflow_status") == "ok") & c("advisory_failed")), "degraded")
        .when(c("retries") > 0, "rate_limited_degraded")
        .when(c("events_window") == 0, "sparse_valid")
        .when((c("keyword_pct") < 40) | (c("entity_pct") < 40), "partially_useful")
        .otherwise("healthy")
    )
    return metrics.withColumn("status", ladder)
