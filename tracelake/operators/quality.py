"""Quality gates: metric tables checked against policies, grouped, and turned into a run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "metric string, op string, bound double, category string, severity string, required boolean"
CHECKS = {">=": lambda v, b: v >= b, "<=": lambda v, b: v <= b, ">": lambda v, b: v > b, "<": lambda v, b: v < b, "==": lambda v, b: v == b}


def policy(spark: SparkSession, rows: list[tuple], overrides: dict[str, float] | None = None) -> DataFrame:
    """A policy table; ``overrides`` replaces bounds by metric."""
    known = {r[0] for r in rows}
    unknown = set(overrides or {}) - known
    if unknown:
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    return spark.createDataFrame([(m, op, float((overrides or {}).get(m, b)), *rest) for m, op, b, *rest in rows], POLICY)


def long_metrics(one_row: DataFrame) -> DataFrame:
    """(metric, value) from a row of numbers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def checked(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its metric's value and ``ok``; a metric that is missing or null fails."""
    v, b = F.col("value"), F.col("bound")
    ok: Column = F.lit(False)
    for op, test in CHECKS.items():
        ok = F.when(F.col("op") == op, test(v, b)).otherwise(ok)
    return rules.join(metrics, "metric", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def check_groups(checks: DataFrame) -> DataFrame:
    """Per category: checks, passed, failed, failed and required, and its status."""
    out = checks.groupBy("category").agg(F.count("*").alias("checks"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & F.col("required")).alias("failed_required"))
    return out.withColumn("status", F.when(F.col("failed_required") > 0, "failed").when(F.col("failed") > 0, "warning").otherwise("passed"))


def run_status(checks: DataFrame, most_reasons: int = 20) -> DataFrame:
    """One row: the workflow's status, its quality as far as the checks tell (see ``run_quality``), and the codes of what failed (policies are short tables)."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.concat_ws(":", "category", "metric"))))
    out = checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("ok") & F.col("required")).alias("hard"), F.count_if(~F.col("ok") & ~F.col("required")).alias("soft"), F.slice(failed, 1, most_reasons).alias("reasons"))
    status = F.when(F.col("hard") > 0, "failed").when(F.col("soft") > 0, "warning").otherwise("ok")
    return out.withColumn("workflow_status", status).withColumn("quality", F.when(status == "ok", "healthy").otherwise("degraded"))


#: Required checks without which a run has no say about its source (fixed values).
BLOCKING = ("doctor_db_ok", "workflow_execution")
MISSION = "mission_quality"


def run_quality(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """Status, quality and reason codes of every run.

    ``checks`` has (run, place, metric, category, required, ok), a policy's few rows for each run in the order ``place``; ``facts`` a row for each run: events_window,
    events_with_keywords, events_with_entity, snapshot_items, ingest_nonzero, rate_limit_retries, retry_attempts_total, comparison_reason_codes.
    Quality is healthy, rate_limited, degraded or sparse, the codes that ``health.status`` reads.
    """
    failed = lambda required: F.array_sort(F.collect_list(F.when(~F.col("ok") & (F.col("required") == required), F.struct("place", "metric", "category"))))
    per_run = checks.groupBy(F.col("run").alias("_run")).agg(failed(True).alias("_hard"), failed(False).alias("_soft"))
    none = F.array().cast(dict(per_run.dtypes)["_hard"])
    texts = F.array().cast("array<string>")
    rows = facts.join(per_run, facts["run"] == F.col("_run"), "left").withColumns({"_hard": F.coalesce("_hard", none), "_soft": F.coalesce("_soft", none), "comparison_reason_codes": F.coalesce("comparison_reason_codes", texts)})
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    hard, soft = F.size("_hard") > 0, (F.size("_soft") > 0) | (F.size("comparison_reason_codes") > 0)
    usable = (number("snapshot_items") > 0) | ((number("events_window") > 0) & ((number("events_with_keywords") > 0) | (number("events_with_entity") > 0)))
    blocked = F.exists("_hard", lambda c: c["metric"].isin(*BLOCKING))
    limited = number("rate_limit_retries") > 0
    quality = F.when(limited & usable & ~hard, "rate_limited").when(~usable, F.when(blocked, "degraded").otherwise("sparse")).when(hard | soft, "degraded").otherwise("healthy")
    categories = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: x["category"]), lambda x: x != ""))
    rows = rows.withColumns({"quality": quality, "workflow_status": F.when(hard, "failed").when(soft, "warning").otherwise("ok"), "has_usable_artifacts": usable, "required_failure_categories": categories("_hard"), "advisory_failure_categories": categories("_soft")})
    useful = usable & ~hard & (soft | F.col("quality").isin("degraded", "rate_limited"))
    code = lambda when, text: F.when(when, F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(texts)
    named = lambda prefix, c: F.transform(F.filter(c, lambda x: x["metric"] != ""), lambda x: F.concat(F.lit(prefix), x["metric"]))
    begun = F.concat(named("required_check_failed:", "_hard"), named("advisory_check_failed:", "_soft"), "comparison_reason_codes", code(F.col("quality") != "healthy", F.concat(F.lit("quality_"), "quality")))
    status = code((F.col("workflow_status") != "ok") & (F.size(begun) == 0), F.concat(F.lit("workflow_status:"), "workflow_status"))
    mission = F.when(F.array_contains("required_failure_categories", MISSION), F.array(F.lit("mission_quality_failed"))).when(F.array_contains("advisory_failure_categories", MISSION), F.array(F.lit("mission_quality_warning"))).otherwise(texts)
    empty = code(~F.coalesce("ingest_nonzero", F.lit(False)) & (number("events_window") == 0), "empty_window_or_no_fresh_ingest")
    retried = code(limited & (number("retry_attempts_total") > 0), "rate_limit_retries_observed")
    reasons = F.array_distinct(F.filter(F.transform(F.concat(begun, status, mission, empty, retried), lambda t: F.trim(t)), lambda t: t != ""))
    return rows.select("run", "workflow_status", "quality", "has_usable_artifacts", useful.alias("partially_useful"), reasons.alias("reason_codes"), "required_failure_categories", "advisory_failure_categories")


def evaluation_metrics(leads: DataFrame, tops: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Per head of the ranking: leads with relevance or pair backing, non-routine ones, and those that are context only."""
    backed = (F.col("proxy_relevance") > 0) | (F.col("pair_bonus_applied") > 0) | (F.col("candidate_links") > 0)
    rows = leads.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).where("rank <= top")
    return rows.groupBy("top").agg(F.count("*").alias("leads"), F.count_if(backed).alias("backed"), F.count_if(F.col("noise_penalty") == 0).alias("non_routine"), F.count_if(F.col("ranking_tier") == "context_only").alias("context_only"))


def mission_metrics(rows: DataFrame, fields: tuple[str, ...], top: int = 50) -> DataFrame:
    """One row over the head of a ranking: coverage of each field in percent, tiers, draftable and noisy shares."""
    head = rows.where(F.col("rank") <= top)
    pct = lambda c: F.bround(100 * F.count_if(c) / F.count("*"), 2)
    return head.agg(F.count("*").alias("leads"), *[pct(F.col(f).isNotNull()).alias(f"{f}_pct") for f in fields], F.count_distinct("ranking_tier").alias("tiers"), pct(F.col("draftability").isin("strong", "moderate")).alias("draftable_pct"), pct(F.col("noise_penalty") > 0).alias("noisy_pct"), pct(F.col("ranking_tier") == "context_only").alias("context_only_pct"))


def verdict(draftable_pct: Column, noisy_pct: Column, context_only_pct: Column) -> Column:
    """useful, mixed or weak, from shares in percent."""
    return F.when((draftable_pct >= 60) & (noisy_pct <= 30) & (context_only_pct <= 30), "useful").when((draftable_pct >= 30) & (noisy_pct <= 60), "mixed").otherwise("weak")


def comparison_checks(compared: DataFrame) -> DataFrame:
    """One row over two compared rankings: states, and whether a side is empty."""
    state = lambda s: F.count_if(F.col("state") == s)
    out = compared.agg(state("shared").alias("shared"), state("entered").alias("entered"), state("dropped").alias("dropped"), F.count("base_rank").alias("base_leads"), F.count("target_rank").alias("target_leads"))
    return out.withColumn("comparable", (F.col("base_leads") > 0) & (F.col("target_leads") > 0))


def window_differs(requested: tuple[str, str], first: Column, last: Column) -> Column:
    """Whether the data's own span leaves part of the requested one empty or goes beyond it."""
    start, end = (F.to_date(F.lit(x)) for x in requested)
    return F.coalesce((F.to_date(first) != start) | (F.to_date(last) != end), F.lit(True))


def evaluation_checks(metrics: DataFrame) -> DataFrame:
    """The four gates of an evaluation, from one row: ``complete``, ``top10``, ``top10_non_routine``, ``top10_backed``, ``top50``, ``family`` and ``family_share``.

    Most of the first ten leads must not be routine and five must be backed; a family may hold half of fifty leads,
    which is required only of the fallback family.
    """
    c = F.col
    enough = c("top50") >= 10
    gate = lambda name, ok, required, severity: F.struct(F.lit(name).alias("metric"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(required, F.lit(False)).alias("required"), severity.alias("severity"))
    fallback = enough & (c("family") == FALLBACK_FAMILY)
    gates = F.array(
        gate("evaluation_artifact_completeness", c("complete"), F.lit(True), F.lit("critical")),
        gate("evaluation_top10_non_routine_majority", c("top10_non_routine") >= F.ceil(c("top10") / 2), F.lit(False), F.lit("warning")),
        gate("evaluation_top10_proxy_or_pairbacked_threshold", c("top10_backed") >= F.least(F.lit(5), c("top10")), F.lit(False), F.lit("warning")),
        gate("evaluation_family_collapse_threshold", ~enough | (F.coalesce(c("family_share"), F.lit(0.0)) <= 0.5), fallback, F.when(fallback, "error").otherwise("warning")),
    )
    kept = [x for x in metrics.columns if x not in EVALUATED]
    return metrics.select(*kept, F.explode(gates).alias("g")).select(*kept, "g.*")


EVALUATED = ("complete", "top10", "top10_non_routine", "top10_backed", "top50", "family", "family_share")
#: The family that leads fall back to (a fixed value).
FALLBACK_FAMILY = "vendor_network_contract_lineage"
