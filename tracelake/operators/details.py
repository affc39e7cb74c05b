"""Detail fields of a lead with their defaults: lanes, matched rules, pair counts, leading signals and the parts of the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import lane_place

#: Whole-number details that are 0 where nothing is known (fixed values).
ZERO = ("pair_bonus_suppressed", "starter_only_pair_count", "cross_lane_bonus", "family_relevance_bonus", "starter_context_score", "nonstarter_context_score", "routine_noise_surcharge", "routine_noise_hit_count", "weak_proxy_investigability_delta", "weak_proxy_structural_delta")
#: The parts of a version 3 score, and the sign each has in the total (fixed values).
PARTS = {"proxy_relevance_score": 1, "investigability_score": 1, "corroboration_score": 1, "structural_context_score": 1, "noise_penalty": -1}
#: What the sub-score table lists beside the parts (fixed values).
COMPONENTS = ("pair_bonus_quality_cap", "pair_bonus_suppressed", "cross_lane_bonus", "family_relevance_bonus", "starter_context_score", "nonstarter_context_score", "routine_noise_surcharge", "weak_proxy_investigability_delta", "weak_proxy_structural_delta")
CLAUSES = "array<struct<pack:string,rule:string,field:string,match:string,type:string,weight:int>>"
HEAD = 5


def spoken(keyword: Column) -> Column:
    """pack:rule as people read it."""
    words = F.replace(keyword, F.lit("_"), F.lit(" "))
    left, right = F.trim(F.substring_index(words, ":", 1)), F.trim(F.substring(words, F.instr(words, ":") + 1, F.length(words)))
    return F.when(F.instr(words, ":") == 0, words).when((left != "") & (right != ""), F.concat(left, F.lit(": "), right)).otherwise(F.concat(left, right))


def matched_clauses(clauses: Column) -> Column:
    """Clauses with trimmed texts and a weight, the heaviest first, then by pack, rule, field and match."""
    text = lambda c, f: F.trim(F.coalesce(c[f], F.lit("")))
    plain = F.transform(F.coalesce(clauses, F.array().cast(CLAUSES)), lambda c: F.struct((-F.coalesce(c["weight"], F.lit(0))).alias("_order"), *[text(c, f).alias(f) for f in ("pack", "rule", "field", "match")], F.coalesce(c["weight"], F.lit(0)).alias("weight")))
    return F.transform(F.array_sort(plain), lambda c: c.dropFields("_order"))


def matched_rules(clauses: Column) -> Column:
    """pack:rule of ``matched_clauses``: by greatest weight, number of clauses, then name."""
    named = F.filter(clauses, lambda c: (c["pack"] != "") & (c["rule"] != ""))

    def stats(r: Column) -> Column:
        same = F.filter(named, lambda c: (c["pack"] == r["pack"]) & (c["rule"] == r["rule"]))
        most = F.array_max(F.transform(same, lambda c: c["weight"]))
        return F.struct((-F.greatest(most, F.lit(0))).alias("weight"), (-F.size(same)).alias("count"), r["pack"].alias("pack"), r["rule"].alias("rule"))

    rules = F.array_distinct(F.transform(named, lambda c: F.struct(c["pack"].alias("pack"), c["rule"].alias("rule"))))
    return F.transform(F.array_sort(F.transform(rules, stats)), lambda r: F.concat_ws(":", r["pack"], r["rule"]))


def enriched(leads: DataFrame, correlations: DataFrame) -> DataFrame:
    """``leads`` (id, clauses, and any of the detail columns) with every detail column filled.

    ``correlations`` has (id, lane, key, contribution): what a lead's lanes say, a few rows for each lead. A detail that is there stays; else it
    follows from the correlations, from an older column's value, or is 0.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in leads.columns else F.lit(None).cast(kind)
    item = F.struct(lane_place(F.col("lane")).alias("_place"), "lane", "key", F.coalesce("contribution", F.lit(0.0)).alias("contribution"))
    gathered = correlations.groupBy(F.col("id").alias("_id")).agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.count_if(F.col("lane") == "kw_pair").cast("int").alias("_pairs"),
        F.sum(F.when(F.col("lane") == "kw_pair", F.coalesce("contribution", F.lit(0.0)))).alias("_strength"),
    )
    out = leads.join(gathered, leads["id"] == F.col("_id"), "left").drop("_id")
    items = F.coalesce("_items", F.array().cast("array<struct<_place:int,lane:string,key:string,contribution:double>>"))
    plain = F.transform(items, lambda i: F.struct(i["lane"].alias("lane"), i["key"].alias("key"), i["contribution"].alias("contribution")))
    clauses = matched_clauses(F.col("clauses"))
    out = out.withColumns({"contributing_correlations": plain, "matched_clauses": clauses})
    lanes = F.array_distinct(F.transform(F.col("contributing_correlations"), lambda i: i["lane"]))
    bonus = F.coalesce(have("pair_bonus_applied", "int"), have("pair_bonus", "int"), F.lit(0))
    noise = F.coalesce(have("noise_penalty_applied", "int"), have("noise_penalty", "int"), F.lit(0))
    columns = {
        "contributing_lanes": lanes,
        "matched_rules": matched_rules(F.col("matched_clauses")),
        "pair_count": F.coalesce(have("pair_count", "int"), "_pairs", F.lit(0)),
        "pair_strength": F.bround(F.coalesce(have("pair_strength", "double"), "_strength", F.lit(0.0)), 4),
        "pair_bonus_applied": bonus,
        "pair_bonus_quality_cap": F.coalesce(have("pair_bonus_quality_cap", "int"), bonus),
        "noise_penalty_applied": noise,
        "weak_proxy_context_cap_applied": F.coalesce(have("weak_proxy_context_cap_applied", "boolean"), F.lit(False)),
        "weak_proxy_context_cap_reason": have("weak_proxy_context_cap_reason", "string"),
        "top_clauses": F.slice("matched_clauses", 1, HEAD),
        "corroboration_sources": F.slice("contributing_correlations", 1, HEAD),
    } | {c: F.coalesce(have(c, "int"), F.lit(0)) for c in ZERO}
    out = out.withColumns(columns)
    signals = F.transform(F.col("top_clauses"), lambda c: F.struct(spoken(F.concat_ws(":", c["pack"], c["rule"])).alias("label"), F.lit("proxy_relevance").alias("bucket"), F.lit("clause").alias("signal_type"), c["weight"].alias("contribution"), c["pack"].alias("pack"), c["rule"].alias("rule"), c["field"].alias("field"), c["match"].alias("match")))
    parts = {p: F.coalesce(have(p, "int"), F.lit(0)) for p in PARTS}
    total = F.coalesce(have("total_score", "int"), sum((sign * parts[p] for p, sign in PARTS.items()), F.lit(0)))
    math = F.struct(F.lit(" + ".join(p for p, s in PARTS.items() if s > 0) + " - noise_penalty").alias("formula"), *[v.alias(p) for p, v in parts.items()], total.alias("total_score"), F.struct(*COMPONENTS).alias("components"))
    version = F.col("scoring_version") == "v3" if "scoring_version" in leads.columns else F.lit(False)
    return out.withColumns({"top_positive_signals": signals, "subscore_math": F.when(version, math), "total_score": F.when(version, total).otherwise(have("total_score", "int"))}).drop("_items", "_pairs", "_strength")
