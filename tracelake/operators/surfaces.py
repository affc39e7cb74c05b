"""What users ask of rankings: lead pages, snapshots, their events, contexts, and explanations of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import humanize, place_label

#: Components of a score in the order in which a change is explained (fixed values).
COMPONENTS = (
    ("proxy_relevance_score", "proxy"), ("corroboration_score", "corroboration"), ("family_relevance_bonus", "family"), ("clause_score", "clauses"),
    ("keyword_score", "keywords"), ("entity_bonus", "entity"), ("pair_bonus", "pair"), ("pair_bonus_suppressed", "pair_cap"),
    ("starter_context_score", "starter"), ("structural_context_score", "structural"), ("foia_matrix_bonus", "foia"), ("noise_penalty", "noise"),
)
#: Components that are stored as positive amounts but lower a score (fixed values).
LOWERING = ("noise_penalty", "pair_bonus_suppressed")
DOD_PREFIX = "sam_dod_"
SORTS = ("score", "rank", "occurred_at", "created_at", "id", "source", "lead_family", "event_count")
#: Columns of an event that a lead shows as its context (fixed values).
CONTEXT = (
    "category", "source", "source_url", "doc_id", "award_id", "generated_unique_award_id", "piid", "fain", "uri", "source_record_id", "recipient_name", "recipient_uei",
    "recipient_cage_code", "entity_id", "agency_code", "agency_name", "funding_agency_code", "funding_agency_name", "office_code", "office_name", "psc", "naics",
    "notice_type", "state", "country", "place_text", "solicitation_number", "notice_id", "document_id", "occurred_at", "created_at",
)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def dod_metrics(keywords: Column) -> tuple[Column, Column]:
    """(distinct packs, keywords) of the defence packs among ``pack:rule`` keywords."""
    packs = F.filter(F.transform(keywords, lambda k: F.substring_index(k, ":", 1)), lambda p: p.startswith(DOD_PREFIX))
    return F.size(F.array_distinct(packs)), F.size(packs)


def matrix_bonus(lanes: Column, pairs: Column, noise: Column) -> Column:
    """Up to two for defence packs and one for a pair, at most three; at most one beside noise; none without packs."""
    bonus = F.when(lanes > 0, F.least(F.lit(3), F.least(lanes, F.lit(2)) + F.when(pairs > 0, 1).otherwise(0))).otherwise(0)
    return F.when(noise, F.least(bonus, F.lit(1))).otherwise(bonus)


def potential_tier(lanes: Column, hits: Column, pairs: Column) -> Column:
    high = (lanes >= 3) & (hits >= 4) & (pairs >= 1)
    medium = ((lanes >= 2) & (hits >= 2)) | ((lanes >= 1) & (hits >= 2) & (pairs >= 1))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def pair_metadata(pairs: DataFrame) -> DataFrame:
    """Keyword pairs with their label and what one membership contributes: one over the root of the event count."""
    both = lambda f: F.concat(f(F.col("k1")), F.lit(" + "), f(F.col("k2")))
    contribution = F.when(F.col("c12") > 0, F.bround(1 / F.sqrt("c12"), 6)).otherwise(0.0)
    return pairs.withColumns({"pair_label_raw": both(lambda c: c), "pair_label": both(humanize), "event_count": F.col("c12"), "contribution": contribution})


def event_context(events: DataFrame, name: str = "context") -> DataFrame:
    """``events`` with a struct of what a lead shows of its event; columns that aren't there are null."""
    region = place_label(*(_optional(events, c).cast("string") for c in ("state", "country", "place_text")))
    return events.withColumn(name, F.struct(*[_optional(events, c).alias(c) for c in CONTEXT], region.alias("place_region")))


def with_correlation(leads: DataFrame, members: DataFrame, lane: str | None = None, min_events: int | None = None, min_signal: float | None = None) -> DataFrame:
    """Leads that some contributing correlation (id, lane, event_count, signal) backs; all if nothing is asked."""
    asked = F.lit(True)
    if lane is not None:
        asked &= F.lower("lane") == lane.strip().lower()
    if min_events is not None:
        asked &= F.col("event_count") >= min_events
    if min_signal is not None:
        asked &= F.coalesce("signal", F.lit(0.0)) >= min_signal
    if lane is min_events is min_signal is None:
        return leads
    return leads.join(members.where(asked).select("id"), "id", "left_semi")


def query_leads(leads: DataFrame, *, condition: Column | None = None, family: str | None = None, members: DataFrame | None = None, lane: str | None = None, min_events: int | None = None, min_signal: float | None = None, sort_by: str = "score", descending: bool = True, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """One page of ranked leads: filters, then order by one column with score, time and id as tiebreaks."""
    if sort_by not in SORTS:
        raise ValueError(f"leads can't be sorted by {sort_by}")
    rows = leads if condition is None else leads.where(condition)
    if family is not None:
        rows = rows.where((F.col("lead_family") == family) | F.array_contains("secondary_families", family) if "secondary_families" in rows.columns else F.col("lead_family") == family)
    if members is not None:
        rows = with_correlation(rows, members, lane, min_events, min_signal)
    c = F.lower("source") if sort_by == "source" else F.col(sort_by)
    ties = [F.desc("score"), F.col("occurred_at").desc_nulls_last(), F.desc("id")]
    rows = rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), *ties)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def family_groups(leads: DataFrame) -> DataFrame:
    """Per family over the whole filtered list: how many leads, the best score and rank."""
    return leads.groupBy(F.coalesce("lead_family", F.lit("unassigned")).alias("lead_family")).agg(F.count("*").alias("leads"), F.max("score").alias("best_score"), F.min("rank").alias("best_rank"))


def snapshot_list(snapshots: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """Snapshots, latest first, with their numbers of items (0 where there are none)."""
    n = items.groupBy("snapshot_id").agg(F.count("*").alias("items"))
    return snapshots.join(n, "snapshot_id", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("bigint"))).orderBy(F.desc("snapshot_id")).limit(limit)


def snapshot_events(items: DataFrame, events: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """Items of a snapshot with their events, by rank; an item whose event is gone stays."""
    rows = items if snapshot_id is None else items.where(F.col("snapshot_id") == snapshot_id)
    return rows.join(events, "id", "left").orderBy("snapshot_id", "rank")


def entity_list(entities: DataFrame, limit: int = 100) -> DataFrame:
    return entities.orderBy("entity_id").limit(limit)


def run_list(runs: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Runs of one kind or all, latest first."""
    rows = runs if kind is None else runs.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("run_id")).limit(limit)


def delta_explanation(base: Column, target: Column, fields: tuple[str, ...]) -> Column:
    """The first four changed components of two score structs (``fields`` are those they have), as one sentence."""
    parts = []
    for field, label in COMPONENTS:
        if field in fields:
            value = lambda s: F.coalesce(s[field].cast("int"), F.lit(0))  # noqa: B023, E731
            change = value(target) - value(base)
            change = -change if field in LOWERING else change
            parts.append(F.when(change != 0, F.concat(F.lit(f"{label} "), F.when(change > 0, "+").otherwise(""), change.cast("string"))))
    if "lead_family" in fields:
        old, new = base["lead_family"], target["lead_family"]
        parts.append(F.when(~old.eqNullSafe(new), F.concat(F.lit("lead_family "), F.coalesce(old, F.lit("n/a")), F.lit(" -> "), F.coalesce(new, F.lit("n/a")))))
    listed = F.slice(F.array_compact(F.array(*parts)), 1, 4)
    return F.when(F.size(listed) == 0, "No material score-component change.").otherwise(F.array_join(listed, "; "))


def version_overlap(base: DataFrame, target: DataFrame, top: int = 10) -> DataFrame:
    """One row: how many of the first ``top`` leads two versions share, promote and demote, and their row counts."""
    mark = lambda df, n: df.select("id", (F.col("rank") <= top).alias(n))
    both = mark(base, "b").join(mark(target, "t"), "id", "full_outer").select(F.col("b").isNotNull().alias("in_b"), F.col("t").isNotNull().alias("in_t"), F.coalesce("b", F.lit(False)).alias("b"), F.coalesce("t", F.lit(False)).alias("t"))
    return both.agg(F.count_if(F.expr("b and t")).alias("overlap"), F.count_if(F.expr("t and not b")).alias("promoted"), F.count_if(F.expr("b and not t")).alias("demoted"), F.count_if(F.expr("in_b")).alias("base_rows"), F.count_if(F.expr("in_t")).alias("target_rows"))


def version_table(base: DataFrame, target: DataFrame, top: int = 25) -> DataFrame:
    """The first ``top`` leads of either version by their better rank, with both ranks and scores."""
    side = lambda df, n: df.where(F.col("rank") <= top).select("id", F.col("rank").alias(f"rank_{n}"), F.col("score").alias(f"score_{n}"))
    rows = side(base, "base").join(side(target, "target"), "id", "full_outer").withColumn("rank_delta", F.col("rank_base") - F.col("rank_target"))
    return rows.orderBy(F.least("rank_base", "rank_target"), "id").limit(top)
