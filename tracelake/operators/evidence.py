"""Explanations of leads and evidence packages: what is linked to an event, and to a cluster, in whole.

Inputs are an event table, a cluster table (``correlation_key``, ``lane``, ``score``, ``event_count``) and the edge
table (``correlation_key``, ``event_id``). Samples are cut with a window before they are collected, so no list grows
with a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import is_blank
from .lanes import LANE_ORDER

#: Identifier columns of an event, from the most to the least telling (fixed values).
IDENTIFIERS = ("solicitation_number", "notice_id", "document_id", "award_id", "piid", "fain", "uri", "generated_unique_award_id", "source_record_id", "recipient_uei", "recipient_duns", "recipient_cage", "psc", "naics")
TRACEABLE = ("solicitation_number", "notice_id", "document_id", "award_id", "piid", "generated_unique_award_id", "source_record_id")


def lane_place(lane: Column) -> Column:
    """Position of a lane in the order of how telling it is; unknown lanes last."""
    at = F.array_position(F.array(*map(F.lit, LANE_ORDER)), lane)
    return F.when(at > 0, at).otherwise(len(LANE_ORDER) + 1)


def event_correlations(links: DataFrame, found: DataFrame, most: int | None = None) -> DataFrame:
    """(event_id, place, correlation_key, lane, score, event_count): an event's clusters, the most telling first."""
    order = Window.partitionBy("event_id").orderBy(lane_place(F.col("lane")), F.desc("score"), F.asc("event_count"), F.asc("correlation_key"))
    rows = links.join(found.select("correlation_key", "lane", "score", "event_count"), "correlation_key").withColumn("place", F.row_number().over(order))
    return rows if most is None else rows.where(F.col("place") <= most)


def as_links(links: DataFrame, found: DataFrame) -> DataFrame:
    """(id, links): what version 3 scoring reads. An event has few clusters (one per lane and keyword), so the list is small."""
    rows = links.join(found.select("correlation_key", "lane", "key"), "correlation_key")
    return rows.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("lane", "key"))).alias("links"))


def linked_records(leads: DataFrame, links: DataFrame) -> DataFrame:
    """(id, event_id, correlation_key): the other members of the clusters of each lead.

    Clusters have a bounded number of members (``max_events`` of the lanes), which bounds the rows per lead.
    """
    mine = leads.select("id").join(links.withColumnRenamed("event_id", "id"), "id")
    return mine.join(links, "correlation_key").where("event_id != id")


def linked_sources(leads: DataFrame, links: DataFrame, found: DataFrame, events: DataFrame, samples: int = 5, columns: tuple[str, ...] = ("award_id", "recipient_name", "agency_name")) -> DataFrame:
    """Per lead and source: distinct linked events, their lanes, and the first few values of ``columns``."""
    rows = linked_records(leads, links).join(found.select("correlation_key", "lane"), "correlation_key")
    per_event = rows.groupBy("id", "event_id").agg(F.collect_set("lane").alias("lanes"))  # at most one value per lane
    known = [c for c in columns if c in events.columns]
    told = per_event.join(events.select(F.col("id").alias("event_id"), "source", *known), "event_id")
    counts = told.groupBy("id", "source").agg(F.count("*").alias("linked_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lanes")))).alias("lanes"))
    # only the first few events of a lead and source are ranked: Spark cuts them before the shuffle
    k = F.row_number().over(Window.partitionBy("id", "source").orderBy("event_id"))
    firsts = told.select("id", "source", "event_id", *known).withColumn("_k", k).where(F.col("_k") <= samples)
    few = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(c).alias("v")))), lambda x: x["v"])
    firsts = firsts.groupBy("id", "source").agg(few("event_id").alias("sample_ids"), *[few(c).alias(f"sample_{c}") for c in known])
    return counts.join(firsts, ["id", "source"])


# ---- packages --------------------------------------------------------------------------------------


def identifiers(members: DataFrame, by: str, columns: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(by, kind, value, events): distinct identifiers of the events under ``by``, in long form."""
    known = [c for c in columns if c in members.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in known])
    rows = members.select(by, "event_id", F.explode(pairs).alias("p")).select(by, "event_id", "p.*").where(~is_blank(F.col("value")))
    return rows.groupBy(by, "kind", "value").agg(F.count_distinct("event_id").alias("events"))


def timeline(members: DataFrame, by: str, most: int = 20, time: str = "occurred_at") -> DataFrame:
    """(by, place, event_id, at): the first ``most`` dated events in order."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(time, "event_id"))
    return members.where(F.col(time).isNotNull()).withColumn("place", k).where(F.col("place") <= most).select(by, "place", "event_id", F.col(time).alias("at"))


def packages(members: DataFrame, by: str, top: int = 5) -> DataFrame:
    """One row per package: members, sources, amounts, time span, distinct identifiers and the leading agencies and recipients.

    ``members`` has ``by``, ``event_id`` and event columns; repeated members count once.
    """
    m = members.dropDuplicates([by, "event_id"])
    span = F.datediff(F.max("occurred_at"), F.min("occurred_at"))
    out = m.groupBy(by).agg(F.count("*").alias("members"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), span.alias("span_days"))
    ids = identifiers(m, by).groupBy(by).agg(F.count("*").alias("identifiers"), F.count_distinct("kind").alias("identifier_kinds"))
    out = out.join(ids, by, "left")
    for column, name in (("agency_name", "agencies"), ("recipient_name", "recipients")):
        if column in members.columns:
            out = out.join(_leading(m, by, column, name, top), by, "left")
    return out


def _leading(m: DataFrame, by: str, column: str, name: str, top: int) -> DataFrame:
    """(by, name): ``value (count)`` of the most frequent values, by count and then by value."""
    n = m.where(~is_blank(F.col(column))).groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.asc("v")))
    few = n.withColumn("k", k).where(F.col("k") <= top)
    return few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("v"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), "; ").alias(name))


def members_of(links: DataFrame, events: DataFrame) -> DataFrame:
    return links.join(events.withColumnRenamed("id", "event_id"), "event_id")


def correlation_packages(links: DataFrame, events: DataFrame, top: int = 5) -> DataFrame:
    return packages(members_of(links, events), "correlation_key", top)


def lead_packages(leads: DataFrame, links: DataFrame, events: DataFrame, max_rank: int | None = None, top: int = 5) -> DataFrame:
    """Packages of leads over the union of the members of all their clusters, the lead itself included."""
    chosen = leads if max_rank is None else leads.where(F.col("rank") <= max_rank)
    own = chosen.select(F.col("id").alias("lead_id"), F.col("id").alias("event_id"))
    linked = linked_records(chosen, links).select(F.col("id").alias("lead_id"), "event_id")
    rows = own.union(linked).distinct().join(events.withColumnRenamed("id", "event_id"), "event_id")
    return packages(rows, "lead_id", top)


def dossiers(leads: DataFrame, links: DataFrame, found: DataFrame, events: DataFrame, start: str, end: str, most: int = 8) -> DataFrame:
    """(lead_id, place, event_id, lane, occurred_at): support records of each lead inside a window, the most telling lane first."""
    rows = linked_records(leads, links).join(found.select("correlation_key", "lane"), "correlation_key")
    best = rows.groupBy(F.col("id").alias("lead_id"), "event_id").agg(F.min(F.struct(lane_place(F.col("lane")).alias("at"), "lane")).alias("b"))
    dated = events.where(F.col("occurred_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).select(F.col("id").alias("event_id"), "occurred_at")
    k = F.row_number().over(Window.partitionBy("lead_id").orderBy("b.at", F.desc("occurred_at"), "event_id"))
    out = best.join(dated, "event_id").withColumn("place", k).where(F.col("place") <= most)
    return out.select("lead_id", "place", "event_id", "b.lane", "occurred_at")


# ---- texts and review rows -------------------------------------------------------------------------


def why_summary(proxy: Column, corroboration: Column, noise: Column, tier: Column, lead_family: Column) -> Column:
    """One line that says why a lead stands where it does."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name} "), c.cast("string")))
    return F.concat_ws("; ", part("tier", tier), part("family", lead_family), part("relevance", proxy), part("corroboration", corroboration), F.when(noise > 0, part("noise", noise)))


def traceability_rationale(proxy: Column, corroboration: Column, structural: Column, backed: Column) -> Column:
    """Why a record request would be worthwhile, as a code."""
    return F.when((proxy > 0) & backed, "reinforced").when(proxy >= 6, "direct").when(proxy > 0, "some_relevance").when(backed & (corroboration > 0), "corroborated_only").when(structural > 0, "context_only").otherwise("thin")


def noise_rationale(routine_family: Column, routine_tags: Column, tier: Column, proxy: Column, structural: Column, noise: Column) -> Column:
    return F.when(routine_family, "routine_family").when(F.size(routine_tags) > 0, "routine_tags").when((tier == "context_only") | ((proxy <= 0) & (structural > 0)), "context_driven").when(noise > 0, "suppressed").otherwise("none")


COMPLETENESS = {
    "has_foia_handles": TRACEABLE,
    "has_agency_target": ("agency_code", "agency_name", "funding_agency_code", "funding_agency_name", "office_code", "office_name"),
    "has_vendor_context": ("recipient_uei", "recipient_name", "recipient_duns", "recipient_cage"),
    "has_classification_context": ("psc", "naics"),
    "has_place_context": ("state", "country", "zip", "place_text"),
}


def review_rows(leads: DataFrame) -> DataFrame:
    """Leads with five completeness flags and the list of categories that are missing."""
    flags = {}
    for name, columns in COMPLETENESS.items():
        known = [c for c in columns if c in leads.columns]
        flag = F.lit(False)
        for c in known:
            flag = flag | ~is_blank(F.col(c).cast("string"))
        flags[name] = flag
    out = leads.withColumns(flags)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(~F.col(n), n.removeprefix("has_")) for n in COMPLETENESS])))


def review_summary(rows: DataFrame) -> DataFrame:
    """Effective window and how many rows have each completeness flag."""
    return rows.agg(F.count("*").alias("leads"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.datediff(F.max("occurred_at"), F.min("occurred_at")).alias("span_days"), *[F.count_if(F.col(n)).alias(n) for n in COMPLETENESS])


def record_target(df: DataFrame) -> Column:
    """Which records to ask for next: solicitation, award, lineage, correspondence or none."""
    has = lambda *cs: F.coalesce(*[F.when(~is_blank(F.col(c).cast("string")), F.lit(True)) for c in cs if c in df.columns], F.lit(False))
    agency = has(*COMPLETENESS["has_agency_target"])
    return F.when(has("solicitation_number", "notice_id", "document_id"), "solicitation").when(has("award_id", "piid", "generated_unique_award_id"), "award").when(F.col("candidate_links") > 0 if "candidate_links" in df.columns else F.lit(False), "lineage").when(agency & has("source_url"), "correspondence").otherwise("none")


def draftability(target: Column, candidate: Column) -> Column:
    """How ready a request is: strong, moderate, weak or blocked (over ``review_rows``)."""
    handles, agency, vendor, kinds = (F.col(n) for n in ("has_foia_handles", "has_agency_target", "has_vendor_context", "has_classification_context"))
    known = target != "none"
    return F.when(handles & agency & known & (vendor | kinds | candidate), "strong").when(handles & known & (agency | vendor | kinds), "moderate").when(handles | agency, "weak").otherwise("blocked")


def noise_level(suppressors: Column, only_pairs: Column, starter_only: Column, handles: Column, agency: Column, weak_fit: Column) -> Column:
    """low without a reason for doubt; high with three, or with suppressors and no handles; else medium."""
    doubt = F.when(~handles, 1).when(~agency, 1).otherwise(0)
    reasons = sum((F.when(c, 1).otherwise(0) for c in (suppressors, only_pairs, starter_only, weak_fit)), doubt)
    return F.when(reasons == 0, "low").when((reasons >= 3) | (suppressors & ~handles), "high").otherwise("medium")
