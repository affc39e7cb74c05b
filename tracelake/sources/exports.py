"""Exports: tables as CSV and JSON Lines directories, nested columns as JSON text in CSV.

Each writer gives its data to Spark's own sinks, one file per task; rows keep the order of a preceding ``orderBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, all else unchanged."""
    nested = lambda t: t.startswith(("array", "map", "struct"))
    return df.select(*[F.to_json(c).alias(c) if nested(t) else F.col(c) for c, t in df.dtypes])


def write_both(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``path``/csv with a header and ``path``/json with the nested values."""
    flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(f"{path}/csv")
    df.write.mode(mode).json(f"{path}/json")


def entities_bundle(events: DataFrame, entities: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The organisations, and which event belongs to which."""
    write_both(entities, f"{path}/entities", mode)
    write_both(event_entities(events, entities), f"{path}/event_entities", mode)


def event_entities(events: DataFrame, entities: DataFrame, raw: str | None = None) -> DataFrame:
    """(id, entity_id, name, uei): identifiers of the event, backfilled from its raw JSON ignoring the keys' case."""
    uei, name = F.col("recipient_uei"), F.col("recipient_name")
    rows = events
    if raw is not None:
        low = F.transform_keys(F.map_from_entries(F.array_distinct(F.map_entries(F.from_json(F.col(raw), "map<string,string>")))), lambda k, _: F.lower(k))
        rows = events.withColumn("_raw", low)
        uei = F.coalesce(uei, F.try_element_at("_raw", F.lit("recipient uei")), F.try_element_at("_raw", F.lit("recipient_uei")))
        name = F.coalesce(name, F.try_element_at("_raw", F.lit("recipient name")), F.try_element_at("_raw", F.lit("recipient_name")))
    rows = rows.select("id", "entity_id", uei.alias("uei"), name.alias("recipient"))
    known = entities.select("entity_id", F.col("name").alias("_name"))
    return rows.join(known, "entity_id", "left").select("id", "entity_id", F.coalesce("_name", "recipient").alias("name"), "uei")


def correlation_rows(found: DataFrame, links: DataFrame, events: DataFrame, columns: tuple[str, ...] = ("source", "recipient_name")) -> DataFrame:
    """Clusters with their members nested; lanes bound the members of a cluster (``max_events``)."""
    known = [c for c in columns if c in events.columns]
    members = links.join(events.select(F.col("id").alias("event_id"), *known), "event_id")
    nested = members.groupBy("correlation_key").agg(F.array_sort(F.collect_list(F.struct("event_id", *known))).alias("members"))
    return found.join(nested, "correlation_key", "left")


def pair_rows(pairs: DataFrame, links: DataFrame, min_events: int = 2, limit: int = 200) -> DataFrame:
    """The leading keyword pairs, their members joined by semicolons."""
    top = pairs.where(F.col("c12") >= min_events).orderBy(F.desc("npmi"), F.desc("c12"), "correlation_key").limit(limit)
    members = links.join(top.select("correlation_key"), "correlation_key", "left_semi").groupBy("correlation_key").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))
    return top.join(members, "correlation_key", "left").withColumn("members", F.array_join(F.transform("ids", lambda i: i.cast("string")), ";")).drop("ids")


def candidate_rows(found: DataFrame, notices: DataFrame, awards: DataFrame, columns: tuple[str, ...] = ("occurred_at", "recipient_name", "agency_name"), min_score: int = 45, incumbent_only: bool = False) -> DataFrame:
    """Candidate joins with both events side by side."""
    kept = found.where((F.col("score") >= min_score) & (F.col("likely_incumbent") if incumbent_only else F.lit(True)))
    side = lambda df, key, name: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in columns if c in df.columns])
    return kept.join(side(notices, "notice_id", "notice"), "notice_id").join(side(awards, "award_event_id", "award"), "award_event_id")


def delta_rows(delta: DataFrame, old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """What changed between two snapshots, with details of both sides as from_ and to_ columns."""
    side = lambda df, name: df.select("id", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return delta.where("change_type != 'same'").join(side(old, "from"), "id", "left").join(side(new, "to"), "id", "left")


#: Columns that a reviewer fills in (fixed values).
REVIEWER_COLUMNS = ("decision", "reason", "family_override", "notes", "reviewer")


def review_template(leads: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows for reviewers: what is known, and empty columns to fill in."""
    empty: list[Column] = [F.lit(None).cast("string").alias(c) for c in REVIEWER_COLUMNS]
    return leads.orderBy("rank").select("snapshot_id", "rank", "id", "score", *columns, *empty)


def search_documents(events: DataFrame, columns: tuple[str, ...], after: int | None = None) -> DataFrame:
    """Documents of a search index, keyed by hash; with ``after`` only events of greater id."""
    rows = events if after is None else events.where(F.col("id") > after)
    key = F.sha2(F.concat_ws("|", "source", F.col("id").cast("string")), 256)
    return rows.select(key.alias("hash"), "id", *columns)


def export_events(events: DataFrame, path: str, mode: str = "errorifexists", **query) -> None:
    """The filtered, sorted events of ``filters.query_events`` as CSV and JSON."""
    from ..operators.filters import query_events

    write_both(query_events(events, **query), path, mode)


def export_snapshot(leads: DataFrame, path: str, places: DataFrame | None = None, family: str | None = None, mode: str = "errorifexists") -> None:
    """A lead snapshot, all of it or one family's (primary or secondary), and a summary of one row."""
    from ..operators.evidence import review_rows, review_summary
    from ..operators.families import matches_family

    # the table of places is as long as the events, and small on disk only: it must not be sent whole to every task
    chosen = leads if family is None else leads.join(matches_family(places, family).hint("merge"), "id", "left_semi")
    rows = review_rows(chosen)
    write_both(rows.orderBy("rank"), f"{path}/leads", mode)
    review_summary(rows).write.mode(mode).json(f"{path}/summary")


def export_packages(packages: DataFrame, by: str, path: str, mode: str = "errorifexists") -> None:
    """Evidence packages as JSON Lines, one package a line, sorted by ``by`` over all files."""
    packages.orderBy(by).write.mode(mode).json(path)


def export_dossier_index(leads: DataFrame, dossiers: DataFrame, path: str, top: int = 10, mode: str = "errorifexists") -> None:
    """The index of the first ``top`` leads' dossiers: the lead, and how many support records it has by lane."""
    write_both(dossier_index(leads, dossiers, top), path, mode)


def dossier_index(leads: DataFrame, dossiers: DataFrame, top: int = 10) -> DataFrame:
    """(rank, id, score, records, lanes) of the first ``top`` leads in order."""
    per_lead = dossiers.groupBy(F.col("lead_id").alias("id")).agg(F.count("*").alias("records"), F.array_sort(F.collect_set("lane")).alias("lanes"))  # a lead has few lanes
    rows = leads.where(F.col("rank") <= top).join(per_lead, "id", "left")
    return rows.select("rank", "id", "score", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("lanes", F.array().cast("array<string>")).alias("lanes")).orderBy("rank")
