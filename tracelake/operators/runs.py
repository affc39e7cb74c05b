"""Whole runs composed of the operators: new events in, tagged, linked, correlated and ranked events out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import entities, lanes, linking, merge, scoring, surfaces, tagging

STAGES = ("ingest", "tag", "link", "correlate", "rank")


@dataclass
class Run:
    """Tables of a run; a skipped stage leaves None or passes its input on."""

    events: DataFrame
    ledger: DataFrame | None = None
    links: DataFrame | None = None
    correlations: DataFrame | None = None
    members: DataFrame | None = None
    snapshot: DataFrame | None = None
    skipped: list[str] = field(default_factory=list)


def source_run(existing: DataFrame, arriving: DataFrame, rules: list[dict] | DataFrame, known: DataFrame, *, key: str = "hash", fields: tuple[str, ...] = ("snippet",), lane_names: tuple[str, ...] = ("same_uei", "same_agency", "same_psc", "same_naics"), score: Column | None = None, snapshot_id: str = "run", limit: int = 200, skip: tuple[str, ...] = (), store: Callable[[DataFrame, str], DataFrame] = stored) -> Run:
    """Insert-if-absent, tagging, entity linking, lanes and a frozen ranking of the new events; any stage can be skipped.

    ``store`` writes a table to shared storage and reads it back, so that later stages share one computation
    of the new events, and linking one of each round.
    """
    if unknown := set(skip) - set(STAGES):
        raise ValueError(f"no such stages: {sorted(unknown)}")
    run = Run(arriving, skipped=[s for s in STAGES if s in skip])
    if "ingest" not in skip:
        run.ledger = merge.run_ledger(existing, arriving, arriving, key)
        run.events = merge.new_rows(existing, arriving, key)
    if "tag" not in skip:
        run.events = tagging.tag(run.events, rules, fields)
    run.events = store(run.events, "events")
    if "link" not in skip:
        run.links, _ = linking.linked(entities.identity(run.events), known, lambda df: store(df, "linking"))
        run.events = run.events.drop("entity_id").join(run.links.select("id", "entity_id"), "id", "left")
    if "correlate" not in skip:
        run.events = store(run.events, "events")
        run.correlations = store(lanes.same_field(run.events, lane_names), "clusters")
        run.members = store(lanes.links(run.events, run.correlations, lane_names), "links")
    if "rank" not in skip:
        has_entity = F.col("entity_id").isNotNull() if "entity_id" in run.events.columns else F.lit(False)
        if score is None:
            score = scoring.score_v1(F.transform("clauses", lambda c: c["weight"]), F.size("keywords"), has_entity)
        run.snapshot = scoring.snapshot(scoring.ranked(run.events, score, limit=limit), snapshot_id)
    return run


def gated_run(run: Run, metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """The gates of a run: each policy row against its metric, with ``ok`` (see ``review.thresholds``)."""
    from .review import thresholds

    if run.snapshot is None:
        raise ValueError("a run without a ranking can't be judged")
    return thresholds(metrics, policy)


def evaluation_run(run: Run, baseline_score: Column, limit: int = 200, top: int = 10) -> DataFrame:
    """A run's ranking against the same events under another score: overlap, promoted and demoted leads."""
    base = scoring.snapshot(scoring.ranked(run.events, baseline_score, limit=limit), "baseline")
    return surfaces.version_overlap(base, run.snapshot, top)
