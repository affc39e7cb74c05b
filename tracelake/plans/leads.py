"""Registered queries on leads: version 3 scores, families, evidence packages, exports and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, details, evidence, families, filters, lanes, merge, quality, relevance, scoring, views
from ..sources import exports
from ..sources import views as v
from ..storage import stored
from .queries import _LEADS_SQL, CANDIDATE_SQL, _base, _boosted, _lead_rank, awards_sql, candidate_sides, register

# ---- version 3 scores ------------------------------------------------------------------------------

HINTS = (relevance.Hint("low_priority", 4, patterns=(r"\blow\b",)), relevance.Hint("urgent", 0, patterns=(r"\burgent\b",)))
PACK_FAMILIES = {"sam_proxy_seg": ("alpha",), "sam_dod_prio": ("alpha", "beta")}
LINK_LANES = ("same_contract_id", "same_uei", "same_agency", "same_psc")


def _clause(pack: str, rule, weight: int):
    return F.struct(F.lit(pack).alias("pack"), rule.alias("rule"), F.lit(weight).alias("weight"))


def scored_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award events with version 3 scores: packs from segment, priority, status and nation; links from four lanes."""
    events = v.award_events(spark, sf_dir)
    found = lanes.same_field(events, LINK_LANES, max_events=None)
    linked = evidence.as_links(lanes.links(events, found, LINK_LANES), found)
    seg, prio = F.concat(F.lit("sam_proxy_seg:"), F.lower("naics")), F.concat(F.lit("sam_dod_prio:"), F.lower("psc"))
    status = F.concat(F.lit("sam_procurement_starter:"), F.split_part(F.element_at("keywords", 3), F.lit(":"), F.lit(2)))
    rows = events.join(linked, "id", "left").select(
        "id", "amount", "occurred_at", "agency_name", "recipient_uei", "recipient_name", "award_id", "naics", "psc", "notice_type", "source", "state", "country", "links",
        F.array(seg, prio, status, F.element_at("keywords", 4)).alias("keywords"),
        F.array_compact(F.array(F.when(F.col("amount") >= 200000, _clause("sam_proxy_seg", F.lower("naics"), 2)), F.when(F.col("psc") == "5-LOW", _clause("sam_dod_prio", F.lower("psc"), -1)), F.when(F.col("amount") < 50000, _clause("operational_noise_terms", F.lit("admin_facility_ops_noise"), -2)))).alias("clauses"),
        F.when(F.col("amount") >= 100000, F.array(F.struct(seg.alias("k1"), prio.alias("k2")))).alias("pairs"),
        F.lit(5).alias("pair_bonus"),
    )
    has = {n: F.lit(True) for n in ("id", "agency", "time", "entity", "vendor", "codes", "place", "type")}
    return relevance.score_v3(rows, relevance.Context(has), F.col("notice_type"), F.col("country") != "ASIA", HINTS, PACK_FAMILIES)


V3_SQL = f"""{v.AWARDS_SQL},
x AS (SELECT *, amount >= 200000 AS big, psc = '5-LOW' AS low, amount < 50000 AS small, amount >= 100000 AS paired, country <> 'ASIA' AS meta,
             CASE WHEN count(*) OVER (PARTITION BY piid) >= 2 THEN 2 ELSE 0 END AS lanes,
             CAST(count(*) OVER (PARTITION BY agency_name) >= 2 AS INT) + CAST(count(*) OVER (PARTITION BY psc) >= 2 AS INT) AS lower_lanes FROM awards),
y AS (SELECT *, CASE WHEN big THEN 6 ELSE 2 END + CASE WHEN low THEN 0 ELSE 2 END AS proxy,
             CASE WHEN low THEN 0 ELSE 1 END + CAST(paired AS INT) + CASE WHEN NOT low AND lanes > 0 THEN 1 ELSE 0 END AS fam FROM x),
z AS (SELECT *, least(13, CASE WHEN lanes > 0 THEN 5 ELSE 0 END + fam + CASE WHEN paired THEN 5 ELSE 0 END + greatest(0, least(2, lanes + CAST(paired AS INT) - 1))) AS corr,
             least(5, 2 + CASE WHEN meta THEN 3 ELSE 0 END + lower_lanes) AS structure FROM y),
u AS (SELECT *, CASE WHEN proxy < 8 AND corr < 5 THEN least(CASE WHEN meta THEN 5 ELSE 4 END, 5) ELSE 5 END AS trace,
             CASE WHEN proxy < 8 AND corr < 5 THEN least(3, structure) ELSE structure END AS struct, proxy < 8 AND corr < 4 AS loose FROM z),
v3 AS (SELECT *, 4 * (CAST(low AS INT) + CAST(small AS INT)) + CASE WHEN loose AND (low OR small) THEN 4 ELSE 0 END + CASE WHEN small THEN 3 ELSE 0 END + CASE WHEN loose AND low THEN 4 ELSE 0 END AS noise,
             CASE WHEN proxy >= 8 AND paired THEN 'highest' WHEN proxy >= 6 OR paired OR corr >= 4 THEN 'review' ELSE 'candidate' END AS tier FROM u)"""


@register("scr6_score_v3", f"WITH {V3_SQL}\nSELECT id, CAST(proxy + trace + corr + struct - least(20, noise) AS BIGINT) AS score, CAST(proxy AS BIGINT) AS relevance, CAST(corr AS BIGINT) AS corroboration, CAST(trace AS BIGINT) AS investigability, CAST(struct AS BIGINT) AS structural, CAST(least(20, noise) AS BIGINT) AS noise, tier FROM v3")
def scr6(spark, sf_dir):
    names = {"score": "score", "proxy_relevance": "relevance", "corroboration": "corroboration", "investigability": "investigability", "structural": "structural", "noise_penalty": "noise"}
    return scored_awards(spark, sf_dir).select("id", *[F.col(c).cast("bigint").alias(n) for c, n in names.items()], F.col("ranking_tier").alias("tier"))


@register("scr7_hints", awards_sql("SELECT tag, count(*) AS events FROM (SELECT CASE WHEN psc = '5-LOW' THEN 'low_priority' WHEN psc = '1-URGENT' THEN 'urgent' END AS tag FROM awards) t WHERE tag IS NOT NULL GROUP BY tag"))
def scr7(spark, sf_dir):
    events = v.award_events(spark, sf_dir).withColumn("clauses", F.array().cast("array<struct<pack:string,rule:string,weight:int>>"))
    return relevance.signals(events).select(F.explode(relevance.hint_tags(F.col("notice_type"), HINTS)).alias("tag")).groupBy("tag").agg(F.count("*").alias("events"))


@register("scr12_pair_quality", awards_sql("SELECT CAST(cap AS INT) AS cap, count(*) AS pairs FROM (SELECT 1 AS cap, id FROM awards UNION ALL SELECT 1, id FROM awards UNION ALL SELECT 1, id FROM awards UNION ALL SELECT 1, id FROM awards UNION ALL SELECT 1, id FROM awards UNION ALL SELECT 1, id FROM awards) p GROUP BY cap"))
def scr12(spark, sf_dir):
    """The pairs of an event's four keywords, all of them context here."""
    k = F.col("keywords")
    pairs = F.array(*[F.struct(k[i].alias("k1"), k[j].alias("k2")) for i in range(4) for j in range(i + 1, 4)])
    rows = relevance.pair_caps(v.award_events(spark, sf_dir).select("id", pairs.alias("pairs")))
    return rows.select(F.explode("_caps").alias("c")).groupBy("c.cap").agg(F.count("*").alias("pairs"))


@register("qua6_evaluation", f"WITH {V3_SQL},\nr AS (SELECT *, row_number() OVER (ORDER BY proxy + trace + corr + struct - least(20, noise) DESC, occurred_at DESC NULLS LAST, id DESC) AS rank FROM v3 WHERE proxy + trace + corr + struct - least(20, noise) >= 1)\nSELECT top, count(*) AS leads, count(CASE WHEN proxy > 0 OR paired THEN 1 END) AS backed, count(CASE WHEN noise = 0 THEN 1 END) AS non_routine, CAST(0 AS BIGINT) AS context_only FROM r JOIN (VALUES (10), (50)) t(top) ON rank <= top GROUP BY top")
def qua6(spark, sf_dir):
    top = scoring.ranked(scored_awards(spark, sf_dir), F.col("score"), limit=50)
    return quality.evaluation_metrics(scoring.snapshot(top, "v3"))


@register("scr14_tiers", f"WITH {V3_SQL}\nSELECT tier, count(*) AS events, CAST(min(proxy) AS BIGINT) AS least_relevance, CAST(max(corr) AS BIGINT) AS most_corroboration FROM v3 GROUP BY tier")
def scr14(spark, sf_dir):
    return scored_awards(spark, sf_dir).groupBy(F.col("ranking_tier").alias("tier")).agg(F.count("*").alias("events"), F.min("proxy_relevance").cast("bigint").alias("least_relevance"), F.max("corroboration").cast("bigint").alias("most_corroboration"))


# ---- families --------------------------------------------------------------------------------------

#: The taxonomy of these queries (fixed values): families, and what evidence weighs in them.
FAMILY_ROWS = [("builders", "Builders", "specialized", 4, 2, 0), ("general", "General", "fallback", 1, 1, 1), ("urgent", "Urgent work", "specialized", 3, 2, 0)]
WEIGHT_ROWS = [
    ("builders", "rule", "seg:building", 3, False),
    ("builders", "pack", "seg", 1, False),
    ("builders", "lane", "same_contract_id", 2, True),
    ("builders", "hint", "urgent", 2, False),
    ("general", "pack", "seg", 1, False),
    ("general", "pack", "prio", 1, False),
    ("general", "lane", "same_contract_id", 1, False),
    ("general", "source", "awards", 1, False),
    ("general", "candidate", "naics", 2, True),
    ("urgent", "rule", "prio:1-urgent", 3, False),
    ("urgent", "candidate", "naics", 1, False),
]


def family_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stored(v.award_events(spark, sf_dir), "events")
    found = stored(lanes.same_field(events, ("same_contract_id",)), "clusters")
    hits = events.select("id", F.explode(F.array(F.struct(F.lit("seg").alias("pack"), F.lower("naics").alias("rule"), F.when(F.col("amount") >= 200000, 4).otherwise(1).alias("weight")), F.struct(F.lit("prio").alias("pack"), F.lower("psc").alias("rule"), F.lit(1).alias("weight")))).alias("h")).select("id", "h.*", F.lit(0).alias("origin"))
    said = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    own = events.select("id", F.explode(F.array_compact(F.array(said("source", F.col("source")), F.when(F.col("psc") == "1-URGENT", said("hint", F.lit("urgent"))), F.when(F.col("amount") < 100000, said("candidate", F.lit("naics")))))).alias("e")).select("id", "e.*", F.lit("join").alias("item"))
    linked = lanes.links(events, found, ("same_contract_id",)).select(F.col("event_id").alias("id"), F.lit("lane").alias("kind"), F.lit("same_contract_id").alias("key"), F.col("correlation_key").alias("item"))
    taxonomy = spark.createDataFrame(FAMILY_ROWS, families.FAMILIES), spark.createDataFrame(WEIGHT_ROWS, families.WEIGHTS)
    evidence_rows = stored(own.union(linked), "evidence")
    return stored(families.assigned(families.family_scores(stored(families.ontology_index(hits), "index"), evidence_rows, *taxonomy)), "families")


_TRIPLES = ", ".join(f"('{f}', '{kind}', '{key}', {w}, {str(s).upper()})" for f, kind, key, w, s in WEIGHT_ROWS)
_FAMILIES = ", ".join(f"('{f}', '{scope}', {a}, {b}, {c})" for f, _, scope, a, b, c in FAMILY_ROWS)
FAMILY_SQL = f"""{v.AWARDS_SQL},
w(family, kind, key, weight, specific) AS (VALUES {_TRIPLES}),
f(family, scope, min_total, min_ontology, min_corroboration) AS (VALUES {_FAMILIES}),
h AS (SELECT id, 'seg' AS pack, 'seg:' || lower(naics) AS rule, CASE WHEN amount >= 200000 THEN 2 ELSE 0 END AS extra FROM awards UNION ALL SELECT id, 'prio', 'prio:' || lower(psc), 0 FROM awards),
o AS (SELECT h.id, f.family, sum(coalesce(r.weight, p.weight) + extra) AS ontology, count(*) AS rules FROM h CROSS JOIN f LEFT JOIN w r ON r.family = f.family AND r.kind = 'rule' AND r.key = h.rule LEFT JOIN w p ON p.family = f.family AND p.kind = 'pack' AND p.key = h.pack WHERE coalesce(r.weight, p.weight) > 0 GROUP BY h.id, f.family),
e AS (SELECT id, 'source' AS kind, 'awards' AS key FROM awards UNION ALL SELECT id, 'hint', 'urgent' FROM awards WHERE psc = '1-URGENT' UNION ALL SELECT id, 'candidate', 'naics' FROM awards WHERE amount < 100000
      UNION ALL SELECT id, 'lane', 'same_contract_id' FROM awards WHERE piid IN (SELECT piid FROM awards GROUP BY piid HAVING count(*) BETWEEN 2 AND 200)),
c AS (SELECT e.id, w.family, sum(CASE WHEN e.kind = 'hint' THEN weight ELSE 0 END) AS hint, sum(CASE WHEN e.kind <> 'hint' THEN weight ELSE 0 END) AS corroboration, sum(CASE WHEN specific THEN weight ELSE 0 END) AS specific FROM e JOIN w ON w.kind = e.kind AND w.key = e.key GROUP BY e.id, w.family),
s AS (SELECT o.id, o.family, f.scope, ontology, rules, coalesce(hint, 0) AS hint, coalesce(corroboration, 0) AS corroboration, coalesce(specific, 0) AS specific, ontology + coalesce(hint, 0) + coalesce(corroboration, 0) AS total
      FROM o JOIN f ON f.family = o.family LEFT JOIN c ON c.id = o.id AND c.family = o.family WHERE ontology >= min_ontology AND coalesce(corroboration, 0) >= min_corroboration AND ontology + coalesce(hint, 0) + coalesce(corroboration, 0) >= min_total),
t AS (SELECT *, total + least(ontology, 3) + least(rules, 2) + least(specific, 3) - CASE WHEN scope = 'fallback' THEN least(corroboration - specific, 3) ELSE 0 END AS selection FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY selection DESC, total DESC, ontology DESC, specific DESC, hint DESC, corroboration DESC, family) AS place FROM t),
k AS (SELECT q.*, CASE WHEN place = 1 THEN 'primary' WHEN r.second - selection <= 3 THEN 'secondary' ELSE 'other' END AS role FROM q LEFT JOIN (SELECT id, selection AS second FROM q WHERE place = 2) r USING (id))"""


@register("led8_families", f"WITH {FAMILY_SQL}\nSELECT id, family, CAST(selection AS BIGINT) AS selection, CAST(total AS BIGINT) AS total, CAST(place AS INT) AS place, role FROM k")
def led8(spark, sf_dir):
    return family_places(spark, sf_dir).select("id", "family", F.col("selection").cast("bigint").alias("selection"), F.col("total").cast("bigint").alias("total"), "place", "role")


@register("led11_selection", f"WITH {FAMILY_SQL}\nSELECT a.id AS id, a.family AS lead_family, b.family AS runner_up, CAST(a.selection - b.selection AS BIGINT) AS margin, n AS families FROM k a LEFT JOIN (SELECT * FROM k WHERE place = 2) b ON b.id = a.id JOIN (SELECT id, count(*) AS n FROM k GROUP BY id) c ON c.id = a.id WHERE a.place = 1")
def led11(spark, sf_dir):
    return families.selection_summary(family_places(spark, sf_dir)).select("id", "lead_family", "runner_up", F.col("margin").cast("bigint").alias("margin"), "families")


@register("led12_family_groups", f"WITH {FAMILY_SQL}, {_LEADS_SQL}\nSELECT lead_family, count(*) AS leads, max(score) AS top_score, CAST(min(rank) AS BIGINT) AS top_rank FROM (SELECT l1.id, score, rank, k.family AS lead_family FROM l1 LEFT JOIN k ON k.id = l1.id AND k.role = 'primary' WHERE rank <= 200) g GROUP BY lead_family")
def led12(spark, sf_dir):
    out = families.group_summary(_lead_rank(spark, sf_dir, _base()), family_places(spark, sf_dir))
    return out.select("lead_family", "leads", "top_score", F.col("top_rank").cast("bigint").alias("top_rank"))


@register("led13_family_distribution", f"WITH {FAMILY_SQL}\nSELECT family, count(CASE WHEN role = 'primary' THEN 1 END) AS primary_leads, count(CASE WHEN role = 'secondary' THEN 1 END) AS secondary_leads, count(*) AS any_leads, round_even(100e0 * count(CASE WHEN role = 'primary' THEN 1 END) / (SELECT count(*) FROM awards), 2) AS primary_pct FROM k WHERE role <> 'other' GROUP BY family")
def led13(spark, sf_dir):
    return families.distribution(v.award_events(spark, sf_dir), family_places(spark, sf_dir))


@register("led13_assignment_counts", f"WITH {FAMILY_SQL}\nSELECT count(*) AS leads, count(CASE WHEN n IS NULL THEN 1 END) AS unassigned, count(CASE WHEN n > 1 THEN 1 END) AS ambiguous FROM awards LEFT JOIN (SELECT id, count(*) AS n FROM k WHERE role <> 'other' GROUP BY id) c USING (id)")
def led13_counts(spark, sf_dir):
    return families.assignment_counts(v.award_events(spark, sf_dir), family_places(spark, sf_dir))


@register("qua5_concentration", f"""WITH {FAMILY_SQL}, {_LEADS_SQL},
g AS (SELECT top, family, count(*) AS n FROM l1 JOIN (VALUES (10), (50)) t(top) ON rank <= top LEFT JOIN k ON k.id = l1.id AND k.role = 'primary' GROUP BY top, family),
m AS (SELECT *, sum(n) OVER (PARTITION BY top) AS leads, row_number() OVER (PARTITION BY top ORDER BY family IS NULL, n DESC, family DESC) AS p FROM g)
SELECT CAST(top AS INT) AS top, CAST(leads AS BIGINT) AS leads, family, round_even(n * 1e0 / leads, 4) AS share, n * 1e0 / leads > 0.5 AS collapsed FROM m WHERE p = 1""")
def qua5(spark, sf_dir):
    return families.concentration(_lead_rank(spark, sf_dir, _base()), family_places(spark, sf_dir))


# ---- evidence --------------------------------------------------------------------------------------

EVIDENCE_LANES = ("same_contract_id", "same_award_id", "same_uei")
_MEMBERS = "m AS (SELECT piid, count(*) AS n FROM awards GROUP BY piid HAVING count(*) BETWEEN 2 AND 200)"


def _clustered(spark, sf_dir, lanes_wanted=EVIDENCE_LANES):
    """Events, clusters and links, each computed once and kept in shared storage."""
    events = stored(v.award_events(spark, sf_dir), "events")
    found = stored(lanes.same_field(events, lanes_wanted), "clusters")
    return events, found, stored(lanes.links(events, found, lanes_wanted), "links")


@register("led3_event_correlations", awards_sql(f"SELECT a.id AS event_id, p AS place, lane, CAST(n AS BIGINT) AS event_count FROM (WITH {_MEMBERS} SELECT * FROM m) m JOIN awards a ON a.piid = m.piid CROSS JOIN (VALUES (1, 'same_uei'), (2, 'same_contract_id')) l(p, lane)"))
def led3(spark, sf_dir):
    _, found, links = _clustered(spark, sf_dir)
    return evidence.event_correlations(links, found).select("event_id", "place", "lane", "event_count")


_LINKED = f"{_LEADS_SQL}, {_MEMBERS},\nr AS (SELECT a.id AS lead_id, b.id AS event_id, b.occurred_at, b.agency_name, b.amount FROM (SELECT id FROM l1 WHERE rank <= 200) t JOIN awards a ON a.id = t.id JOIN m ON m.piid = a.piid JOIN awards b ON b.piid = a.piid AND b.id <> a.id)"


@register("led5_linked_sources", f"WITH {v.AWARDS_SQL}, {_LINKED}\nSELECT lead_id AS id, 'AWARDS' AS source, count(*) AS linked_events, 'same_contract_id,same_uei' AS lanes, string_agg(CASE WHEN p <= 5 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY event_id) AS p FROM r) x GROUP BY lead_id")
def led5(spark, sf_dir):
    events, found, links = _clustered(spark, sf_dir)
    out = evidence.linked_sources(_lead_rank(spark, sf_dir, _base()), links, found, events)
    return out.select("id", "source", "linked_events", F.array_join("lanes", ",").alias("lanes"), F.array_join(F.transform("sample_ids", lambda i: i.cast("string")), ",").alias("samples"))


@register("evd1_correlation_packages", awards_sql("SELECT 'same_contract_id|*|30|piid:' || piid AS correlation_key, count(*) AS members, min(occurred_at) AS first_at, max(occurred_at) AS last_at, CAST(date_diff('day', min(occurred_at), max(occurred_at)) AS INT) AS span_days, count(DISTINCT award_id) + count(DISTINCT piid) + count(DISTINCT recipient_uei) + count(DISTINCT psc) + count(DISTINCT naics) AS identifiers, min(agency_name) || ' (' || count(*) || ')' AS agencies FROM awards GROUP BY piid HAVING count(*) BETWEEN 2 AND 200"))
def evd1(spark, sf_dir):
    events, _, links = _clustered(spark, sf_dir, ("same_contract_id",))
    return evidence.correlation_packages(links, events).select("correlation_key", "members", "first_at", "last_at", "span_days", "identifiers", "agencies")


@register("evd1_timeline", awards_sql("SELECT 'same_contract_id|*|30|piid:' || piid AS correlation_key, CAST(p AS INT) AS place, id AS event_id, occurred_at AS at FROM (SELECT *, row_number() OVER (PARTITION BY piid ORDER BY occurred_at, id) AS p, count(*) OVER (PARTITION BY piid) AS n FROM awards) x WHERE n BETWEEN 2 AND 200 AND p <= 20"))
def evd1_timeline(spark, sf_dir):
    events, _, links = _clustered(spark, sf_dir, ("same_contract_id",))
    return evidence.timeline(evidence.members_of(links, events), "correlation_key")


@register("evd2_lead_packages", f"WITH {v.AWARDS_SQL}, {_LINKED}\nSELECT lead_id, count(*) AS members, min(occurred_at) AS first_at, max(occurred_at) AS last_at, min(agency_name) || ' (' || count(*) || ')' AS agencies FROM (SELECT lead_id, event_id, occurred_at, agency_name FROM r UNION SELECT a.id, a.id, a.occurred_at, a.agency_name FROM awards a JOIN l1 ON l1.id = a.id AND l1.rank <= 200) u GROUP BY lead_id")
def evd2(spark, sf_dir):
    events, _, links = _clustered(spark, sf_dir)
    return evidence.lead_packages(_lead_rank(spark, sf_dir, _base()), links, events).select("lead_id", "members", "first_at", "last_at", "agencies")


@register("evd4_dossiers", f"WITH {v.AWARDS_SQL}, {_LINKED}\nSELECT lead_id, CAST(p AS INT) AS place, event_id, 'same_uei' AS lane, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at DESC, event_id) AS p FROM r WHERE occurred_at >= TIMESTAMP '1996-01-01' AND occurred_at <= TIMESTAMP '2000-12-31') x WHERE p <= 8")
def evd4(spark, sf_dir):
    events, found, links = _clustered(spark, sf_dir)
    return evidence.dossiers(_lead_rank(spark, sf_dir, _base()), links, found, events, "1996-01-01", "2000-12-31")


@register("evd5_rationales", f"WITH {V3_SQL}\nSELECT CASE WHEN paired THEN 'reinforced' WHEN proxy >= 6 THEN 'direct' ELSE 'some_relevance' END AS trace_reason, CASE WHEN low OR NOT low AND psc = '1-URGENT' THEN 'routine_tags' WHEN noise > 0 THEN 'suppressed' ELSE 'none' END AS noise_reason, count(*) AS events FROM v3 GROUP BY 1, 2")
def evd5(spark, sf_dir):
    rows = scored_awards(spark, sf_dir)
    backed = (F.col("pair_bonus_applied") > 0) | (F.col("candidate_links") > 0)
    trace = evidence.traceability_rationale(F.col("proxy_relevance"), F.col("corroboration"), F.col("structural"), backed)
    noise = evidence.noise_rationale(F.lit(False), F.col("tags"), F.col("ranking_tier"), F.col("proxy_relevance"), F.col("structural"), F.col("noise_penalty"))
    return rows.groupBy(trace.alias("trace_reason"), noise.alias("noise_reason")).agg(F.count("*").alias("events"))


@register("led15_review_rows", "SELECT target, draft, missing, count(*) AS events FROM (SELECT 'solicitation' AS target, 'strong' AS draft, 'place_context' AS missing FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) x GROUP BY target, draft, missing")
def led15(spark, sf_dir):
    rows = evidence.review_rows(v.notice_events(spark, sf_dir))
    target = evidence.record_target(rows)
    return rows.groupBy(target.alias("target"), evidence.draftability(target, F.lit(False)).alias("draft"), F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("events"))


@register("led14_why", f"WITH {V3_SQL}\nSELECT id, 'tier ' || tier || '; relevance ' || proxy || '; corroboration ' || corr || CASE WHEN noise > 0 THEN '; noise ' || least(20, noise) ELSE '' END AS why FROM v3")
def led14(spark, sf_dir):
    why = evidence.why_summary(F.col("proxy_relevance"), F.col("corroboration"), F.col("noise_penalty"), F.col("ranking_tier"), F.lit(None).cast("string"))
    return scored_awards(spark, sf_dir).select("id", why.alias("why"))


@register("led16_review_summary", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}\nSELECT count(*) AS leads, min(occurred_at) AS first_at, max(occurred_at) AS last_at, CAST(date_diff('day', min(occurred_at), max(occurred_at)) AS INT) AS span_days, count(*) AS has_foia_handles, count(*) AS has_place_context FROM l1 JOIN awards USING (id) WHERE rank <= 200")
def led16(spark, sf_dir):
    rows = evidence.review_rows(_lead_rank(spark, sf_dir, _base()))
    return evidence.review_summary(rows).select("leads", "first_at", "last_at", "span_days", "has_foia_handles", "has_place_context")


# ---- cluster views, seeds, exports -----------------------------------------------------------------


@register("qry4_cluster_view", awards_sql("""SELECT lower(naics) AS word, events, agency, CAST(n AS BIGINT) AS n FROM (SELECT naics, agency_name AS agency, count(*) AS n, sum(count(*)) OVER (PARTITION BY naics) AS e, CAST(sum(count(*)) OVER (PARTITION BY naics) AS BIGINT) AS events, row_number() OVER (PARTITION BY naics ORDER BY count(*) DESC, agency_name) AS p FROM awards GROUP BY naics, agency_name) x WHERE p <= 5"""))
def qry4(spark, sf_dir):
    events = v.award_events(spark, sf_dir)
    found = lanes.keyword_clusters(events, 3, None).where(F.startswith("key", F.lit("seg:")))
    members = events.select("id", F.explode("keywords").alias("key"), "agency_name").join(found.select("key", "event_count"), "key")
    top = views.top_values(members, ("key", "event_count"), "agency_name", 5)
    return top.select(F.substring_index("key", ":", -1).alias("word"), F.col("event_count").alias("events"), F.col("value").alias("agency"), "n")


@register("src9_seed", "SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier")
def src9(spark, sf_dir):
    customers = v.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct()
    suppliers = v.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return customers.union(merge.new_rows(customers, suppliers, "name").select("name"))


@register("snk2_event_entities", awards_sql("SELECT id, entity_id, CASE WHEN entity_id % 4 <> 0 THEN upper(recipient_name) ELSE recipient_name END AS name, recipient_uei AS uei FROM awards"))
def snk2(spark, sf_dir):
    customers = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    events = v.award_events(spark, sf_dir)
    raw = F.to_json(F.struct(F.col("recipient_uei").alias("RECIPIENT Uei"), F.col("recipient_name").alias("Recipient_Name")))
    bare = lambda c, n: F.when(F.col("id") % n != 0, F.col(c))
    events = events.withColumn("raw_json", raw).withColumns({"recipient_uei": bare("recipient_uei", 2), "recipient_name": bare("recipient_name", 3)})
    return exports.event_entities(events, customers.where("entity_id % 4 != 0").withColumn("name", F.upper("name")), "raw_json")


@register("snk3_correlations", awards_sql("SELECT 'same_contract_id|*|30|piid:' || piid AS correlation_key, count(*) AS event_count, count(*) AS members, min(id) AS first_id, max(id) AS last_id FROM awards GROUP BY piid HAVING count(*) BETWEEN 2 AND 200"))
def snk3(spark, sf_dir):
    events, found, links = _clustered(spark, sf_dir, ("same_contract_id",))
    m = F.col("members")
    return exports.correlation_rows(found, links, events).select("correlation_key", "event_count", F.size(m).cast("bigint").alias("members"), F.element_at(m, 1)["event_id"].alias("first_id"), F.element_at(m, -1)["event_id"].alias("last_id"))


@register("snk5_candidates", CANDIDATE_SQL.replace("SELECT notice AS notice_id, award AS award_event_id, CAST(score AS BIGINT) AS score, incumbent AS likely_incumbent, place FROM r WHERE place <= 10", "SELECT notice AS notice_id, award AS award_event_id, CAST(score AS BIGINT) AS score, n.recipient_name AS notice_recipient_name, a.recipient_name AS award_recipient_name, a.agency_name AS award_agency_name FROM r JOIN n ON n.id = notice JOIN a ON a.id = award WHERE place <= 10 AND score >= 50"))
def snk5(spark, sf_dir):
    notices, awards = candidate_sides(spark, sf_dir)
    out = exports.candidate_rows(candidates.candidate_join(notices, awards), notices, awards, min_score=50)
    return out.select("notice_id", "award_event_id", "score", "notice_recipient_name", "award_recipient_name", "award_agency_name")


@register("snk8_delta_rows", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL},\nd AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN o.rank <> n.rank OR o.score <> n.score THEN 'changed' ELSE 'same' END AS change_type, o.id AS oid, n.id AS nid FROM (SELECT * FROM l1 WHERE rank <= 200) o FULL OUTER JOIN (SELECT * FROM l2 WHERE rank <= 200) n ON o.id = n.id)\nSELECT d.id AS id, change_type, o.recipient_name AS from_recipient_name, n.recipient_name AS to_recipient_name FROM d LEFT JOIN awards o ON o.id = oid LEFT JOIN awards n ON n.id = nid WHERE change_type <> 'same'")
def snk8(spark, sf_dir):
    old, new = _lead_rank(spark, sf_dir, _base()), _lead_rank(spark, sf_dir, _boosted())
    return exports.delta_rows(scoring.delta(old, new), old, new, ("recipient_name",)).select("id", "change_type", "from_recipient_name", "to_recipient_name")


@register("snk11_search_documents", awards_sql("SELECT sha256('AWARDS|' || id) AS hash, id, recipient_name FROM awards"))
def snk11(spark, sf_dir):
    return exports.search_documents(v.award_events(spark, sf_dir), ("recipient_name",))


# ---- gates -----------------------------------------------------------------------------------------

#: The policy of these queries (fixed values).
POLICY = [("events", ">=", 1000, "volume", "error", True), ("entities", ">=", 100, "volume", "error", True), ("keyword_pct", ">=", 95, "coverage", "warning", False), ("small_pct", "<=", 1, "coverage", "warning", False), ("undated", "==", 0, "time", "error", True), ("absent", ">", 0, "time", "warning", False)]


def _checks(spark, sf_dir):
    small = F.bround(100 * F.count_if(F.col("amount") < 50000) / F.count("*"), 2)
    row = v.award_events(spark, sf_dir).agg(F.count("*").alias("events"), F.count_distinct("entity_id").alias("entities"), F.bround(100 * F.count_if(F.size("keywords") > 0) / F.count("*"), 2).alias("keyword_pct"), small.alias("small_pct"), F.count_if(F.col("occurred_at").isNull()).alias("undated"))
    return quality.checked(quality.long_metrics(row), quality.policy(spark, POLICY))


_CHECK_SQL = """a AS (SELECT CAST(count(*) AS DOUBLE) AS events, CAST(count(DISTINCT entity_id) AS DOUBLE) AS entities, 100e0 AS keyword_pct, round_even(100e0 * count(CASE WHEN amount < 50000 THEN 1 END) / count(*), 2) AS small_pct, CAST(count(CASE WHEN occurred_at IS NULL THEN 1 END) AS DOUBLE) AS undated FROM awards),
g AS (SELECT 'events' AS metric, 'volume' AS category, events AS value, events >= 1000 AS ok, TRUE AS required FROM a UNION ALL SELECT 'entities', 'volume', entities, entities >= 100, TRUE FROM a UNION ALL SELECT 'keyword_pct', 'coverage', keyword_pct, keyword_pct >= 95, FALSE FROM a
      UNION ALL SELECT 'small_pct', 'coverage', small_pct, small_pct <= 1, FALSE FROM a UNION ALL SELECT 'undated', 'time', undated, undated = 0, TRUE FROM a UNION ALL SELECT 'absent', 'time', NULL, FALSE, FALSE FROM a)"""


@register("qua1_checks", f"WITH {v.AWARDS_SQL}, {_CHECK_SQL}\nSELECT metric, category, value, ok FROM g")
def qua1(spark, sf_dir):
    return _checks(spark, sf_dir).select("metric", "category", "value", "ok")


@register("qua2_check_groups", f"WITH {v.AWARDS_SQL}, {_CHECK_SQL}\nSELECT category, count(*) AS checks, count(CASE WHEN ok THEN 1 END) AS passed, count(CASE WHEN NOT ok THEN 1 END) AS failed, count(CASE WHEN NOT ok AND required THEN 1 END) AS failed_required, CASE WHEN count(CASE WHEN NOT ok AND required THEN 1 END) > 0 THEN 'failed' WHEN count(CASE WHEN NOT ok THEN 1 END) > 0 THEN 'warning' ELSE 'passed' END AS status FROM g GROUP BY category")
def qua2(spark, sf_dir):
    return quality.check_groups(_checks(spark, sf_dir))


@register("qua3_run_status", f"WITH {v.AWARDS_SQL}, {_CHECK_SQL}\nSELECT count(CASE WHEN NOT ok AND required THEN 1 END) AS hard, count(CASE WHEN NOT ok AND NOT required THEN 1 END) AS soft, string_agg(CASE WHEN NOT ok THEN category || ':' || metric END, ',' ORDER BY category || ':' || metric) AS reasons, CASE WHEN count(CASE WHEN NOT ok AND required THEN 1 END) > 0 THEN 'failed' WHEN count(CASE WHEN NOT ok THEN 1 END) > 0 THEN 'warning' ELSE 'ok' END AS workflow_status FROM g")
def qua3(spark, sf_dir):
    return quality.run_status(_checks(spark, sf_dir)).select("hard", "soft", F.array_join("reasons", ",").alias("reasons"), "workflow_status")


_RUN_SQL = """r AS (SELECT agency_name AS run, count(*) AS n, count(CASE WHEN psc <> '5-LOW' THEN 1 END) * CAST(count(*) % 5 > 0 AS INT) AS events_window, count(CASE WHEN naics = 'BUILDING' THEN 1 END) * CAST(count(*) % 2 AS INT) AS kw, count(CASE WHEN naics = 'MACHINERY' THEN 1 END) % 3 AS ent, count(CASE WHEN amount > 200000 THEN 1 END) % 3 AS items FROM awards GROUP BY agency_name),
k AS (SELECT *, n % 7 <> 0 AS k1, n % 4 <> 0 AS k2, n % 2 = 0 AS k3, n % 11 <> 0 AS k4, n % 3 <> 0 AS k5, n % 3 = 1 AS retried, n % 6 = 1 AS compared, n % 13 > 1 AS fresh, items > 0 OR events_window > 0 AND (kw > 0 OR ent > 0) AS usable FROM r),
s AS (SELECT *, NOT (k1 AND k2 AND k4) AS hard, NOT (k3 AND k5) OR compared AS soft FROM k),
q AS (SELECT *, CASE WHEN retried AND usable AND NOT hard THEN 'rate_limited' WHEN NOT usable THEN CASE WHEN NOT k1 THEN 'degraded' ELSE 'sparse' END WHEN hard OR soft THEN 'degraded' ELSE 'healthy' END AS quality FROM s)"""


@register("qua3_run_quality", f"""WITH {v.AWARDS_SQL}, {_RUN_SQL}
SELECT run, CASE WHEN hard THEN 'failed' WHEN soft THEN 'warning' ELSE 'ok' END AS workflow_status, quality, usable AS has_usable_artifacts, usable AND NOT hard AND (soft OR quality IN ('degraded', 'rate_limited')) AS partially_useful,
  concat_ws(',', CASE WHEN NOT k1 THEN 'required_check_failed:workflow_execution' END, CASE WHEN NOT k2 THEN 'required_check_failed:events_window' END, CASE WHEN NOT k4 THEN 'required_check_failed:top_leads' END, CASE WHEN NOT k3 THEN 'advisory_check_failed:mission_mix' END, CASE WHEN NOT k5 THEN 'advisory_check_failed:signal' END,
    CASE WHEN compared THEN 'comparison_empty' END, CASE WHEN quality <> 'healthy' THEN 'quality_' || quality END, CASE WHEN NOT k4 THEN 'mission_quality_failed' WHEN NOT k3 THEN 'mission_quality_warning' END, CASE WHEN NOT fresh AND events_window = 0 THEN 'empty_window_or_no_fresh_ingest' END, CASE WHEN retried THEN 'rate_limit_retries_observed' END) AS reason_codes,
  concat_ws(',', CASE WHEN NOT k1 THEN 'pipeline_health' END, CASE WHEN NOT k2 THEN 'source_coverage_context_health' END, CASE WHEN NOT k4 THEN 'mission_quality' END) AS required, concat_ws(',', CASE WHEN NOT k3 THEN 'mission_quality' END, CASE WHEN NOT k5 THEN 'lead_signal_quality' END) AS advisory FROM q""")
def qua3_quality(spark, sf_dir):
    """Each nation's awards are a run."""
    n, psc, naics = F.count("*"), F.col("psc"), F.col("naics")
    runs = v.award_events(spark, sf_dir).groupBy(F.col("agency_name").alias("run")).agg(n.alias("n"), F.count_if(psc != "5-LOW").alias("w"), F.count_if(naics == "BUILDING").alias("kw"), F.count_if(naics == "MACHINERY").alias("ent"), F.count_if(F.col("amount") > 200000).alias("items"))
    n = F.col("n")
    policy = [(1, "workflow_execution", "pipeline_health", True, n % 7 != 0), (2, "events_window", "source_coverage_context_health", True, n % 4 != 0), (3, "mission_mix", "mission_quality", False, n % 2 == 0), (4, "top_leads", "mission_quality", True, n % 11 != 0), (5, "signal", "lead_signal_quality", False, n % 3 != 0)]
    checks = runs.select("run", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(m).alias("metric"), F.lit(c).alias("category"), F.lit(r).alias("required"), ok.alias("ok")) for p, m, c, r, ok in policy])).alias("c")).select("run", "c.*")
    retries = F.when(n % 3 == 1, 2).otherwise(0)
    facts = runs.select("run", F.when(n % 5 > 0, F.col("w")).otherwise(0).alias("events_window"), (F.col("kw") * (n % 2)).alias("events_with_keywords"), (F.col("ent") % 3).alias("events_with_entity"), (F.col("items") % 3).alias("snapshot_items"), (n % 13 > 1).alias("ingest_nonzero"), retries.alias("rate_limit_retries"), (retries * 2).alias("retry_attempts_total"), F.when(n % 6 == 1, F.array(F.lit("comparison_empty"))).alias("comparison_reason_codes"))
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return quality.run_quality(checks, facts).select("run", "workflow_status", "quality", "has_usable_artifacts", "partially_useful", joined("reason_codes", "reason_codes"), joined("required_failure_categories", "required"), joined("advisory_failure_categories", "advisory"))


@register("led6_detail_defaults", f"""WITH {v.AWARDS_SQL}
SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'kw_pair' END, CASE WHEN id % 2 = 0 THEN 'same_uei' END, CASE WHEN id % 5 = 0 THEN 'same_naics' END) AS lanes,
  CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'noise_terms:' || lower(naics) || ',sector:low_value' ELSE 'sector:' || lower(naics) || ',sector:low_value' END AS rules,
  CASE WHEN id % 7 = 0 THEN 9 WHEN id % 3 = 0 THEN 2 ELSE 0 END AS pair_count, CASE WHEN id % 3 = 0 THEN round_even((id % 11) / 10e0 + 0.5e0, 4) ELSE 0e0 END AS pair_strength,
  CASE WHEN id % 6 = 0 THEN 4 ELSE 0 END AS bonus, CASE WHEN id % 8 = 0 THEN 1 WHEN id % 6 = 0 THEN 4 ELSE 0 END AS cap, CASE WHEN id % 10 = 0 THEN 3 ELSE 0 END AS cross_lane,
  CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'noise terms: ' || lower(naics) ELSE 'sector: ' || lower(naics) END AS first_signal,
  CASE WHEN id % 9 < 5 THEN CASE WHEN id % 9 = 0 THEN 77 ELSE 12 + id % 5 - id % 3 END WHEN id % 9 = 0 THEN 77 END AS total FROM awards""")
def led6(spark, sf_dir):
    k = F.col("id")
    clause = lambda pack, rule, weight: F.struct(pack.alias("pack"), rule.alias("rule"), F.lit("snippet").alias("field"), F.lit(" x ").alias("match"), F.lit("phrase").alias("type"), weight.alias("weight"))
    clauses = F.when(k % 4 > 0, F.array(clause(F.lit("sector"), F.lit("low_value"), F.lit(1)), clause(F.when(k % 4 == 1, " noise_terms ").otherwise("sector"), F.lower("naics"), F.lit(5)), clause(F.lit(""), F.lit("unnamed"), F.lit(None).cast("int"))))
    some = lambda n, value: F.when(k % n == 0, F.lit(value))
    rows = v.award_events(spark, sf_dir)
    columns = {"pair_count": some(7, 9), "pair_bonus": some(6, 4), "pair_bonus_quality_cap": some(8, 1), "cross_lane_bonus": some(10, 3), "proxy_relevance_score": F.lit(12), "investigability_score": (k % 5).cast("int"), "noise_penalty": (k % 3).cast("int"), "total_score": some(9, 77), "scoring_version": F.when(k % 9 < 5, "v3").otherwise("v2")}
    leads = rows.select("id", clauses.alias("clauses"), *[c.alias(name) for name, c in columns.items()])
    lane = lambda n, name, key, share: F.when(k % n == 0, F.struct(F.lit(name).alias("lane"), F.lit(key).alias("key"), share.alias("contribution")))
    every = F.array_compact(F.array(lane(5, "same_naics", "n", F.lit(None).cast("double")), lane(3, "kw_pair", "p1", (k % 11) / 10), lane(2, "same_uei", "u", F.lit(0.0)), lane(3, "kw_pair", "p2", F.lit(0.5))))
    correlations = rows.select("id", F.explode(every).alias("c")).select("id", "c.*")
    out = details.enriched(leads, correlations)
    return out.select("id", F.array_join("contributing_lanes", ",").alias("lanes"), F.array_join("matched_rules", ",").alias("rules"), "pair_count", "pair_strength", F.col("pair_bonus_applied").alias("bonus"), F.col("pair_bonus_quality_cap").alias("cap"), F.col("cross_lane_bonus").alias("cross_lane"), F.when(F.size("matched_clauses") > 0, F.try_element_at(F.transform(F.filter("top_positive_signals", lambda s: s["pack"] != ""), lambda s: s["label"]), F.lit(1))).alias("first_signal"), F.col("total_score").alias("total"))


@register("qua12_comparison", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}\nSELECT count(CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN 1 END) AS shared, count(CASE WHEN o.id IS NULL THEN 1 END) AS entered, count(CASE WHEN n.id IS NULL THEN 1 END) AS dropped, count(o.id) AS base_leads, count(n.id) AS target_leads, TRUE AS comparable FROM (SELECT * FROM l1 WHERE rank <= 200) o FULL OUTER JOIN (SELECT * FROM l2 WHERE rank <= 200) n ON o.id = n.id")
def qua12(spark, sf_dir):
    return quality.comparison_checks(scoring.compare(_lead_rank(spark, sf_dir, _base()), _lead_rank(spark, sf_dir, _boosted())))
