"""Registered queries of single steps: identities, associations, filters, parts of scores, evidence and gates, with equivalent DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import streaming
from ..functions.association import pair_signal
from ..operators import candidates, entities, evidence, families, filters, quality, relevance, scoring
from ..sources import exports
from ..sources import views as v
from .leads import _LINKED, FAMILY_SQL, _clustered, family_places
from .queries import _LEADS_SQL, RULES, TAG_SQL, _base, _lead_rank, awards_sql, register, shared_folder

# ---- identities, associations --------------------------------------------------------------------

_IDENTITY_SQL = "SELECT id, CASE WHEN id % 2 = 0 THEN upper(recipient_uei) END AS uei, CASE WHEN id % 3 = 0 THEN 'C' || entity_id END AS cage, CASE WHEN id % 5 = 0 THEN 'r' || entity_id END AS recipient_id, CASE WHEN id % 7 = 0 THEN recipient_name END AS name FROM awards"


def _identities(spark, sf_dir):
    some = lambda n, c: F.when(F.col("id") % n == 0, c)
    number = F.col("entity_id").cast("string")
    rows = v.award_events(spark, sf_dir).withColumns({"recipient_uei": some(2, F.lower("recipient_uei")), "recipient_cage": some(3, F.concat(F.lit(" c"), number)), "recipient_id": some(5, F.concat(F.lit("r"), number)), "recipient_name": some(7, F.col("recipient_name"))})
    return entities.identity(rows)


@register("ent1_identities", awards_sql(_IDENTITY_SQL))
def ent1(spark, sf_dir):
    return _identities(spark, sf_dir).select("id", "uei", "cage", "recipient_id", "name")


@register("ent2_display_names", awards_sql(f"SELECT id, coalesce(name, 'UEI:' || uei, 'CAGE:' || cage, 'RID:' || recipient_id) AS display FROM ({_IDENTITY_SQL}) i"))
def ent2(spark, sf_dir):
    return _identities(spark, sf_dir).select("id", "display")


@register("cor6_association", awards_sql("""n AS (SELECT naics, psc, count(*) AS c12, max(c1) AS c1, max(c2) AS c2, max(t) AS t FROM (SELECT naics, psc, count(*) OVER (PARTITION BY naics) AS c1, count(*) OVER (PARTITION BY psc) AS c2, count(*) OVER () AS t FROM awards) w GROUP BY naics, psc),
m AS (SELECT *, c12 + 0.5e0 AS a, greatest(c1 - c12, 0) + 0.5e0 AS b, greatest(c2 - c12, 0) + 0.5e0 AS c, greatest(t - c1 - c2 + c12, 0) + 0.5e0 AS d FROM n),
s AS (SELECT *, a + b + c + d AS s, (a / (a + b + c + d)) / (((a + b) / (a + b + c + d)) * ((a + c) / (a + b + c + d))) AS lift FROM m)
SELECT naics, psc, round_even(ln(lift), 6) AS pmi, round_even(ln(lift) / -ln(a / s), 6) AS npmi, round_even(ln(a * d / (b * c)), 6) AS log_odds, round_even(c12 * 1e0 * t / (c1 * c2), 6) AS lift_raw, round_even(c1 * 1e0 * c2 / t, 6) AS expected_count FROM s""").replace(")\nn AS", "),\nn AS"))
def cor6(spark, sf_dir):
    events = v.award_events(spark, sf_dir).select("naics", "psc")
    both = events.groupBy("naics", "psc").agg(F.count("*").alias("c12"))
    first, second = both.groupBy("naics").agg(F.sum("c12").alias("c1")), both.groupBy("psc").agg(F.sum("c12").alias("c2"))
    rows = both.join(first, "naics").join(second, "psc").crossJoin(F.broadcast(both.agg(F.sum("c12").alias("t"))))  # the total is one row
    signal = pair_signal(*(F.col(c) for c in ("t", "c1", "c2", "c12")))
    return rows.select("naics", "psc", *[F.bround(signal[n], 6).alias(n) for n in ("pmi", "npmi", "log_odds", "lift_raw", "expected_count")])


@register("jn2_index_keys", awards_sql("k AS (SELECT 'token' AS kind, id, award_id AS key FROM awards UNION SELECT 'token', id, piid FROM awards UNION SELECT 'uei', id, recipient_uei FROM awards UNION SELECT 'name', id, upper(replace(recipient_name, '#', ' ')) FROM awards UNION SELECT 'psc', id, psc FROM awards UNION SELECT 'naics', id, naics FROM awards UNION SELECT 'region', id, upper(country) || ':' || upper(state) FROM awards) SELECT kind, key, count(*) AS n FROM k GROUP BY kind, key").replace(")\nk AS", "),\nk AS"))
def jn2(spark, sf_dir):
    keys = candidates.index_keys(candidates.features(v.award_events(spark, sf_dir), candidates.AWARD_IDS))
    kinds = keys.where(F.col("kind").isin("token", "uei", "name", "psc", "naics", "region"))
    return kinds.groupBy("kind", "key").agg(F.count("*").alias("n"))


@register("jn6_linked_records", f"WITH {v.AWARDS_SQL}, {_LINKED}\nSELECT lead_id AS id, event_id, count(*) * 2 AS clusters FROM r GROUP BY lead_id, event_id")
def jn6(spark, sf_dir):
    _, _, links = _clustered(spark, sf_dir)
    rows = evidence.linked_records(_lead_rank(spark, sf_dir, _base()), links)
    return rows.groupBy("id", "event_id").agg(F.count("*").alias("clusters"))


@register("nrm21_lane_order", awards_sql("c AS (SELECT id, count(*) OVER (PARTITION BY piid) AS p, count(*) OVER (PARTITION BY recipient_uei) AS u FROM awards) SELECT id AS event_id, CAST(1 AS INT) AS place, 'same_uei' AS lane FROM c WHERE u BETWEEN 2 AND 200 UNION ALL SELECT id, CAST(CASE WHEN u BETWEEN 2 AND 200 THEN 2 ELSE 1 END AS INT), 'same_contract_id' FROM c WHERE p BETWEEN 2 AND 200").replace(")\nc AS", "),\nc AS"))
def nrm21(spark, sf_dir):
    _, found, links = _clustered(spark, sf_dir, ("same_uei", "same_contract_id"))
    return evidence.event_correlations(links, found).select("event_id", "place", "lane")


@register("qry5_correlation_detail", awards_sql("SELECT 'same_contract_id|*|30|piid:' || piid AS correlation_key, count(*) AS event_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM awards WHERE piid LIKE '%7' GROUP BY piid HAVING count(*) BETWEEN 2 AND 200"))
def qry5(spark, sf_dir):
    events, found, links = _clustered(spark, sf_dir, ("same_contract_id",))
    rows = exports.correlation_rows(found.where("endswith(correlation_key, '7')"), links, events)
    return rows.select("correlation_key", "event_count", F.array_join(F.transform("members", lambda m: m["event_id"].cast("string")), ",").alias("members"))


# ---- filters -------------------------------------------------------------------------------------


@register("flt2_literal_text", "SELECT p_partkey FROM (SELECT p_partkey, lower(p_brand || CASE p_size % 3 WHEN 0 THEN '_' WHEN 1 THEN '%' ELSE '-' END || p_type) AS t FROM part) x WHERE contains(t, '1_') OR contains(t, '2%')")
def flt2(spark, sf_dir):
    text = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "_").when(F.col("p_size") % 3 == 1, "%").otherwise("-"), "p_type")
    return v.table(spark, sf_dir, "part").where(filters.contains_text(text, "1_") | filters.contains_text(text, "2%")).select("p_partkey")


@register("flt3_visible_counts", awards_sql("SELECT country, count(*) AS events, count(CASE WHEN naics = 'BUILDING' THEN 1 END) AS visible, count(*) AS visible_unfiltered FROM awards GROUP BY country"))
def flt3(spark, sf_dir):
    events = v.award_events(spark, sf_dir)

    def shown(**asked):
        return F.count_if(filters.event_conditions(events, **asked)) if filters.any_filter(**asked) else F.count("*")

    return events.groupBy("country").agg(F.count("*").alias("events"), shown(naics="BUILDING").alias("visible"), shown(naics=None).alias("visible_unfiltered"))


@register("flt5_lead_candidates", awards_sql("SELECT id, CAST(floor(amount / 1000) AS BIGINT) AS score FROM (SELECT id, amount, occurred_at FROM awards WHERE country <> 'ASIA' AND occurred_at + INTERVAL 3 DAY <= TIMESTAMP '2001-07-01' AND occurred_at >= TIMESTAMP '2001-08-02' - INTERVAL 400 DAY ORDER BY occurred_at DESC, id DESC LIMIT 300) x WHERE floor(amount / 1000) >= 1 ORDER BY floor(amount / 1000) DESC, occurred_at DESC, id DESC LIMIT 100"))
def flt5(spark, sf_dir):
    events = v.award_events(spark, sf_dir).withColumns({"created_at": F.col("occurred_at").cast("timestamp") + F.expr("INTERVAL 3 DAYS"), "source": F.col("country")})
    rows = events.where(filters.lead_conditions(events, v.AS_OF, 400, created_to="2001-07-01", exclude_source="ASIA"))
    return scoring.ranked(rows, _base(), limit=100, scan=300).select("id", "score")


@register("flt7_family_leads", f"WITH {FAMILY_SQL}\nSELECT DISTINCT id FROM k WHERE family = 'builders' AND role IN ('primary', 'secondary')")
def flt7(spark, sf_dir):
    return families.matches_family(family_places(spark, sf_dir), "builders")


@register("flt9_support_window", awards_sql("SELECT country, count(CASE WHEN id % 3 <> 0 AND occurred_at >= TIMESTAMP '1997-01-01' AND occurred_at <= TIMESTAMP '1999-12-31' THEN 1 END) AS inside, count(*) AS events FROM awards GROUP BY country"))
def flt9(spark, sf_dir):
    at = F.when(F.col("id") % 3 != 0, F.col("occurred_at"))
    return v.award_events(spark, sf_dir).groupBy("country").agg(F.count_if(filters.in_window(at, "1997-01-01", "1999-12-31")).alias("inside"), F.count("*").alias("events"))


@register("hnt2_hard_filters", awards_sql("SELECT id FROM awards WHERE (psc IN ('1-URGENT', '2-HIGH')) AND naics <> 'BUILDING' AND contains(lower(agency_name), 'on_1') AND (id % 5 = 0 OR amount >= 100000)"))
def hnt2(spark, sf_dir):
    rows = v.award_events(spark, sf_dir).withColumns({"text": F.concat_ws(" ", "psc", "naics"), "amount": F.when(F.col("id") % 5 != 0, F.col("amount"))})
    return filters.hard_filters(rows, "text", include_any=("urgent", "high"), exclude_any=("building",), agency_like="ON_1", min_amount=100000).select("id")


# ---- parts of scores -----------------------------------------------------------------------------


@register("scr3_tiered_sums", "SELECT o_orderkey AS id, CAST(round_even(coalesce(sum(CASE WHEN k <= 2 THEN q ELSE 0.5e0 * q END), 0), 0) AS INT) AS total FROM orders LEFT JOIN (SELECT l_orderkey, q, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC) AS k FROM (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) - 20 AS q FROM lineitem) y WHERE q > 0) x ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def scr3(spark, sf_dir):
    values = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_quantity").cast("double") - 20).alias("q"))  # an order has few lines
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(values, "id", "left")
    return rows.select("id", scoring.tiered_sum(F.coalesce("q", F.array().cast("array<double>")), 2, 0.5).alias("total"))


_MAGNITUDE = "CASE WHEN pack = 'sam_proxy_x' THEN 4 + least(2, abs(w)) WHEN pack = 'sam_dod_x' THEN 3 + least(2, abs(w)) WHEN pack = 'sam_procurement_starter' THEN CASE WHEN abs(w) >= 2 THEN 2 ELSE 1 END WHEN pack = 'other' THEN 2 + least(1, least(2, abs(w))) ELSE 0 END"


@register("scr5_magnitudes", f"SELECT pack, w, CAST({_MAGNITUDE} AS INT) AS points, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'sam_proxy_x' WHEN 1 THEN 'sam_dod_x' WHEN 2 THEN 'sam_procurement_starter' WHEN 3 THEN 'other' ELSE 'operational_noise_terms' END AS pack, CAST(p_size % 7 - 3 AS INT) AS w FROM part) p GROUP BY ALL")
def scr5(spark, sf_dir):
    i = F.col("p_partkey") % 5
    pack = F.when(i == 0, "sam_proxy_x").when(i == 1, "sam_dod_x").when(i == 2, "sam_procurement_starter").when(i == 3, "other").otherwise("operational_noise_terms")
    rows = v.table(spark, sf_dir, "part").select(pack.alias("pack"), (F.col("p_size") % 7 - 3).cast("int").alias("w"))
    points = relevance.magnitude(relevance.bucket(F.col("pack")), F.col("w")).cast("int")
    return rows.groupBy("pack", "w", points.alias("points")).agg(F.count("*").alias("n"))


_PAIRED = "SELECT l_orderkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 5e0 END AS npmi, CAST(l_quantity AS BIGINT) % 5 AS n FROM lineitem"


def _paired(spark, sf_dir):
    strength = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount").cast("double") * 5)
    return v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), strength.alias("npmi"), (F.floor("l_quantity") % 5).alias("event_count"))


@register("scr8_pair_metrics", f"SELECT id, count(CASE WHEN npmi IS NULL OR npmi >= 0.15e0 AND n >= 2 THEN 1 END) AS pair_count, count(*) AS pair_count_total, round_even(sum(CASE WHEN npmi IS NULL THEN 1 / sqrt(greatest(n, 1)) WHEN npmi >= 0.15e0 AND n >= 2 THEN npmi ELSE 0 END), 4) AS pair_strength FROM ({_PAIRED.replace('CAST(l_quantity AS BIGINT)', 'CAST(floor(l_quantity) AS BIGINT)')}) p GROUP BY id")
def scr8(spark, sf_dir):
    return scoring.pair_metrics(_paired(spark, sf_dir)).withColumn("pair_strength", F.bround("pair_strength", 4))


@register("scr9_noisy_v2", awards_sql("SELECT id, s + CASE WHEN naics = 'BUILDING' THEN least(2, b) - 8 ELSE b END AS score, CASE WHEN naics = 'BUILDING' THEN least(2, b) ELSE b END AS bonus FROM (SELECT *, CAST(floor(amount / 1000) AS BIGINT) AS s, id % 13 AS b FROM awards) x"))
def scr9(spark, sf_dir):
    bonus = F.col("id") % 13
    score, less = scoring.noisy_v2(_base() + bonus, bonus, F.col("naics") == "BUILDING")
    return v.award_events(spark, sf_dir).select("id", score.alias("score"), less.alias("bonus"))


@register("scr11_metadata_sources", awards_sql("SELECT country, CAST(country IN ('ASIA', 'EUROPE') AS BOOLEAN) AS supported, count(*) AS n FROM awards GROUP BY country"))
def scr11(spark, sf_dir):
    source = F.when(F.col("country") == "ASIA", "SAM.gov").when(F.col("country") == "EUROPE", "sam-GOV").when(F.col("country") == "AFRICA", "usa").otherwise("sam.gov.x")
    return v.award_events(spark, sf_dir).groupBy("country", relevance.supports_metadata(source).alias("supported")).agg(F.count("*").alias("n"))


@register("scr15_top_signals", "SELECT o_orderkey AS id, coalesce(string_agg(l_linenumber || ':' || q, ',' ORDER BY q DESC, l_linenumber) FILTER (WHERE k <= 3), '') AS signals FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, q, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber) AS k FROM (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(floor(l_quantity) AS INT) % 4 AS q FROM lineitem) y) x ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def scr15(spark, sf_dir):
    signal = F.struct((F.floor("l_quantity").cast("int") % 4).alias("points"), F.col("l_linenumber").cast("string").alias("key"))
    lists = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(signal).alias("s"))  # an order has few lines
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(lists, "id", "left")
    listed = F.array_join(F.transform(relevance.top_signals("s", "points", 3), lambda x: F.concat_ws(":", x["key"], x["points"].cast("string"))), ",")
    return rows.select("id", F.coalesce(listed, F.lit("")).alias("signals"))


# ---- leads, gates --------------------------------------------------------------------------------


@register("led9_ontology_index", "SELECT o_custkey AS id, pack, rule, CAST(min_by(weight, origin * 100 + weight) AS INT) AS weight FROM (SELECT o_custkey, lower(o_orderpriority) AS pack, lower(o_orderstatus) AS rule, o_orderkey % 3 AS origin, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 7 END AS weight FROM orders) o GROUP BY o_custkey, pack, rule")
def led9(spark, sf_dir):
    key = F.col("o_orderkey")
    hits = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("pack"), F.col("o_orderstatus").alias("rule"), (key % 3).cast("int").alias("origin"), F.when(key % 4 != 0, (key % 7).cast("int")).alias("weight"))
    return families.ontology_index(hits).select("id", "pack", "rule", "weight")


@register("led10_corroboration", "SELECT o_custkey AS id, lower(o_orderpriority) AS lane, count(DISTINCT o_orderdate) AS links FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey, o_orderpriority")
def led10(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 != 0, "lane").otherwise("hint")
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), kind.alias("kind"), F.lower("o_orderpriority").alias("key"), F.col("o_orderdate").cast("string").alias("item"))
    return families.corroboration_summary(rows)


_EVALUATED = "SELECT country, count(*) AS n, count(CASE WHEN psc = '1-URGENT' THEN 1 END) AS urgent, count(CASE WHEN naics = 'BUILDING' THEN 1 END) AS building FROM awards GROUP BY country"


@register("qua7_evaluation_gates", awards_sql(f"""e AS ({_EVALUATED}), g AS (SELECT country, n % 11 AS t10, n % 60 AS t50, urgent % 11 AS plain, building % 11 AS backed, urgent % 2 = 0 AS complete, building % 3 = 0 AS fallback, (n % 100) / 100e0 AS share FROM e)
SELECT country, 'evaluation_artifact_completeness' AS metric, complete AS ok, TRUE AS required, 'critical' AS severity FROM g UNION ALL
SELECT country, 'evaluation_top10_non_routine_majority', plain >= (t10 + 1) // 2, FALSE, 'warning' FROM g UNION ALL
SELECT country, 'evaluation_top10_proxy_or_pairbacked_threshold', backed >= least(5, t10), FALSE, 'warning' FROM g UNION ALL
SELECT country, 'evaluation_family_collapse_threshold', t50 < 10 OR share <= 0.5, t50 >= 10 AND fallback, CASE WHEN t50 >= 10 AND fallback THEN 'error' ELSE 'warning' END FROM g""").replace(")\ne AS", "),\ne AS"))
def qua7(spark, sf_dir):
    rows = v.award_events(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("psc") == "1-URGENT").alias("urgent"), F.count_if(F.col("naics") == "BUILDING").alias("building"))
    n, urgent, building = (F.col(c) for c in ("n", "urgent", "building"))
    metrics = rows.select("country", (urgent % 2 == 0).alias("complete"), (n % 11).alias("top10"), (urgent % 11).alias("top10_non_routine"), (building % 11).alias("top10_backed"), (n % 60).alias("top50"), F.when(building % 3 == 0, quality.FALLBACK_FAMILY).otherwise("builders").alias("family"), (n % 100 / 100.0).alias("family_share"))
    return quality.evaluation_checks(metrics)


_REVIEWED = "SELECT id, rank, psc, CASE WHEN id % 3 = 0 THEN NULL ELSE piid END AS piid, CASE WHEN id % 4 = 0 THEN NULL ELSE agency_name END AS agency, id % 5 = 0 AS noisy FROM l1 JOIN awards USING (id) WHERE rank <= 200"


def _reviewed(spark, sf_dir):
    i = F.col("id")
    known = _lead_rank(spark, sf_dir, _base())
    rows = known.select("id", "rank", "psc", F.when(i % 3 != 0, F.col("piid")).alias("piid"), F.when(i % 4 != 0, F.col("agency_name")).alias("agency_name"), F.when(i % 5 == 0, 3).otherwise(0).alias("noise_penalty"), F.lit("candidate").alias("ranking_tier"))
    rows = evidence.review_rows(rows)
    return rows.withColumn("target", evidence.record_target(rows)).withColumn("draftability", evidence.draftability(F.col("target"), F.lit(False)))


_DRAFT = "CASE WHEN piid IS NOT NULL AND agency IS NOT NULL THEN 'strong' WHEN piid IS NOT NULL THEN 'moderate' WHEN agency IS NOT NULL THEN 'weak' ELSE 'blocked' END"


@register("qua8_draftability", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}\nSELECT id, CASE WHEN piid IS NULL THEN 'none' ELSE 'award' END AS target, CASE WHEN psc IS NULL THEN 'blocked' ELSE {_DRAFT} END AS draftability, CASE WHEN noisy AND piid IS NULL THEN 'high' WHEN NOT noisy AND piid IS NOT NULL AND agency IS NOT NULL THEN 'low' ELSE 'medium' END AS noise FROM ({_REVIEWED}) r")
def qua8(spark, sf_dir):
    no = F.lit(False)
    level = evidence.noise_level(F.col("noise_penalty") > 0, no, no, F.col("has_foia_handles"), F.col("has_agency_target"), no)
    return _reviewed(spark, sf_dir).select("id", "target", "draftability", level.alias("noise"))


_MISSION = f"m AS (SELECT count(*) AS leads, round_even(100e0 * count(piid) / count(*), 2) AS piid_pct, round_even(100e0 * count(agency) / count(*), 2) AS agency_name_pct, round_even(100e0 * count(CASE WHEN {_DRAFT} IN ('strong', 'moderate') THEN 1 END) / count(*), 2) AS draftable_pct, round_even(100e0 * count(CASE WHEN noisy THEN 1 END) / count(*), 2) AS noisy_pct FROM ({_REVIEWED}) r WHERE rank <= 50)"


@register("qua10_mission_quality", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}, {_MISSION}\nSELECT leads, piid_pct, agency_name_pct, draftable_pct, noisy_pct, CASE WHEN draftable_pct >= 60 AND noisy_pct <= 30 THEN 'useful' WHEN draftable_pct >= 30 AND noisy_pct <= 60 THEN 'mixed' ELSE 'weak' END AS verdict FROM m")
def qua10(spark, sf_dir):
    rows = quality.mission_metrics(_reviewed(spark, sf_dir), ("piid", "agency_name"))
    verdict = quality.verdict(F.col("draftable_pct"), F.col("noisy_pct"), F.col("context_only_pct"))
    return rows.select("leads", "piid_pct", "agency_name_pct", "draftable_pct", "noisy_pct", verdict.alias("verdict"))


#: The gates of this query (fixed values).
MISSION_POLICY = [("leads", ">=", 10, "volume", "error", True), ("piid_pct", ">=", 60, "coverage", "warning", False), ("agency_name_pct", ">=", 90, "coverage", "warning", False), ("draftable_pct", ">=", 50, "draft", "error", True), ("noisy_pct", "<=", 30, "noise", "warning", False)]


@register("qua11_mission_gates", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}, {_MISSION}\nSELECT 'leads' AS metric, CAST(leads AS DOUBLE) AS value, leads >= 10 AS ok FROM m UNION ALL SELECT 'piid_pct', piid_pct, piid_pct >= 60 FROM m UNION ALL SELECT 'agency_name_pct', agency_name_pct, agency_name_pct >= 90 FROM m UNION ALL SELECT 'draftable_pct', draftable_pct, draftable_pct >= 50 FROM m UNION ALL SELECT 'noisy_pct', noisy_pct, noisy_pct <= 30 FROM m")
def qua11(spark, sf_dir):
    rows = quality.mission_metrics(_reviewed(spark, sf_dir), ("piid", "agency_name")).select("leads", "piid_pct", "agency_name_pct", "draftable_pct", "noisy_pct")
    return quality.checked(quality.long_metrics(rows), quality.policy(spark, MISSION_POLICY)).select("metric", "value", "ok")


@register("str2_stream_tags", TAG_SQL + "SELECT doc_id AS id, count(*) AS clauses, CAST(sum(weight) AS BIGINT) AS tag_score FROM c GROUP BY doc_id")
def str2(spark, sf_dir):
    folder = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    schema = v.table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select(F.col("doc_id").alias("id"), F.col("text").alias("snippet"))
    rows = streaming.tagged(stream, RULES, ("snippet",)).select("id", F.size("clauses").cast("bigint").alias("clauses"), F.col("tag_score").cast("bigint").alias("tag_score"))
    rows.where("clauses > 0").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id bigint, clauses bigint, tag_score bigint").parquet(f"{folder}/rows")
