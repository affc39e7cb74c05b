"""Registered queries of landed feeds, canonical fields and exports, with equivalent DuckDB SQL.

Feeds and exports are written to the shared folder from the given tables and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.keyword_packs import PACKS
from ..operators import evidence, filters, lanes, merge, scoring, tagging
from ..sources import canonical, exports, landed
from ..sources import views as v
from .leads import _LINKED, FAMILY_SQL, _clustered, family_places
from .queries import _LEADS_SQL, _base, _boosted, _lead_rank, awards_sql, register, shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- feeds ---------------------------------------------------------------------------------------

PAGE_IDS = 400


def _write_pages(records: DataFrame, member: str, path: str, *by: str) -> str:
    """Pages of the records of ``PAGE_IDS`` ids each, a page a line; every fifth page is empty too."""
    paged = records.groupBy(*by, F.floor(F.col("id") / PAGE_IDS).alias("p")).agg(F.collect_list("record").alias("r"))
    full = paged.select(*by, F.to_json(F.struct(F.col("r").alias(member))).alias("value"))
    empty = paged.where("p % 5 = 0").select(*by, F.lit(f'{{"{member}": []}}').alias("value"))
    out = full.unionByName(empty).write
    (out.partitionBy(*by) if by else out).text(path)
    return path


@register("src1_award_pages", awards_sql("SELECT award_id, recipient_name, recipient_uei, naics AS naics_code, 'G' || award_id AS generated_unique_award_id, 'G' || award_id AS source_record_id, award_id AS document_id, country AS place_of_performance_country FROM awards"))
def src1(spark, sf_dir):
    record = F.struct(F.col("award_id").alias("Award ID"), F.concat(F.lit("G"), "award_id").alias("generated_unique_award_id"), F.concat(F.lit(" "), "recipient_name").alias("Recipient Name"), F.lower("recipient_uei").alias("UEI"), F.col("naics").alias("NAICS"), F.struct(F.lower("country").alias("countryCode")).alias("placeOfPerformance"))
    path = _write_pages(v.award_events(spark, sf_dir).select("id", record.alias("record")), "results", _folder(spark, "award-pages"))
    rows = canonical.award_fields(landed.award_pages(spark, path, one_a_file=False))
    return rows.select("award_id", "recipient_name", "recipient_uei", "naics_code", "generated_unique_award_id", "source_record_id", "document_id", "place_of_performance_country")


def _term_pages(spark, sf_dir) -> str:
    notices = v.notice_events(spark, sf_dir)
    record = F.struct(F.concat(F.lit("N"), F.col("id").cast("string")).alias("noticeId"), F.col("solicitation_number").alias("solicitationNumber"), F.date_format("occurred_at", "yyyy-MM-dd").alias("postedDate"))
    terms = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "kw0"), F.when(F.col("id") % 3 == 0, "kw1")))
    return _write_pages(notices.select("id", record.alias("record"), F.explode(terms).alias("term")), "opportunitiesData", _folder(spark, "notice-pages"), "term")


@register("src2_notice_pages", f"WITH {v.NOTICES_SQL}\nSELECT DISTINCT 'N' || CAST(id AS VARCHAR) AS notice_id, solicitation_number FROM notices WHERE id % 2 = 0 OR id % 3 = 0")
def src2(spark, sf_dir):
    rows = landed.normalized_notices(landed.notice_pages(spark, _term_pages(spark, sf_dir), one_a_file=False))
    return merge.first_rows(rows, "hash", ("occurred_at",)).select("notice_id", "solicitation_number")


@register("ing4_page_diagnostics", f"WITH {v.NOTICES_SQL}, t AS (SELECT 'kw0' AS term, id FROM notices WHERE id % 2 = 0 UNION ALL SELECT 'kw1', id FROM notices WHERE id % 3 = 0)\nSELECT term, count(DISTINCT id // 400) AS pages_with_data, count(DISTINCT CASE WHEN (id // 400) % 5 = 0 THEN id // 400 END) AS empty_pages, count(*) AS records FROM t GROUP BY term")
def ing4(spark, sf_dir):
    files = landed.page_diagnostics(landed.record_pages(spark, _term_pages(spark, sf_dir), "opportunitiesData", one_a_file=False))
    return files.groupBy(F.regexp_extract("source_file", "term=(kw[0-9])", 1).alias("term")).agg(*[F.sum(c).alias(c) for c in ("pages_with_data", "empty_pages", "records")])


@register("src3_posted_windows", awards_sql("SELECT 'days' AS kind, count(*) AS n, min(occurred_at) AS first_at FROM awards WHERE occurred_at >= TIMESTAMP '1999-12-02' AND occurred_at <= TIMESTAMP '2000-03-01' UNION ALL SELECT 'ends', count(*), min(occurred_at) FROM awards WHERE occurred_at >= TIMESTAMP '1998-01-05' AND occurred_at <= TIMESTAMP '1998-02-07'"))
def src3(spark, sf_dir):
    events = v.award_events(spark, sf_dir)

    def one(kind: str, window: tuple[str, str]) -> DataFrame:
        rows = events.where(filters.event_conditions(events, start=window[0], end=window[1]))
        return rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("occurred_at").alias("first_at"))

    return one("days", filters.posted_window(days=90, today="2000-03-01")).union(one("ends", filters.posted_window(posted_from="1998-01-05", posted_to="1998-02-07")))


@register("src6_ontology_summary", """SELECT sha256('{"defaults":{"case_insensitive":true,"default_weight":' || CAST(c_custkey % 5 AS VARCHAR) || '},"packs":[{"enabled":true,"id":"' || c_mktsegment || '","rules":[{"id":"r1","pattern":"' || c_name || '","type":"phrase"},{"id":"r2","pattern":"x","type":"regex","weight":2}]}' || CASE WHEN c_custkey % 2 = 0 THEN ',{"id":"more","rules":[]}' ELSE '' END || ']}') AS sha256, CAST(1 + CAST(c_custkey % 2 = 0 AS INT) AS INT) AS packs, CAST(2 AS INT) AS rules FROM customer""")
def src6(spark, sf_dir):
    """An ontology per customer, whose keys come in another order and with blanks."""
    more = F.when(F.col("c_custkey") % 2 == 0, F.lit(', {"rules": [], "id": "more"}')).otherwise("")
    text = F.concat(F.lit('{"packs": [{"id": "'), "c_mktsegment", F.lit('", "rules": [{"type": "phrase", "id": "r1", "pattern": "'), "c_name", F.lit('"}, {"weight": 2, "id": "r2", "pattern": "x", "type": "regex"}], "enabled": true}'), more, F.lit('], "defaults": {"default_weight": '), (F.col("c_custkey") % 5).cast("string"), F.lit(', "case_insensitive": true}}'))
    rows = v.table(spark, sf_dir, "customer").select(text.alias("ontology"))
    return landed.ontology_summary(landed.parsed_ontologies(rows, "ontology"))


_TERMS = sorted({t for terms in PACKS.values() for t in terms})
_PACK_ROWS = ", ".join(f"('{p}', '{t}')" for p, terms in PACKS.items() for t in terms)
_TERM_LIST = ", ".join(f"'{t}'" for t in _TERMS)


@register("src7_keyword_packs", f"WITH p(pack, term) AS (VALUES {_PACK_ROWS}), d AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || list_extract([{_TERM_LIST}], CAST(doc_id % {len(_TERMS)} AS INT) + 1)) AS t FROM documents)\nSELECT pack || ':' || term AS keyword, count(DISTINCT doc_id) AS n FROM d JOIN p ON contains(t, term) GROUP BY 1")
def src7(spark, sf_dir):
    """The packs' terms in documents to each of which one term is added in capitals."""
    docs = v.table(spark, sf_dir, "documents")
    own = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("doc_id") % len(_TERMS)).cast("int") + 1)
    tagged = tagging.pack_terms(docs.select("doc_id", F.concat_ws(" ", "text", F.upper(own)).alias("t")), F.col("t"), PACKS)
    return tagged.select("doc_id", F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count_distinct("doc_id").alias("n"))


@register("src8_term_lists", "SELECT term, CAST(min(l) AS INT) AS list FROM (SELECT p_brand AS term, 0 AS l FROM part WHERE p_size > 20 UNION ALL SELECT p_type, 1 FROM part UNION ALL SELECT p_brand, 1 FROM part) x GROUP BY term")
def src8(spark, sf_dir):
    part, path = v.table(spark, sf_dir, "part"), _folder(spark, "terms")
    lines = lambda c: F.explode(F.array(F.concat(F.lit("# "), c), F.concat(F.lit("  "), c, F.lit(" ")), F.lit("")))
    part.where("p_size > 20").select(lines(F.col("p_brand"))).write.text(f"{path}/first")
    part.select(lines(F.col("p_type"))).union(part.select(lines(F.col("p_brand")))).write.text(f"{path}/second")
    merged = landed.merged_terms(landed.term_list(spark, f"{path}/first"), landed.term_list(spark, f"{path}/second"))
    return merged.select("term", F.col("place.list").alias("list"))


_LABELLED = "SELECT source AS snapshot_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id // CASE WHEN doc_id % 17 = 0 THEN 34 ELSE 1 END AS VARCHAR) END AS event_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 29 AS INT) END AS rank, CASE WHEN doc_id % 19 = 0 THEN 'maybe' WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'reject' END AS decision, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS foia_ready, doc_id FROM documents"
_PROBLEM = "CASE WHEN decision = 'maybe' THEN 'decision' WHEN foia_ready IS NULL THEN 'foia_ready' WHEN rank IS NULL OR rank < 1 THEN 'rank' WHEN event_id IS NULL THEN 'identity' WHEN n > 1 THEN 'duplicate' END"


def _label_texts(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    event = F.when(i % 11 == 0, F.lit(" ")).otherwise(F.floor(i / F.when(i % 17 == 0, 34).otherwise(1)).cast("string"))
    rank, decision = F.when(i % 13 == 0, F.lit("first")).otherwise((i % 29).cast("string")), F.when(i % 19 == 0, "maybe").when(i % 2 == 0, " KEEP").otherwise("Reject")
    ready = F.when(i % 23 == 0, "perhaps").when(i % 3 == 0, "TRUE").otherwise("n")
    return v.table(spark, sf_dir, "documents").select(F.col("source").alias("snapshot_id"), event.alias("event_id"), rank.alias("rank"), decision.alias("decision"), ready.alias("foia_ready"), "doc_id")


@register("src10_label_files", f"SELECT snapshot_id, event_id, rank, decision, foia_ready, {_PROBLEM} AS problem FROM (SELECT *, count(*) OVER (PARTITION BY snapshot_id, event_id) AS n FROM ({_LABELLED}) l) x")
def src10(spark, sf_dir):
    rows, path = _label_texts(spark, sf_dir), _folder(spark, "labels")
    rows.where("doc_id % 2 = 0").drop("doc_id").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/csv/2024")
    rows.where("doc_id % 2 != 0").drop("doc_id").write.json(f"{path}/json/2024")
    return landed.label_files(spark, f"{path}/csv", f"{path}/json").drop("source_file")


@register("adj1_label_problems", f"SELECT coalesce({_PROBLEM}, 'none') AS problem, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY snapshot_id, event_id) AS n FROM ({_LABELLED}) l) x GROUP BY 1")
def adj1(spark, sf_dir):
    rows = landed.checked_labels(_label_texts(spark, sf_dir))
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


# ---- canonical fields ----------------------------------------------------------------------------


@register("nrm2_codes", "SELECT p_partkey, upper(p_type) AS code, lower(p_type) AS notice_type FROM part")
def nrm2(spark, sf_dir):
    spaced = F.concat(F.lit(" "), F.lower(F.replace("p_type", F.lit(" "), F.lit("  "))), F.lit("\t"))
    return v.table(spark, sf_dir, "part").select("p_partkey", nz.clean_code(spaced).alias("code"), nz.clean_label(spaced).alias("notice_type"))


@register("nrm4_first_present", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS text FROM part")
def nrm4(spark, sf_dir):
    """The first alias is null-like, of another case, or a list in some rows."""
    case, none = F.col("p_partkey") % 3, F.lit("n/a")
    first, second = F.when(case == 0, F.col("p_name")).otherwise(none), F.when(case == 1, F.col("p_type"))
    record = F.to_json(F.struct(first.alias("Award ID"), second.alias("AwardId"), F.array("p_size").alias("other"), F.struct(F.struct(F.col("p_brand").alias("Deep")).alias("B")).alias("a")))
    return v.table(spark, sf_dir, "part").select("p_partkey", canonical.lowered(record).alias("r")).select("p_partkey", canonical.first_of(F.col("r"), ("award id", "awardID", "other", "A.b.deep")).alias("text"))


_PLACE = ("place_of_performance_city", "place_of_performance_state", "place_of_performance_country", "place_of_performance_zip")


@register("nrm5_award_fields", awards_sql("SELECT id, award_id, CASE WHEN id % 4 = 0 THEN piid END AS piid, recipient_name, recipient_uei, upper(agency_name) AS awarding_agency_code, agency_name AS awarding_agency_name, upper(psc) AS psc_code, naics AS naics_code, notice_type AS notice_award_type, state AS place_of_performance_city, CASE WHEN id % 2 = 0 THEN state END AS place_of_performance_state, country AS place_of_performance_country, CASE id % 3 WHEN 0 THEN 'N' || award_id WHEN 1 THEN 'S' || award_id ELSE award_id END AS document_id, award_id AS source_record_id FROM awards"))
def nrm5(spark, sf_dir):
    i, third = F.col("id"), F.col("id") % 3
    when = lambda c, x: F.when(c, x)
    place = F.struct(F.when(i % 2 == 0, F.struct(F.lower("state").alias("code"))).alias("state"), F.col("state").alias("city"), F.col("country").alias("country_code"))
    record = F.struct(
        when(third == 0, F.col("award_id")).alias("AwardID"), when(third != 0, F.col("award_id")).alias("Award ID"), when(third == 0, F.col("award_id")).alias("awardid"), when(i % 4 == 0, F.col("piid")).alias("PIID"),
        F.col("recipient_name").alias("recipient"), F.lower("recipient_uei").alias("UEI"), F.lower("agency_name").alias("awarding_toptier_agency_code"), F.col("agency_name").alias("Awarding Agency Name"),
        F.lower("psc").alias("Product or Service Code"), F.concat(F.lit(" "), F.lower("naics")).alias("naicsCode"), F.col("psc").alias("Award Type"), place.alias("Place_Of_Performance"),
        when(third == 0, F.concat(F.lit("N"), "award_id")).alias("noticeId"), when(third != 2, F.concat(F.lit("S"), "award_id")).alias("solicitation"), F.lit("null").alias("document_id"), F.array().alias("uri"),
    )
    rows = canonical.award_fields(v.award_events(spark, sf_dir).select("id", F.to_json(record).alias("raw_json")))
    return rows.select("id", "award_id", "piid", "recipient_name", "recipient_uei", "awarding_agency_code", "awarding_agency_name", "psc_code", "naics_code", "notice_award_type", *_PLACE[:3], "document_id", "source_record_id")


def _notice_records(spark, sf_dir) -> DataFrame:
    i = F.col("id")
    award = F.when(i % 2 == 0, F.struct(F.concat(F.lit("AW"), "solicitation_number").alias("number"), F.concat(F.lit("AW"), "solicitation_number").alias("awardNumber"), F.struct(F.concat(F.lit("  "), "recipient_name").alias("legalBusinessName"), F.lower("recipient_uei").alias("ueiSAM"), F.lit("cg1").alias("cageCode")).alias("awardee")))
    place = F.struct(F.lit("1 Main St").alias("streetAddress"), F.struct(F.col("agency_name").alias("name")).alias("city"), F.when(i % 3 == 0, F.struct(F.lit("va").alias("code"))).alias("state"), F.lit("22202").alias("zip"), F.struct(F.when(i % 5 == 0, "USA").otherwise("DEU").alias("code")).alias("country"))
    record = F.struct(
        F.concat(F.lit("N"), i.cast("string")).alias("noticeId"), F.col("solicitation_number").alias("solicitationId"), F.upper("psc").alias("baseType"), F.col("agency_name").alias("fullParentPathName"), F.lower("agency_name").alias("organizationCode"),
        F.struct(F.lit("Office 1").alias("officeName"), F.lit("o1").alias("officeCode")).alias("officeAddress"), F.struct(F.col("naics").alias("code"), F.lit("what  it is").alias("description")).alias("naics"), F.lit("sba").alias("typeOfSetAside"),
        F.lit("Small Business").alias("typeOfSetAsideDescription"), F.when(i % 2 == 0, F.date_format("occurred_at", "MM/dd/yyyy")).otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("postedDate"), F.when(i % 3 == 0, "soon").alias("responseDeadLine"),
        F.when(i % 4 == 0, "Yes").when(i % 4 == 1, "inactive").when(i % 4 == 2, "unknown").alias("active"), F.lit("r499").alias("classificationCode"), award.alias("award"), place.alias("placeOfPerformance"),
    )
    return v.notice_events(spark, sf_dir).select("id", F.to_json(record).alias("raw_json"))


@register("nrm6_notice_fields", f"WITH {v.NOTICES_SQL}\nSELECT id, 'N' || CAST(id AS VARCHAR) AS notice_id, 'N' || CAST(id AS VARCHAR) AS document_id, solicitation_number, lower(psc) AS notice_award_type, agency_name AS awarding_agency_name, upper(agency_name) AS awarding_agency_code, 'Office 1' AS contracting_office_name, 'O1' AS contracting_office_code, 'R499' AS psc_code, upper(regexp_replace(naics, '[^A-Za-z0-9]', '', 'g')) AS naics_code, 'what it is' AS naics_description, CASE WHEN id % 2 = 0 THEN 'AW' || solicitation_number END AS award_id, CASE WHEN id % 2 = 0 THEN recipient_name END AS recipient_name, CASE WHEN id % 2 = 0 THEN upper(recipient_uei) END AS recipient_uei, CASE WHEN id % 2 = 0 THEN 'CG1' END AS recipient_cage_code FROM notices")
def nrm6(spark, sf_dir):
    rows = canonical.notice_fields(_notice_records(spark, sf_dir))
    return rows.select("id", "notice_id", "document_id", "solicitation_number", "notice_award_type", "awarding_agency_name", "awarding_agency_code", "contracting_office_name", "contracting_office_code", "psc_code", "naics_code", "naics_description", "award_id", "recipient_name", "recipient_uei", "recipient_cage_code")


@register("nrm7_places", f"WITH {v.NOTICES_SQL}\nSELECT id, agency_name AS place_of_performance_city, CASE WHEN id % 3 = 0 THEN 'VA' END AS place_of_performance_state, CASE WHEN id % 5 = 0 THEN 'USA' ELSE 'DEU' END AS place_of_performance_country, '22202' AS place_of_performance_zip FROM notices")
def nrm7(spark, sf_dir):
    return canonical.notice_fields(_notice_records(spark, sf_dir)).select("id", *_PLACE)


@register("nrm10_addresses", f"WITH {v.NOTICES_SQL}\nSELECT id, '1 Main St, ' || agency_name || CASE WHEN id % 3 = 0 THEN ', va 22202' ELSE ' 22202' END || CASE WHEN id % 5 = 0 THEN '' ELSE ', DEU' END AS notice_place, '1 Main St, ' || agency_name || CASE WHEN id % 3 = 0 THEN ', va 22202' ELSE ' 22202' END || CASE WHEN id % 5 = 0 THEN ', USA' ELSE ', DEU' END AS award_place FROM notices")
def nrm10(spark, sf_dir):
    rows = _notice_records(spark, sf_dir).select("id", canonical.lowered(F.col("raw_json")).alias("r"))
    place = F.lit("placeofperformance")
    return rows.select("id", canonical.address(F.col("r"), place).alias("notice_place"), canonical.address(F.col("r"), place, keep_usa=True).alias("award_place"))


@register("nrm11_notice_context", f"WITH {v.NOTICES_SQL}\nSELECT id, agency_name AS sam_agency_path_name, upper(agency_name) AS sam_agency_path_code, 'Office 1' AS sam_office_name, 'O1' AS sam_office_code, lower(psc) AS sam_notice_type, solicitation_number AS sam_solicitation_number, 'R499' AS sam_classification_code, upper(regexp_replace(naics, '[^A-Za-z0-9]', '', 'g')) AS sam_naics_code, 'what it is' AS sam_naics_description, 'SBA' AS sam_set_aside_code, 'Small Business' AS sam_set_aside_description, CASE WHEN id % 2 = 0 THEN strftime(occurred_at, '%Y-%m-%dT00:00:00') ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S+00:00') END AS sam_posted_date, CASE WHEN id % 3 = 0 THEN 'soon' END AS sam_response_deadline, CASE WHEN id % 3 = 0 THEN 'VA' END AS sam_place_state_code, CASE WHEN id % 5 = 0 THEN 'USA' ELSE 'DEU' END AS sam_place_country_code, CASE WHEN id % 4 = 0 THEN TRUE WHEN id % 4 = 1 THEN FALSE END AS sam_active FROM notices")
def nrm11(spark, sf_dir):
    rows = canonical.context_fields(_notice_records(spark, sf_dir))
    absent = ("sam_organization_type", "sam_notice_type_code", "sam_archive_date")
    return rows.select("id", *[c for c in canonical.CONTEXT_FIELDS if c not in absent])


@register("nrm12_filled_raw", awards_sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'own' ELSE recipient_name END AS name, recipient_uei AS uei, 'kept' AS other FROM awards"))
def nrm12(spark, sf_dir):
    raw = F.to_json(F.struct(F.when(F.col("id") % 2 == 0, "own").otherwise(" n/a ").alias("recipient_name"), F.lit("kept").alias("other")))
    rows = v.award_events(spark, sf_dir).withColumn("raw_json", raw)
    out = rows.select("id", merge.filled_raw("raw_json", {"recipient_name": F.col("recipient_name"), "recipient_uei": F.col("recipient_uei")}).alias("j"))
    get = lambda n: F.get_json_object("j", f"$.{n}")
    return out.select("id", get("recipient_name").alias("name"), get("recipient_uei").alias("uei"), get("other").alias("other"))


@register("nrm17_contract_families", "SELECT c_custkey, token, CASE WHEN length(token) >= 8 AND length(root) >= 6 THEN root END AS family FROM (SELECT c_custkey, token, CASE c_custkey % 4 WHEN 0 THEN left(token, length(token) - 5) WHEN 1 THEN left(token, length(token) - 3) ELSE '' END AS root FROM (SELECT c_custkey, 'W91' || CAST(c_custkey AS VARCHAR) || 'D' || CASE c_custkey % 4 WHEN 0 THEN 'MOD12' WHEN 1 THEN 'P07' WHEN 2 THEN 'M12345' ELSE '' END AS token FROM customer) t) r")
def nrm17(spark, sf_dir):
    i = F.col("c_custkey")
    spelled = F.concat(F.lit("w91-"), i.cast("string"), F.lit("/d "), F.when(i % 4 == 0, "mod12").when(i % 4 == 1, "P-07").when(i % 4 == 2, "M12345").otherwise("."))
    rows = v.table(spark, sf_dir, "customer").select("c_custkey", nz.identifier_token(spelled).alias("token"))
    return rows.withColumn("family", nz.contract_family(F.col("token")))


@register("nrm19_keywords", "SELECT k AS keyword, split_part(k, ':', 1) AS pack, regexp_matches(split_part(k, ':', 1), 'noise|suppress') OR k = '' AS noise, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) || ':' || lower(p_type) WHEN 1 THEN 'my_noise_terms:a/b' ELSE '' END AS k FROM part) p GROUP BY ALL")
def nrm19(spark, sf_dir):
    i = F.col("p_partkey") % 3
    raw = F.when(i == 0, F.concat(F.lit(" "), "p_brand", F.lit(":"), "p_type")).when(i == 1, "My_Noise_Terms:A|B ").otherwise("  ")
    rows = v.table(spark, sf_dir, "part").select(nz.keyword(raw).alias("keyword"), nz.keyword_pack(raw).alias("pack"), nz.is_noise_keyword(raw).alias("noise"))
    return rows.groupBy("keyword", "pack", "noise").agg(F.count("*").alias("n"))


@register("tag4_taggable_fields", awards_sql("SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN recipient_name END, '') AS snippet, '' AS place_text, award_id AS doc_id, '' AS source_url, CASE WHEN id % 2 = 0 THEN '{\"a\":\"' || award_id || '\"}' ELSE '{}' END AS raw_json FROM awards"))
def tag4(spark, sf_dir):
    rows = v.award_events(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("recipient_name")).alias("snippet"), F.col("award_id").cast("bigint").alias("doc_id"), F.struct(F.when(F.col("id") % 2 == 0, F.col("award_id")).alias("a")).alias("raw_json"))
    return tagging.taggable_fields(rows)


# Raw records with unsorted keys, up to 99 items, eight levels and up to 2499 characters.
_RAW_SQL = """SELECT id, '{"a":' || CASE WHEN k > 64 THEN '[' || array_to_string(list_transform(range(0, 32), lambda x: CAST(x AS VARCHAR)), ',') || ',"__truncated_items__:' || CAST(k - 64 AS VARCHAR) || '",' || array_to_string(list_transform(range(k - 32, k), lambda x: CAST(x AS VARCHAR)), ',') || ']' ELSE '[' || array_to_string(list_transform(range(0, k), lambda x: CAST(x AS VARCHAR)), ',') || ']' END
  || ',"b":' || id || ',"deep":{"k1":{"k2":{"k3":{"k4":{"k5":"__depth_truncated__"}}}}},"note":"'
  || CASE WHEN n > 2048 THEN substr(t, 1, (2048 - length(m)) // 2) || m || right(t, 2048 - length(m) - (2048 - length(m)) // 2) ELSE t END || '","z":{"A":"é","b":null,"c":true}}' AS raw_json
FROM (SELECT id, id % 100 AS k, n, '...<truncated:' || CAST(n - 2048 AS VARCHAR) || 'chars>...' AS m, substr(repeat('0123456789', 250), 1, CAST(n AS INT)) AS t FROM (SELECT id, id * 7 % 2500 AS n FROM awards) a) b"""


@register("tag4_bounded_json", awards_sql(_RAW_SQL))
def tag4_bounded(spark, sf_dir):
    n, k = F.col("id") * 7 % 2500, F.col("id") % 100
    items = F.array_join(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<bigint>")), ",")
    note = F.substring(F.repeat(F.lit("0123456789"), F.lit(250)), F.lit(1), n.cast("int"))
    raw = F.concat(F.lit('{"z": {"c": true, "b": null, "A": "é"}, "note": "'), note, F.lit('", "b": '), F.col("id").cast("string"), F.lit(', "deep": {"k1": {"k2": {"k3": {"k4": {"k5": {"k6": {"k7": 1}}}}}}}, "a": ['), items, F.lit("]}"))
    rows = v.award_events(spark, sf_dir).select("id", raw.alias("raw_json"))
    return tagging.taggable_fields(rows).select("id", "raw_json")


# ---- exports -------------------------------------------------------------------------------------


@register("snk1_event_export", awards_sql("SELECT id, recipient_name, CAST(amount AS DOUBLE) AS amount, '[\"' || k1 || '\",\"' || k2 || '\",\"' || k3 || '\",\"' || k4 || '\"]' AS keywords FROM awards WHERE country = 'ASIA' OR state = 'ASIA'"))
def snk1(spark, sf_dir):
    """What both files of the export say: amounts from JSON, the rest from CSV."""
    path = _folder(spark, "events")
    exports.export_events(v.award_events(spark, sf_dir), path, region="asia", sort_by="id")
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv").select(F.col("id").cast("bigint").alias("id"), "recipient_name", "keywords")
    return csv.join(spark.read.schema("id bigint, amount double").json(f"{path}/json"), "id").select("id", "recipient_name", "amount", "keywords")


@register("snk4_pair_export", awards_sql("""p AS (SELECT k1, k2, id FROM awards UNION ALL SELECT k1, k3, id FROM awards UNION ALL SELECT k1, k4, id FROM awards UNION ALL SELECT k2, k3, id FROM awards UNION ALL SELECT k2, k4, id FROM awards UNION ALL SELECT k3, k4, id FROM awards)
SELECT least(k1, k2) AS k1, greatest(k1, k2) AS k2, count(*) AS events, string_agg(CAST(id AS VARCHAR), ';' ORDER BY id) AS members FROM p GROUP BY least(k1, k2), greatest(k1, k2) HAVING count(*) BETWEEN 3 AND 60""").replace(")\np AS", "),\np AS"))
def snk4(spark, sf_dir):
    events, path = v.award_events(spark, sf_dir), _folder(spark, "pairs")
    found = lanes.keyword_pairs(events, max_events=60, ratio=0.0)
    exports.write_both(exports.pair_rows(found, lanes.pair_links(events, found), limit=1_000_000), path)
    rows = spark.read.schema("k1 string, k2 string, c12 bigint, members string").json(f"{path}/json")
    return rows.withColumnRenamed("c12", "events")


@register("snk6_snapshot_export", f"WITH {FAMILY_SQL}, {_LEADS_SQL}, s6 AS (SELECT l1.id AS id, l1.rank AS rank, occurred_at FROM l1 JOIN awards a ON a.id = l1.id WHERE rank <= 200 AND l1.id IN (SELECT id FROM k WHERE family = 'general' AND role IN ('primary', 'secondary')))\nSELECT id, CAST(rank AS BIGINT) AS rank, (SELECT count(*) FROM s6) AS leads, (SELECT CAST(date_diff('day', min(occurred_at), max(occurred_at)) AS BIGINT) FROM s6) AS span_days FROM s6")
def snk6(spark, sf_dir):
    path = _folder(spark, "snapshot")
    exports.export_snapshot(_lead_rank(spark, sf_dir, _base()), path, family_places(spark, sf_dir), "general")
    rows = spark.read.schema("id bigint, rank bigint").json(f"{path}/leads/json")
    return rows.crossJoin(F.broadcast(spark.read.schema("leads bigint, span_days bigint").json(f"{path}/summary")))  # the summary is one row


@register("snk7_comparison_export", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}\nSELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'entered' WHEN n.id IS NULL THEN 'dropped' ELSE 'shared' END AS state, CAST(o.rank AS BIGINT) AS base_rank, CAST(n.rank AS BIGINT) AS target_rank FROM (SELECT * FROM l1 WHERE rank <= 200) o FULL OUTER JOIN (SELECT * FROM l2 WHERE rank <= 200) n ON o.id = n.id")
def snk7(spark, sf_dir):
    path = _folder(spark, "comparison")
    exports.write_both(scoring.compare(_lead_rank(spark, sf_dir, _base()), _lead_rank(spark, sf_dir, _boosted())), path)
    return spark.read.schema("id bigint, state string, base_rank bigint, target_rank bigint").json(f"{path}/json")


_PACKAGES = f"WITH {v.AWARDS_SQL}, {_LINKED.replace('rank <= 200', 'rank <= 10')}\nSELECT lead_id, count(*) AS members, CAST(count(DISTINCT agency_name) AS BIGINT) AS agencies FROM (SELECT lead_id, event_id, agency_name FROM r UNION SELECT a.id, a.id, a.agency_name FROM l1 JOIN awards a ON a.id = l1.id WHERE rank <= 10) x GROUP BY lead_id"


def _top_packages(spark, sf_dir) -> DataFrame:
    events, _, links = _clustered(spark, sf_dir)
    return evidence.lead_packages(_lead_rank(spark, sf_dir, _base()), links, events, max_rank=10)


@register("evd3_top_packages", _PACKAGES)
def evd3(spark, sf_dir):
    return _top_packages(spark, sf_dir).select("lead_id", "members", F.size(F.split("agencies", "; ")).cast("bigint").alias("agencies"))


@register("snk9_package_export", _PACKAGES)
def snk9(spark, sf_dir):
    path = _folder(spark, "packages")
    exports.export_packages(_top_packages(spark, sf_dir), "lead_id", path)
    rows = spark.read.schema("lead_id bigint, members bigint, agencies string").json(path)
    return rows.withColumn("agencies", F.size(F.split("agencies", "; ")).cast("bigint"))


@register("snk10_review_template", f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}\nSELECT 's' AS snapshot_id, CAST(rank AS BIGINT) AS rank, id, recipient_name, 5 AS blanks FROM l1 JOIN awards USING (id) WHERE rank <= 200")
def snk10(spark, sf_dir):
    path = _folder(spark, "template")
    exports.review_template(_lead_rank(spark, sf_dir, _base()), ("recipient_name",)).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).csv(path)
    blanks = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in exports.REVIEWER_COLUMNS), F.lit(0))
    return rows.select("snapshot_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").cast("bigint").alias("id"), "recipient_name", blanks.alias("blanks"))


@register("snk12_dossier_index", f"WITH {v.AWARDS_SQL}, {_LINKED}, d AS (SELECT lead_id, least(8, count(*)) AS n FROM r WHERE occurred_at >= TIMESTAMP '1996-01-01' AND occurred_at <= TIMESTAMP '2000-12-31' GROUP BY lead_id)\nSELECT CAST(rank AS BIGINT) AS rank, id, CAST(coalesce(n, 0) AS BIGINT) AS records, CASE WHEN n > 0 THEN 'same_uei' ELSE '' END AS lanes FROM l1 LEFT JOIN d ON lead_id = id WHERE rank <= 25")
def snk12(spark, sf_dir):
    events, found, links = _clustered(spark, sf_dir)
    leads, path = _lead_rank(spark, sf_dir, _base()), _folder(spark, "dossiers")
    exports.export_dossier_index(leads, evidence.dossiers(leads, links, found, events, "1996-01-01", "2000-12-31"), path, top=25)
    return spark.read.schema("rank bigint, id bigint, records bigint, lanes array<string>").json(f"{path}/json").withColumn("lanes", F.array_join("lanes", ","))
