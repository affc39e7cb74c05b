"""Registered queries of ingest, linking, lead surfaces, health reports and whole runs, with equivalent DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as nz
from ..operators import entities, filters, health, lanes, linking, merge, postings, review, runs, scoring, search, snapshots, store, surfaces, tagging, terms
from ..sources import landed
from ..sources import views as v
from ..storage import new_folder, stored
from ..streaming import landing
from .queries import QUERIES, _LEADS_SQL, _WORDS, PAIRS_SQL, TAG_SQL, _base, _boosted, _lead_rank, awards_sql, register

#: An ontology file (fixed values): one case-bound file, packs that are off, and regexes that aren't valid.
ONTOLOGIES = [
    {"defaults": {"default_weight": 2}, "packs": [{"id": "common", "rules": [{"id": "there", "type": "phrase", "pattern": "There", "fields": ["snippet"]}, {"id": "broken", "type": "regex", "pattern": "([a-z", "weight": 9, "fields": ["snippet"]}, {"id": "with", "type": "regex", "pattern": "\\bwith\\b", "weight": 1, "fields": ["snippet", "raw"]}]}, {"id": "off", "enabled": False, "rules": [{"id": "x", "type": "phrase", "pattern": "a", "weight": 1}]}]},
    {"defaults": {"case_insensitive": False}, "packs": [{"id": "exact", "default_weight": 5, "rules": [{"id": "upper", "type": "phrase", "pattern": "The ", "fields": ["snippet"]}, {"id": "start", "type": "regex", "pattern": "^[A-Z][a-z]+ and", "fields": ["snippet"]}]}, {"id": "unweighted", "rules": [{"id": "y", "type": "phrase", "pattern": "e", "fields": ["snippet"]}]}]},
]


# ---- landed records ------------------------------------------------------------------------------


@register("nrm8_award_rows", awards_sql("SELECT id, sha256(award_id) AS hash, occurred_at, award_id, 'https://www.usaspending.gov/award/G' || award_id AS source_url, recipient_uei, recipient_name, naics, state, country, 'G' || award_id AS source_record_id FROM (SELECT id, award_id, CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) AS occurred_at, recipient_uei, recipient_name, upper(regexp_replace(naics, '[^A-Za-z0-9]', '', 'g')) AS naics, state, country FROM awards)").replace("sha256(award_id)", "sha256('G' || award_id)"))
def nrm8(spark, sf_dir):
    events = v.award_events(spark, sf_dir)
    at = F.when(F.col("id") % 3 == 0, F.date_format("occurred_at", "MM/dd/yyyy")).when(F.col("id") % 3 == 1, F.date_format("occurred_at", "yyyyMMdd")).otherwise(F.date_format("occurred_at", "yyyy-MM-dd"))
    spelled = F.struct(F.concat(F.lit("G"), "award_id").alias("generated_unique_award_id"), F.col("award_id").alias("Award ID"), at.alias("Action Date"), F.concat(F.lit("  "), "recipient_name", F.lit(" ")).alias("Recipient Name"), F.lower("recipient_uei").alias("Recipient UEI"), F.col("naics").alias("naicsCode"), F.col("state").alias("place_of_performance_state"), F.col("country").alias("place_of_performance_country"))
    rows = landed.normalized_awards(events.select(F.to_json(spelled).alias("raw_json")))
    return rows.select(F.col("award_id").cast("bigint").alias("id"), "hash", "occurred_at", "award_id", "source_url", "recipient_uei", "recipient_name", "naics", "state", "country", "source_record_id")


@register("nrm9_notice_rows", f"WITH {v.NOTICES_SQL}\nSELECT sha256('SAM.gov:N' || CAST(id AS VARCHAR)) AS hash, 'N' || CAST(id AS VARCHAR) AS notice_id, solicitation_number, CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) AS occurred_at, 'solicitation' AS notice_type, upper(psc) AS psc, recipient_name, upper(recipient_uei) AS recipient_uei, agency_name FROM notices WHERE id % 10 = 1")
def nrm9(spark, sf_dir):
    events = v.notice_events(spark, sf_dir).where("id % 10 = 1")
    awardee = F.struct(F.struct(F.col("recipient_name").alias("name"), F.lower("recipient_uei").alias("ueiSAM")).alias("awardee"))
    record = F.struct(F.concat(F.lit("N"), F.col("id").cast("string")).alias("noticeId"), F.col("solicitation_number").alias("solicitationNumber"), F.date_format("occurred_at", "yyyy-MM-dd").alias("postedDate"), F.lit("Solicitation").alias("noticeType"), F.col("psc").alias("classificationCode"), F.col("agency_name").alias("fullParentPathName"), awardee.alias("award"))
    rows = landed.normalized_notices(events.select(F.to_json(record).alias("raw_json")))
    return rows.select("hash", "notice_id", "solicitation_number", "occurred_at", "notice_type", "psc", "recipient_name", "recipient_uei", "agency_name")


@register("nrm1_clean_text", "SELECT doc_id, CASE WHEN lower(t) NOT IN ('', 'null', 'none', 'n/a', 'nan') THEN t END AS text FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 10 = 0 THEN ' N/A ' ELSE text END, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS t FROM documents) x")
def nrm1(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", nz.clean_text(F.when(F.col("doc_id") % 10 == 0, " N/A ").otherwise(F.col("text"))).alias("text"))


@register("nrm13_bounded_text", "SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, h) || note || right(t, 400 - length(note) - h) END AS text FROM (SELECT doc_id, t, note, CAST(floor((400 - length(note)) / 2e0) AS INT) AS h FROM (SELECT doc_id, text AS t, '...<truncated_json:' || CAST(length(text) - 400 AS VARCHAR) || 'chars>...' AS note FROM documents WHERE text IS NOT NULL) a) b")
def nrm13(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", nz.bounded_text(F.col("text"), 400).alias("text"))


@register("nrm15_agency_label", awards_sql("SELECT id, CASE WHEN id % 3 = 0 THEN agency_name || ' (' || psc || ')' WHEN id % 3 = 1 THEN agency_name ELSE psc END AS label FROM awards"))
def nrm15(spark, sf_dir):
    rule = F.col("id") % 3
    return v.award_events(spark, sf_dir).select("id", nz.agency_label(F.when(rule != 2, F.col("agency_name")), F.when(rule != 1, F.col("psc"))).alias("label"))


# ---- ingest --------------------------------------------------------------------------------------


@register("ing2_backfill", "SELECT c_custkey AS hash, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE 'kept' END AS agency_name, c_mktsegment AS naics FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ing2(spark, sf_dir):
    customer, nation = v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "nation")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    old = rows.select(F.col("c_custkey").alias("hash"), F.when(F.col("c_custkey") % 6 == 0, " n/a ").when(F.col("c_custkey") % 3 != 0, "kept").alias("agency_name"), F.col("c_mktsegment").alias("naics"))
    new = rows.select(F.col("c_custkey").alias("hash"), F.col("n_name").alias("agency_name"), F.lit("never").alias("naics"))
    return merge.backfilled(old, new, ("agency_name", "naics"))


@register("ing3_run_ledger", "SELECT count(*) AS fetched, count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS normalized, count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') THEN o_custkey END) AS inserted, 'success' AS status FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def ing3(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash"), "o_orderdate", "o_orderkey")
    fetched = orders.where("o_orderdate >= timestamp '2000-01-01'")
    return merge.run_ledger(orders.where("o_orderdate < timestamp '2000-01-01'"), fetched, fetched.where("o_orderkey % 5 != 0"))


@register("ing5_filtered_ingest", awards_sql("SELECT id, 10 * CAST(entity_id % 2 = 0 AS INT) + 3 * CASE WHEN naics = 'BUILDING' THEN 4 ELSE 1 END AS score FROM awards WHERE occurred_at >= TIMESTAMP '2000-01-01' AND 10 * CAST(entity_id % 2 = 0 AS INT) + 3 * CASE WHEN naics = 'BUILDING' THEN 4 ELSE 1 END >= 12"))
def ing5(spark, sf_dir):
    events = v.award_events(spark, sf_dir).withColumn("hash", F.col("award_id"))
    late = events.where("occurred_at >= timestamp '1999-01-01'").withColumns({"entity_id": F.when(F.col("entity_id") % 2 == 0, F.col("entity_id")), "keywords": F.when(F.col("naics") == "BUILDING", F.col("keywords")).otherwise(F.slice("keywords", 1, 1))})
    return merge.filtered_ingest(events.where("occurred_at < timestamp '2000-01-01'"), late, 12).select("id", "score")


# Orders as landed records in two waves. The first has blanks and no late half of 1998; the second repeats some of its records in the same words, fills
# blanks (never what is there), brings late records, and some without a key.
_WAVES_SQL = """w AS (
  SELECT 1 AS wave, o_custkey AS n, CAST(o_orderkey AS VARCHAR) AS hash, CASE WHEN o_orderkey % 3 = 0 THEN ' n/a ' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS psc, o_orderstatus AS state FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 10 <> 7
  UNION ALL SELECT 2, o_custkey, CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 < 2 THEN 'late' END, 'never' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey % 10 = 7 OR o_orderkey % 5 = 0
)"""
_MERGED_SQL = "m AS (SELECT hash, min_by(n, wave) AS n, CASE WHEN lower(trim(coalesce(min_by(coalesce(psc, ''), wave), ''))) NOT IN ('', 'n/a') THEN min_by(coalesce(psc, ''), wave) WHEN count(*) = 2 AND max_by(coalesce(psc, ''), wave) <> '' THEN max_by(coalesce(psc, ''), wave) ELSE nullif(min_by(coalesce(psc, ''), wave), '') END AS psc, min_by(state, wave) AS state FROM w GROUP BY hash)"
_WAVE_SCHEMA = "n bigint, hash string, psc string, state string"


def _waves(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders")
    key, early = F.col("o_orderkey"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    blank = F.when(key % 3 == 0, " n/a ").when(key % 3 == 1, F.col("o_orderpriority"))
    row = lambda psc, state: (F.col("o_custkey").cast("bigint").alias("n"), key.cast("string").alias("hash"), psc.alias("psc"), state.alias("state"))
    first = orders.where(early & (key % 10 != 7)).select(*row(blank, F.col("o_orderstatus")))
    second = orders.where(~early | (key % 10 == 7) | (key % 5 == 0)).select(*row(F.when(key % 4 < 2, "late"), F.lit("never")))
    again = orders.where(early & (key % 10 == 3)).select(*row(blank, F.col("o_orderstatus")))
    keyless = orders.where(key % 50 == 0).select(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("hash"), F.lit("x").alias("psc"), F.lit("x").alias("state"))
    return first, second.unionByName(again).unionByName(keyless)


def _store(spark, columns=("psc",)):
    return store.EventStore(spark, new_folder(spark, "events"), T.StructType.fromDDL(_WAVE_SCHEMA), columns=columns, buckets=16)


@register("ing2_bucketed_store", f"WITH {_WAVES_SQL}, {_MERGED_SQL}\nSELECT hash, n, psc, state FROM m")
def ing2_store(spark, sf_dir):
    first, second = _waves(spark, sf_dir)
    table = _store(spark)
    table.merge(first, batch=0)
    table.merge(second, batch=1)
    table.merge(second, batch=2)  # changes nothing
    return table.rows()


@register("ing3_observed_ledger", f"""WITH {_WAVES_SQL}, o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders), {_MERGED_SQL},
f AS (SELECT count(*) AS n FROM w JOIN m ON w.hash = m.hash WHERE wave = 2 AND coalesce(w.psc, '') <> '' AND EXISTS (SELECT 1 FROM w x WHERE x.hash = w.hash AND x.wave = 1 AND lower(trim(coalesce(x.psc, ''))) IN ('', 'n/a'))),
second AS (SELECT (SELECT count(*) FROM w WHERE wave = 2) + (SELECT count(*) FROM o WHERE d < TIMESTAMP '1998-01-01' AND k % 10 = 3) AS n)
SELECT 0 AS batch, (SELECT count(*) FROM w WHERE wave = 1) AS fetched, (SELECT count(*) FROM w WHERE wave = 1) AS normalized, (SELECT count(*) FROM w WHERE wave = 1) AS inserted, 0 AS backfilled, 'success' AS status
UNION ALL SELECT 1, n + (SELECT count(*) FROM o WHERE k % 50 = 0), n, (SELECT count(*) FROM m) - (SELECT count(*) FROM w WHERE wave = 1), (SELECT n FROM f), 'success' FROM second
UNION ALL SELECT 2, (SELECT count(*) FROM o WHERE k % 50 = 0), 0, 0, 0, 'failed'""")
def ing3_observed(spark, sf_dir):
    first, second = _waves(spark, sf_dir)
    table = _store(spark)
    table.merge(first, batch=0)
    table.merge(second, batch=1, order=("state",))
    table.merge(second.where("hash IS NULL"), batch=2)
    table.merge(first, batch=0)  # merged already: no row
    return table.ledger()


@register("str1_landed_merge", f"WITH {_WAVES_SQL}, {_MERGED_SQL}\nSELECT hash, n, psc, state FROM m")
def str1_landed(spark, sf_dir):
    first, second = _waves(spark, sf_dir)
    table, folder = _store(spark), new_folder(spark, "landing")
    for wave, rows in enumerate((first, second)):  # the stream ends in between and goes on from its checkpoint
        rows.write.json(f"{folder}/pages/wave={wave}")
        landing.land(landing.pages(spark, f"{folder}/pages", _WAVE_SCHEMA, files=4), table, f"{folder}/checkpoint", order=("state",)).awaitTermination()
    return table.rows()


# ---- tags ----------------------------------------------------------------------------------------


@register("src5_rule_file_tags", "WITH c AS (SELECT doc_id, 'common:there' AS k, 2 AS w FROM documents WHERE lower(text) LIKE '%there%' UNION ALL SELECT doc_id, 'common:with', 1 FROM documents WHERE regexp_matches(text, '(?i)\\bwith\\b') UNION ALL SELECT doc_id, 'exact:upper', 5 FROM documents WHERE text LIKE '%The %' UNION ALL SELECT doc_id, 'exact:start', 5 FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]+ and')) SELECT d.doc_id AS doc_id, coalesce(string_agg(k, ';' ORDER BY k), '') AS keywords, CAST(coalesce(sum(w), 0) AS BIGINT) AS tag_score FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def src5(spark, sf_dir):
    texts = spark.createDataFrame([(json.dumps(x),) for x in ONTOLOGIES], "ontology string")
    rules = landed.flat_rules(landed.parsed_ontologies(texts, "ontology"))
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("snippet"))
    return tagging.tag(docs, rules).select(F.col("id").alias("doc_id"), F.array_join("keywords", ";").alias("keywords"), F.col("tag_score").cast("bigint").alias("tag_score"))


PACKS = {"words": ["the", "License", "with"], "signs": ["@mail", " | "], "none": ["zzzzqqq"]}


@register("tag3_pack_terms", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old:tag' ELSE concat_ws(';', CASE WHEN contains(t, ' | ') THEN 'signs: | ' END, CASE WHEN contains(t, '@mail') THEN 'signs:@mail' END, CASE WHEN contains(t, 'license') THEN 'words:License' END, CASE WHEN contains(t, 'the') THEN 'words:the' END, CASE WHEN contains(t, 'with') THEN 'words:with' END) END AS keywords FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) d")
def tag3(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").withColumn("keywords", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("old:tag"))).when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>")))
    return tagging.pack_terms(docs, F.col("text"), PACKS).select("doc_id", F.array_join("keywords", ";").alias("keywords"))


@register("hnt3_hunt_union", f"WITH {v.AWARDS_SQL}, {v.NOTICES_SQL}\nSELECT source, count(*) AS n, count(DISTINCT key) AS keys, round(sum(amount), 2) AS amount, max(\"at\") AS last_at, max(title) AS last_title FROM (SELECT 'awards' AS source, award_id AS key, recipient_name AS title, CAST(amount AS DOUBLE) AS amount, CAST(occurred_at AS TIMESTAMP) AS \"at\" FROM awards UNION ALL SELECT 'notices', CAST(id AS VARCHAR), psc || ' ' || naics, NULL, CAST(occurred_at AS TIMESTAMP) FROM notices UNION ALL SELECT 'texts', CAST(doc_id AS VARCHAR), substr(text, 1, 40), NULL, NULL FROM documents) u GROUP BY source")
def hnt3(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    awards, notices = v.award_events(spark, sf_dir), v.notice_events(spark, sf_dir)
    rows = tagging.hunt_rows("awards", awards, "award_id", F.col("recipient_name"), F.col("amount"), F.col("occurred_at"))
    rows = rows.unionByName(tagging.hunt_rows("notices", notices, "id", F.concat_ws(" ", "psc", "naics"), at=F.col("occurred_at"))).unionByName(tagging.hunt_rows("texts", docs, "doc_id", F.substring("text", 1, 40)))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.round(F.sum("amount"), 2).alias("amount"), F.max("at").alias("last_at"), F.max("title").alias("last_title"))


@register("hnt5_query_split", "SELECT p_partkey, p_name AS part FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def hnt5(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    query = F.concat(F.lit('"'), "p_name", F.lit('" or '), F.lower("p_type"), F.lit(" , '"), "p_brand", F.lit("',"))
    return part.select("p_partkey", F.explode(tagging.split_query(query)).alias("part"))


# ---- entities ------------------------------------------------------------------------------------

_KNOWN_SQL = "known AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'uei' || c_custkey END AS uei, lower(CASE WHEN c_custkey % 5 = 0 THEN 'Customer#shared' ELSE c_name END) AS name FROM customer WHERE c_custkey % 3 <> 0)"
_LINK_SQL = f"""WITH {v.AWARDS_SQL}, {_KNOWN_SQL},
e AS (SELECT id, lower(CASE WHEN id % 4 <> 0 THEN recipient_uei END) AS uei, lower(CASE WHEN id % 7 = 0 THEN NULL WHEN entity_id % 5 = 0 THEN 'customer#SHARED' ELSE recipient_name END) AS name FROM awards),
u AS (SELECT uei, min(entity_id) AS entity_id FROM known WHERE uei IS NOT NULL GROUP BY uei), n AS (SELECT name, min(entity_id) AS entity_id FROM known GROUP BY name),
l AS (SELECT e.id AS id, coalesce(u.entity_id, n.entity_id) AS entity_id, coalesce('uei:' || e.uei, 'name:' || e.name) AS key FROM e LEFT JOIN u ON e.uei = u.uei LEFT JOIN n ON e.name = n.name)"""


def _linked(spark, sf_dir):
    events = v.award_events(spark, sf_dir)
    changed = events.select("id", F.when(F.col("id") % 4 != 0, F.col("recipient_uei")).alias("recipient_uei"), F.when(F.col("id") % 7 != 0, F.when(F.col("entity_id") % 5 == 0, F.lit("customer#SHARED")).otherwise(F.col("recipient_name"))).alias("recipient_name"))
    customer = v.table(spark, sf_dir, "customer").where("c_custkey % 3 != 0")
    none = [F.lit(None).cast("string").alias(c) for c in ("duns", "cage", "recipient_id", "parent_code")]
    known = customer.select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("UEI"), F.col("c_custkey").cast("string"))).alias("uei"), *none, F.when(F.col("c_custkey") % 5 == 0, F.lit("Customer#shared")).otherwise(F.col("c_name")).alias("name"))
    return entities.identity(changed), known


@register("ent3_match_existing", _LINK_SQL + "\nSELECT id, entity_id FROM l WHERE entity_id IS NOT NULL")
def ent3(spark, sf_dir):
    return entities.match_existing(*_linked(spark, sf_dir))


@register("ent3_absorbed", _LINK_SQL + "\nSELECT k.entity_id AS entity_id, coalesce(k.uei, a.uei) AS uei FROM (SELECT entity_id, upper(uei) AS uei FROM known) k LEFT JOIN (SELECT entity_id, min_by(upper(uei), id) AS uei FROM (SELECT l.entity_id, e.uei, e.id FROM l JOIN e ON l.id = e.id WHERE e.uei IS NOT NULL AND l.entity_id IS NOT NULL) x GROUP BY entity_id) a ON k.entity_id = a.entity_id")
def ent3_absorbed(spark, sf_dir):
    events, known = _linked(spark, sf_dir)
    return entities.absorbed(known, events, entities.match_existing(events, known)).select("entity_id", "uei")


#: Identities that chain: few values of each kind in a nation, so that entities take up what later events bring. Ids of orders, and the same in SQL.
_CHAINED = {
    "uei": ("id % 4 < 2", "'U' || c || n"), "duns": ("id % 5 < 2", "'D' || (c + id % 2) || n"), "cage": ("id % 7 IN (1, 2)", "'C' || CAST(floor(c / 2) AS BIGINT) || n"),
    "rid": ("id % 6 = 0 AND id % 8 <> 3", "'r' || (c % 29) || n"), "code": ("id % 8 = 3", "'P' || (c % 31) || n"), "name": ("id % 3 <> 0", "CASE WHEN id % 2 = 0 THEN 'Name ' ELSE 'NAME ' END || CAST(floor(c / 3) AS BIGINT) || n"), "path": ("id % 8 = 3", "'Office ' || (c % 31) || n"),
}
_CHAIN_SQL = f"""WITH RECURSIVE {v.AWARDS_SQL},
raw AS (SELECT id, agency_name AS grp, {", ".join(f"CASE WHEN {when} THEN {value} END AS {k}" for k, (when, value) in _CHAINED.items())} FROM (SELECT id, agency_name, entity_id AS c, '/' || agency_name AS n FROM awards) a),
e AS (SELECT *, coalesce(nm, 'UEI:' || uei, 'CAGE:' || cage, 'DUNS:' || duns, CASE WHEN code IS NOT NULL THEN 'SAM:' ELSE 'RID:' END || rid) AS display
  FROM (SELECT id, grp, upper(uei) AS uei, upper(duns) AS duns, upper(cage) AS cage, coalesce(rid, upper(code)) AS rid, upper(code) AS code, coalesce(name, path) AS nm FROM raw) x),
i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM e WHERE display IS NOT NULL),
known AS (SELECT n_name AS grp, list({{'who': -1 - n_nationkey, 'uei': 'U1/' || n_name, 'duns': CAST(NULL AS VARCHAR), 'cage': CAST(NULL AS VARCHAR), 'rid': CAST(NULL AS VARCHAR), 'code': CAST(NULL AS VARCHAR), 'name': lower('Name 2/' || n_name)}}) AS ents FROM nation GROUP BY n_name),
steps AS (
  SELECT grp, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS who, ents FROM known
  UNION ALL
  SELECT grp, k, id, coalesce(hit, id) AS who,
    CASE WHEN hit IS NULL THEN list_append(ents, {{'who': id, 'uei': uei, 'duns': duns, 'cage': cage, 'rid': rid, 'code': code, 'name': lower(display)}})
         ELSE list_transform(ents, lambda x: CASE WHEN x.who = hit THEN {{'who': x.who, 'uei': coalesce(x.uei, uei), 'duns': coalesce(x.duns, duns), 'cage': coalesce(x.cage, cage), 'rid': coalesce(x.rid, rid), 'code': coalesce(x.code, code), 'name': x.name}} ELSE x END) END AS ents
  FROM (SELECT s.grp AS grp, i.k AS k, i.id AS id, s.ents AS ents, i.uei AS uei, i.duns AS duns, i.cage AS cage, i.rid AS rid, i.code AS code, i.display AS display,
          coalesce({", ".join(f"list_filter(s.ents, lambda x: x.{c} = {'lower(i.display)' if c == 'name' else 'i.' + c})[1].who" for c in ("uei", "duns", "cage", "rid", "code", "name"))}) AS hit
        FROM steps s JOIN i ON s.grp = i.grp AND i.k = s.k + 1) n),
l AS (SELECT e.id AS id, s.who AS who FROM e LEFT JOIN steps s ON e.id = s.id)"""


def _chained(spark, sf_dir):
    rows = v.award_events(spark, sf_dir).select("id", F.col("entity_id").alias("c"), F.concat(F.lit("/"), "agency_name").alias("n"))
    columns = {"uei": "recipient_uei", "duns": "recipient_duns", "cage": "recipient_cage", "rid": "recipient_id", "code": "parent_path_code", "name": "recipient_name", "path": "parent_path_name"}
    made = [F.expr(f"CASE WHEN {when} THEN {value} END").alias(columns[k]) for k, (when, value) in _CHAINED.items()]
    events = entities.identity(rows.select("id", F.when(F.col("id") % 8 == 3, entities.NOTICES).otherwise("AWARDS").alias("source"), *made))
    none = [F.lit(None).cast("string").alias(c) for c in ("duns", "cage", "recipient_id", "parent_code")]
    nation = v.table(spark, sf_dir, "nation")
    known = nation.select((-1 - F.col("n_nationkey")).cast("long").alias("entity_id"), F.concat(F.lit("U1/"), "n_name").alias("uei"), *none, F.concat(F.lit("Name 2/"), "n_name").alias("name"))
    return events, known, lambda df: stored(df, "linking")


@register("ent4_link_counters", _CHAIN_SQL + "\nSELECT count(*) AS scanned, count(who) AS linked, count(*) - count(who) AS skipped_no_name, count(CASE WHEN who = id THEN 1 END) AS created FROM l")
def ent4(spark, sf_dir):
    return linking.counters(linking.linked(*_chained(spark, sf_dir))[0])


@register("ent4_linked_events", _CHAIN_SQL + "\nSELECT id, CASE WHEN who < 0 THEN who END AS entity_id, CASE WHEN who >= 0 THEN who END AS created_by, CASE WHEN who IS NULL THEN 'skipped_no_name' WHEN who = id THEN 'created' ELSE 'linked' END AS status FROM l")
def ent4_links(spark, sf_dir):
    return linking.linked(*_chained(spark, sf_dir))[0]


@register("ent3_entities_after", _CHAIN_SQL + """
SELECT CASE WHEN x.who < 0 THEN x.who ELSE row_number() OVER (ORDER BY x.who) - (SELECT count(*) FROM nation) - 1 END AS entity_id, x.uei AS uei, x.duns AS duns, x.cage AS cage, x.rid AS recipient_id, x.code AS parent_code, lower(x.name) AS name
FROM (SELECT unnest(ents) AS x FROM (SELECT ents, row_number() OVER (PARTITION BY grp ORDER BY k DESC) AS r FROM steps) t WHERE r = 1) u""")
def ent3_after(spark, sf_dir):
    events, known, write = _chained(spark, sf_dir)
    after, _ = linking.entity_table(*linking.linked(events, known, write), known, events, write)
    return after.withColumn("name", F.lower("name"))


@register("ent5_entity_by_term", "SELECT c_custkey AS id, min(t.n_nationkey) AS entity_id FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN (SELECT n_nationkey, lower(n_name) AS term FROM nation UNION ALL SELECT n_nationkey, right(lower(n_name), 2) FROM nation) t ON contains(lower(c_name || ' of ' || n.n_name), t.term) GROUP BY c_custkey")
def ent5(spark, sf_dir):
    customer, nation = v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "nation")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" of "), "n_name").alias("text"))
    wanted = nation.select(F.col("n_nationkey").alias("entity_id"), F.explode(F.array("n_name", F.right("n_name", F.lit(2)))).alias("term"))
    return entities.by_term(rows, F.col("text"), wanted)


@register("ent5_many_terms", "SELECT p_partkey AS id, array_to_string(list_sort(list(DISTINCT k)), ';') AS keywords FROM (SELECT p_partkey, p_name FROM part) p JOIN (SELECT 'pair:' || p_name[4:9] AS k, lower(p_name[4:9]) AS t FROM part) t ON contains(lower(p_name), t.t) GROUP BY p_partkey")
def ent5_many(spark, sf_dir):
    """Thousands of terms at once: every part's name is searched for a piece of every part's name."""
    part = v.table(spark, sf_dir, "part")
    pieces = part.select(F.substring("p_name", 4, 6).alias("term")).groupBy("term").agg(F.min(F.xxhash64("term")).alias("value"))
    rows = part.select(F.col("p_partkey").alias("id"), F.explode(terms.contained(F.col("p_name"), pieces)).alias("value")).join(pieces, "value")
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("pair:"), "term"))), ";").alias("keywords"))


@register("jn11_lookup", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def jn11(spark, sf_dir):
    wanted = v.table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey").join(wanted, "id", "left_semi")


# ---- filters -------------------------------------------------------------------------------------


@register("flt4_event_filters", awards_sql("SELECT id FROM awards WHERE piid = 'C7' AND lower(notice_type) = '1-urgent' AND source <> 'NOTICES' AND entity_id IS NOT NULL UNION ALL SELECT id FROM awards WHERE id % 10 = 3 AND recipient_uei = 'UEI8'"))
def flt4(spark, sf_dir):
    events = v.award_events(spark, sf_dir)
    first = filters.query_events(events, contract_id="C7", notice_type="1-Urgent", exclude_source="NOTICES", has_entity=True)
    second = filters.query_events(events.where("id % 10 = 3").withColumn("document_id", F.col("recipient_uei")), document_id="UEI8")
    return first.select("id").union(second.select("id"))


@register("flt8_legacy_events", awards_sql("SELECT id FROM awards WHERE source = 'AWARDS' AND occurred_at >= TIMESTAMP '1997-01-01' AND occurred_at <= TIMESTAMP '1999-06-30' AND lower(recipient_name) LIKE '%mer#00000000%'"))
def flt8(spark, sf_dir):
    return filters.legacy_events(v.award_events(spark, sf_dir), source="AWARDS", start="1997-01-01", end="1999-06-30", text="MER#00000000", column="recipient_name").select("id")


@register("flt10_clamped_window", awards_sql("SELECT id FROM awards WHERE occurred_at >= TIMESTAMP '1998-05-01' AND occurred_at <= TIMESTAMP '1998-12-31'"))
def flt10(spark, sf_dir):
    start, end = filters.clamped_window(filters.posted_window(posted_from="1998-05-01", posted_to="1999-03-01"), "1997-01-01", "1998-12-31")
    return filters.query_events(v.award_events(spark, sf_dir), start=start, end=end).select("id")


# ---- leads ---------------------------------------------------------------------------------------

_DOD = "SELECT id, country, c, 3 - CAST(k1 = 'seg:building' AS INT) - CAST(k3 = 'status:o' AS INT) AS lanes, 4 - CAST(k1 = 'seg:building' AS INT) - CAST(k3 = 'status:o' AS INT) AS hits, CAST(country = 'ASIA' AS INT) AS pairs, naics = 'MACHINERY' AS noise FROM (SELECT *, 1 AS c FROM awards)"


@register("scr10_dod_metrics", awards_sql(f"SELECT id, lanes, hits, CASE WHEN noise THEN least(1, b) ELSE b END AS bonus, CASE WHEN lanes >= 3 AND hits >= 4 AND pairs >= 1 THEN 'high' WHEN lanes >= 2 AND hits >= 2 OR lanes >= 1 AND hits >= 2 AND pairs >= 1 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT *, CASE WHEN lanes > 0 THEN least(3, least(lanes, 2) + CASE WHEN pairs > 0 THEN 1 ELSE 0 END) ELSE 0 END AS b FROM ({_DOD}) d) x"))
def scr10(spark, sf_dir):
    named = lambda k: F.when(k.isin("seg:building", "status:o"), k).otherwise(F.concat(F.lit("sam_dod_"), F.replace(k, F.lit("nation:"), F.lit("prio:"))))
    rows = v.award_events(spark, sf_dir).withColumn("keywords", F.transform("keywords", named))
    packs, hits = surfaces.dod_metrics(F.col("keywords"))
    pairs, noise = F.when(F.col("country") == "ASIA", 1).otherwise(0), F.col("naics") == "MACHINERY"
    return rows.select("id", packs.alias("lanes"), hits.alias("hits"), surfaces.matrix_bonus(packs, pairs, noise).alias("bonus"), surfaces.potential_tier(packs, hits, pairs).alias("tier"))


@register("led4_pair_metadata", PAIRS_SQL.replace("SELECT k1, k2, c1, c2, c12, round(", "SELECT k1 || ' + ' || k2 AS pair_label_raw, replace(replace(k1, '_', ' '), ':', ': ') || ' + ' || replace(replace(k2, '_', ' '), ':', ': ') AS pair_label, c12 AS event_count, round_even(1 / sqrt(c12), 6) AS contribution, round(").split(", round(ln")[0] + " FROM m")
def led4(spark, sf_dir):
    pairs = lanes.keyword_pairs(v.award_events(spark, sf_dir), max_events=None)
    return surfaces.pair_metadata(pairs).select("pair_label_raw", "pair_label", "event_count", "contribution")


@register("led7_event_context", awards_sql("SELECT id, source, award_id, piid, recipient_uei, entity_id, agency_name, psc, naics, state || ', ' || country AS place_region, CAST(NULL AS VARCHAR) AS notice_id FROM awards"))
def led7(spark, sf_dir):
    rows = surfaces.event_context(v.award_events(spark, sf_dir))
    return rows.select("id", *[f"context.{c}" for c in ("source", "award_id", "piid", "recipient_uei", "entity_id", "agency_name", "psc", "naics", "place_region", "notice_id")])


_RANKED = f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}, top AS (SELECT l1.id AS id, l1.score AS score, l1.rank AS rank, a.occurred_at, a.piid, a.source, a.psc AS lead_family, a.country AS country FROM l1 JOIN awards a ON a.id = l1.id WHERE rank <= 200), sizes AS (SELECT piid, count(*) AS n FROM awards GROUP BY piid)\n"


def _leads(spark, sf_dir):
    return _lead_rank(spark, sf_dir, _base()).withColumn("lead_family", F.col("psc"))


@register("qry2_lead_page", _RANKED + "SELECT id, score, occurred_at FROM top JOIN sizes ON sizes.piid = top.piid WHERE n BETWEEN 3 AND 200 AND country <> 'ASIA' ORDER BY occurred_at ASC, score DESC, id DESC LIMIT 20 OFFSET 5")
def qry2(spark, sf_dir):
    events, leads = v.award_events(spark, sf_dir), _leads(spark, sf_dir)
    found = lanes.same_field(events, ("same_contract_id",))
    members = lanes.links(events, found, ("same_contract_id",)).join(found, "correlation_key").select(F.col("event_id").alias("id"), "lane", "event_count", F.col("score").alias("signal"))
    return surfaces.query_leads(leads, condition=F.col("country") != "ASIA", members=members, lane="Same_Contract_Id", min_events=3, sort_by="occurred_at", descending=False, limit=20, offset=5).select("id", "score", "occurred_at")


@register("qry2_family_groups", _RANKED + "SELECT lead_family, count(*) AS leads, max(score) AS best_score, min(rank) AS best_rank FROM top GROUP BY lead_family")
def qry2_groups(spark, sf_dir):
    return surfaces.family_groups(_leads(spark, sf_dir)).select("lead_family", "leads", "best_score", F.col("best_rank").cast("bigint").alias("best_rank"))


@register("flt6_correlated_leads", _RANKED + "SELECT id FROM top JOIN sizes ON sizes.piid = top.piid WHERE n BETWEEN 2 AND 200 AND n >= 8")
def flt6(spark, sf_dir):
    events = v.award_events(spark, sf_dir)
    found = lanes.same_field(events, ("same_contract_id", "same_psc"))
    members = lanes.links(events, found, ("same_contract_id", "same_psc")).join(found, "correlation_key").select(F.col("event_id").alias("id"), "lane", "event_count", F.col("score").alias("signal"))
    return surfaces.with_correlation(_leads(spark, sf_dir), members, "same_contract_id", 2, 8.0).select("id")


@register("snp1_snapshot", _RANKED + "SELECT 's' AS snapshot_id, id, rank, score FROM top")
def snp1(spark, sf_dir):
    return _leads(spark, sf_dir).select("snapshot_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


_FROZEN_SQL = """s AS (SELECT id, occurred_at, floor(CAST(amount AS DOUBLE) / 1000e0) AS base, floor(CAST(amount AS DOUBLE) / 1000e0) + CASE WHEN naics = 'BUILDING' THEN 25 ELSE 0 END AS boosted FROM awards),
a AS (SELECT id, base AS score, row_number() OVER (ORDER BY base DESC, occurred_at DESC, id DESC) AS rank FROM s WHERE id % 50 <> 0),
b AS (SELECT id, boosted AS score, row_number() OVER (ORDER BY boosted DESC, occurred_at DESC, id DESC) AS rank FROM s WHERE id % 50 <> 1)"""


def _frozen(spark, sf_dir):
    """Two whole rankings, each kept as a snapshot; the first one twice."""
    events = v.award_events(spark, sf_dir)
    base = F.floor(F.col("amount").cast("double") / 1000)
    table = snapshots.Snapshots(spark, new_folder(spark, "snapshots"))
    for _ in range(2):
        table.freeze(events.where("id % 50 != 0").withColumn("score", base), "a")
    table.freeze(events.where("id % 50 != 1").withColumn("score", base + F.when(F.col("naics") == "BUILDING", 25).otherwise(0)), "b")
    return table


@register("snp1_stored_rankings", f"WITH {v.AWARDS_SQL}, {_FROZEN_SQL}\nSELECT 'a' AS snapshot_id, id, rank, score FROM a UNION ALL SELECT 'b', id, rank, score FROM b")
def snp1_stored(spark, sf_dir):
    return _frozen(spark, sf_dir).items("a", "b").select("snapshot_id", "id", "rank", "score")


@register("dlt1_stored_delta", f"WITH {v.AWARDS_SQL}, {_FROZEN_SQL}\nSELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed' WHEN a.rank <> b.rank OR a.score <> b.score THEN 'changed' ELSE 'same' END AS change_type, b.rank - a.rank AS rank_delta, b.score - a.score AS score_delta FROM a FULL OUTER JOIN b ON a.id = b.id")
def dlt1_stored(spark, sf_dir):
    return _frozen(spark, sf_dir).delta("a", "b").select("id", "change_type", "rank_delta", "score_delta")


@register("jn8_rankings_outer", f"WITH {v.AWARDS_SQL}, {_FROZEN_SQL}\nSELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'entered' WHEN b.id IS NULL THEN 'dropped' ELSE 'shared' END AS state, a.rank - b.rank AS rank_delta FROM a FULL OUTER JOIN b ON a.id = b.id")
def jn8(spark, sf_dir):
    return _frozen(spark, sf_dir).compare("a", "b").select("id", "state", "rank_delta")


@register("src11_snapshot_events", _RANKED + "SELECT rank, top.id AS id, recipient_name FROM top JOIN awards ON awards.id = top.id ORDER BY rank")
def src11(spark, sf_dir):
    items = _leads(spark, sf_dir).select("snapshot_id", "id", F.col("rank").cast("bigint").alias("rank"))
    return surfaces.snapshot_events(items, v.award_events(spark, sf_dir).select("id", "recipient_name"), "s").select("rank", "id", "recipient_name")


@register("qry6_entities", "SELECT c_custkey AS entity_id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 100")
def qry6(spark, sf_dir):
    return surfaces.entity_list(v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")))


_RUNS_SQL = "r AS (SELECT event_type AS kind, event_id AS run_id, CASE WHEN value >= 5 THEN 'success' ELSE 'failed' END AS status FROM events)"


def _runs(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("run_id"), F.when(F.col("value") >= 5, "success").otherwise("failed").alias("status"))


@register("qry6_runs", f"WITH {_RUNS_SQL} SELECT kind, run_id, status FROM r WHERE kind = 'click' ORDER BY run_id DESC LIMIT 50")
def qry6_runs(spark, sf_dir):
    return surfaces.run_list(_runs(spark, sf_dir), "click")


@register("doc6_last_runs", f"WITH {_RUNS_SQL} SELECT kind, max(run_id) AS run_id, max_by(status, run_id) AS status FROM r GROUP BY kind")
def doc6(spark, sf_dir):
    return health.last_runs(_runs(spark, sf_dir))


@register("qry7_snapshots", f"WITH {v.LABELS_SQL} SELECT n_name AS snapshot_id, coalesce(n, 0) AS items FROM (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS n_name FROM nation) s LEFT JOIN (SELECT snapshot, count(*) AS n FROM label_rows GROUP BY snapshot) c ON snapshot = n_name ORDER BY n_name DESC LIMIT 50")
def qry7(spark, sf_dir):
    snapshots = v.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("snapshot_id"))
    return surfaces.snapshot_list(snapshots, v.table(spark, sf_dir, "documents").select(F.col("source").alias("snapshot_id")))


@register("qry8_snapshot_items", _RANKED + "SELECT rank, id, score, lead_family FROM top WHERE lead_family = '2-HIGH' ORDER BY rank LIMIT 30")
def qry8(spark, sf_dir):
    page = surfaces.query_leads(_leads(spark, sf_dir), family="2-HIGH", sort_by="rank", descending=False, limit=30)
    return page.select(F.col("rank").cast("bigint").alias("rank"), "id", "score", "lead_family")


_PARTS_SQL = "SELECT id, CAST(amount / 40000 AS BIGINT) % 3 AS a0, CAST(amount / 30000 AS BIGINT) % 3 AS a1, id % 2 AS n0, id % 3 AS n1, CASE WHEN id % 7 = 0 THEN NULL ELSE psc END AS f0, CASE WHEN id % 5 = 0 THEN naics ELSE psc END AS f1 FROM awards"


@register("cmp2_delta_explanation", awards_sql(f"SELECT id, CASE WHEN t = '' THEN 'No material score-component change.' ELSE t END AS explanation FROM (SELECT id, concat_ws('; ', CASE WHEN a1 <> a0 THEN 'clauses ' || CASE WHEN a1 > a0 THEN '+' ELSE '' END || CAST(a1 - a0 AS VARCHAR) END, CASE WHEN n0 <> n1 THEN 'noise ' || CASE WHEN n0 > n1 THEN '+' ELSE '' END || CAST(n0 - n1 AS VARCHAR) END, CASE WHEN f0 IS DISTINCT FROM f1 THEN 'lead_family ' || coalesce(f0, 'n/a') || ' -> ' || f1 END) AS t FROM ({_PARTS_SQL.replace('CAST(amount / 40000 AS BIGINT)', 'CAST(floor(amount / 40000) AS BIGINT)').replace('CAST(amount / 30000 AS BIGINT)', 'CAST(floor(amount / 30000) AS BIGINT)')}) p) e"))
def cmp2(spark, sf_dir):
    rows = v.award_events(spark, sf_dir)
    part = lambda d, n, f: F.struct((F.floor(F.col("amount") / d) % 3).alias("clause_score"), (F.col("id") % n).alias("noise_penalty"), f.alias("lead_family"))
    old = part(40000, 2, F.when(F.col("id") % 7 != 0, F.col("psc")))
    new = part(30000, 3, F.when(F.col("id") % 5 == 0, F.col("naics")).otherwise(F.col("psc")))
    return rows.select("id", old.alias("b"), new.alias("t")).select("id", surfaces.delta_explanation(F.col("b"), F.col("t"), ("clause_score", "noise_penalty", "lead_family")).alias("explanation"))


_TWO = f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}, o AS (SELECT * FROM l1 WHERE rank <= 200), n AS (SELECT * FROM l2 WHERE rank <= 200)\n"


@register("cmp3_version_overlap", _TWO + "SELECT count(CASE WHEN o.rank <= 10 AND n.rank <= 10 THEN 1 END) AS overlap, count(CASE WHEN n.rank <= 10 AND coalesce(o.rank, 999) > 10 THEN 1 END) AS promoted, count(CASE WHEN o.rank <= 10 AND coalesce(n.rank, 999) > 10 THEN 1 END) AS demoted, count(o.id) AS base_rows, count(n.id) AS target_rows FROM o FULL OUTER JOIN n ON o.id = n.id")
def cmp3(spark, sf_dir):
    return surfaces.version_overlap(_lead_rank(spark, sf_dir, _base()), _lead_rank(spark, sf_dir, _boosted()))


@register("cmp3_version_table", _TWO + "SELECT id, rank_base, rank_target, score_base, score_target, rank_base - rank_target AS rank_delta FROM (SELECT coalesce(x.id, y.id) AS id, x.rank AS rank_base, y.rank AS rank_target, x.score AS score_base, y.score AS score_target FROM (SELECT * FROM o WHERE rank <= 25) x FULL OUTER JOIN (SELECT * FROM n WHERE rank <= 25) y ON x.id = y.id) z ORDER BY least(coalesce(rank_base, 999), coalesce(rank_target, 999)), id LIMIT 25")
def cmp3_table(spark, sf_dir):
    rows = surfaces.version_table(_lead_rank(spark, sf_dir, _base()), _lead_rank(spark, sf_dir, _boosted()))
    return rows.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("rank_base", "rank_target", "score_base", "score_target", "rank_delta")])


# ---- health --------------------------------------------------------------------------------------

_COUNTED = ", ".join(f"('{x}')" for x in health.COUNTED)


@register("doc2_lane_counts", awards_sql(f"SELECT l.lane AS lane, coalesce(n, 0) AS correlations FROM (VALUES {_COUNTED}) AS l(lane) LEFT JOIN (SELECT lane, count(*) AS n FROM (SELECT 'same_contract_id' AS lane, piid AS k, count(*) AS c FROM awards GROUP BY piid UNION ALL SELECT 'same_uei', recipient_uei, count(*) FROM awards GROUP BY recipient_uei) x WHERE c BETWEEN 2 AND 200 GROUP BY lane) y ON y.lane = l.lane"))
def doc2(spark, sf_dir):
    return health.lane_counts(lanes.same_field(v.award_events(spark, sf_dir), ("same_contract_id", "same_uei")), "AWARDS")


@register("doc4_identity_coverage", _LINK_SQL + "\nSELECT count(*) AS events, count(e.uei) AS identity, count(CASE WHEN e.uei IS NOT NULL AND l.entity_id IS NOT NULL THEN 1 END) AS identity_linked, count(e.name) AS named, count(CASE WHEN e.name IS NOT NULL AND l.entity_id IS NOT NULL THEN 1 END) AS named_linked FROM e JOIN l ON e.id = l.id")
def doc4(spark, sf_dir):
    events, known = _linked(spark, sf_dir)
    return health.identity_coverage(events.join(entities.match_existing(events, known), "id", "left")).drop("identity_pct", "named_pct")


@register("doc5_context_depth", awards_sql("SELECT source, round_even(avg(n), 2) AS avg_fields, round_even(100e0 * count(CASE WHEN n >= 3 THEN 1 END) / count(*), 2) AS research_pct FROM (SELECT source, CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) + 2 AS n FROM awards) x GROUP BY source"))
def doc5(spark, sf_dir):
    rows = v.award_events(spark, sf_dir).withColumns({"psc": F.when(F.col("id") % 2 == 0, F.col("psc")), "naics": F.when(F.col("id") % 3 == 0, F.col("naics"))})
    return review.context_depth(rows, ("psc", "naics", "agency_name", "piid"))


@register("doc7_hints", awards_sql("SELECT country, concat_ws(';', CASE WHEN w = 0 THEN 'no_events_in_window' END, 'no_pairs', CASE WHEN w > 0 AND e = 0 THEN 'no_entities' WHEN w > 0 AND 100.0 * e / w < 25 THEN 'few_entities' END, CASE WHEN 100.0 * e / n < 50 THEN 'few_identities_linked' END) AS hints FROM (SELECT country, count(*) AS n, count(CASE WHEN occurred_at >= TIMESTAMP '2001-05-04' AND country <> 'ASIA' THEN 1 END) AS w, count(CASE WHEN entity_id % 5 = 0 AND occurred_at >= TIMESTAMP '2001-05-04' AND country NOT IN ('EUROPE', 'ASIA') THEN 1 END) AS e FROM awards GROUP BY country) x"))
def doc7(spark, sf_dir):
    late = (F.col("occurred_at") >= F.lit("2001-05-04").cast("timestamp")) & (F.col("country") != "ASIA")
    linked = late & (F.col("entity_id") % 5 == 0) & (F.col("country") != "EUROPE")
    count = lambda c, n: F.count_if(c).alias(n)
    rows = v.award_events(spark, sf_dir).groupBy("country").agg(F.count("*").alias("events_total"), count(late, "events_window"), F.count("*").alias("with_keywords"), count(linked, "with_entity"), F.lit(0).alias("kw_pairs"), F.lit(0).alias("over_cap"), F.count("*").alias("scanned"), F.count("*").alias("identity"), count(linked, "identity_linked"), F.lit(1).alias("snapshots"))
    return health.hints(rows).select("country", F.array_join("hints", ";").alias("hints"))


_GAPS = f"WITH {v.AWARDS_SQL}, {_LEADS_SQL}, f AS (SELECT a.id AS id, a.naics = 'BUILDING' AS untagged, a.entity_id % 4 = 0 AS no_entity, l.id IS NULL AS no_lead, a.id % 2 = 0 AS low_context FROM awards a LEFT JOIN (SELECT id FROM l1 WHERE rank <= 200) l ON l.id = a.id)\n"
_GAP = "SELECT '{g}' AS gap, count(CASE WHEN {g} THEN 1 END) AS events, round_even(100e0 * count(CASE WHEN {g} THEN 1 END) / count(*), 1) AS pct, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM f WHERE {g} ORDER BY id LIMIT 20) s) AS sample FROM f"


@register("dia1_gap_report", _GAPS + "\nUNION ALL ".join(_GAP.format(g=g) for g in ("untagged", "no_entity", "no_lead", "low_context")))
def dia1(spark, sf_dir):
    events = v.award_events(spark, sf_dir).withColumns({"keywords": F.when(F.col("naics") != "BUILDING", F.col("keywords")), "entity_id": F.when(F.col("entity_id") % 4 != 0, F.col("entity_id")), "psc": F.when(F.col("id") % 2 != 0, F.col("psc"))})
    flags = health.gap_flags(events, _leads(spark, sf_dir), ("psc", "piid", "state"))
    return health.gap_report(flags).withColumn("sample", F.array_join("sample", ","))


@register("dia2_status", awards_sql("SELECT country, psc, CASE WHEN country = 'AFRICA' THEN 'broken' WHEN country = 'ASIA' THEN CASE WHEN psc = '1-URGENT' THEN 'broken' ELSE 'degraded' END WHEN country = 'EUROPE' THEN CASE WHEN psc = '1-URGENT' THEN 'rate_limited_degraded' WHEN psc = '2-HIGH' THEN 'sparse_valid' WHEN psc = '3-MEDIUM' THEN 'partially_useful' ELSE 'degraded' END WHEN psc = '2-HIGH' THEN 'partially_useful' ELSE 'healthy' END AS status FROM (SELECT DISTINCT country, psc FROM awards) x"))
def dia2(spark, sf_dir):
    psc, country = F.col("psc"), F.col("country")
    rows = v.award_events(spark, sf_dir).groupBy("country", "psc").agg(F.count("*").alias("events_window"))
    quality = F.when((country == "EUROPE") & (psc == "2-HIGH"), "sparse").when(country == "EUROPE", F.lit(None).cast("string")).otherwise("healthy")
    workflow = F.when(country == "ASIA", "failed").when(country == "EUROPE", "warning").when(psc != "2-HIGH", "ok")
    columns = {"store_ok": country != "AFRICA", "bundle_status": F.lit(None).cast("string"), "workflow_status": workflow, "quality": quality, "partially_useful": psc == "3-MEDIUM", "pipeline_failed": psc == "1-URGENT", "advisory_failed": F.lit(False), "retries": F.when((psc == "1-URGENT") & (country == "EUROPE"), 2).otherwise(0), "keyword_pct": F.lit(30.0), "entity_pct": F.lit(90.0)}
    rows = rows.withColumns(columns).withColumn("partially_useful", F.when(country == "EUROPE", F.col("partially_useful")).otherwise(F.lit(False)))
    return health.status(rows).select("country", "psc", "status")


# ---- search, runs --------------------------------------------------------------------------------


@register("qry9_fielded_search", r"""WITH d AS (SELECT p_partkey AS id, 'p_name' AS field, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'p_brand', list_filter(string_split_regex(lower(p_brand), '[^a-z0-9]+'), lambda x: x <> '') FROM part WHERE p_size <= 25),
s AS (SELECT field, count(*) AS docs, avg(len(w)) AS avg_len FROM d GROUP BY field),
q AS (SELECT DISTINCT p_partkey AS qid, unnest(list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM part WHERE p_partkey % 50 = 0),
p AS (SELECT id, field, term, count(*) AS tf, max(n) AS len FROM (SELECT id, field, len(w) AS n, unnest(w) AS term FROM d) t GROUP BY id, field, term),
f AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
r AS (SELECT qid, p.id AS id, p.field AS field, round_even(sum(ln(1 + (docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avg_len))), 4) AS score FROM q JOIN p ON p.term = q.term JOIN f ON f.field = p.field AND f.term = p.term JOIN s ON s.field = p.field GROUP BY qid, p.id, p.field)
SELECT qid, id, place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (SELECT qid, id, max(round_even(score * CASE WHEN field = 'p_name' THEN 2.0e0 ELSE 1.5e0 END, 4)) AS score FROM r GROUP BY qid, id) b) z WHERE place <= 5""")
def qry9_fields(spark, sf_dir):
    part = v.table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_brand").alias("q"))
    found = search.fielded(part, asked, "id", {"p_name": 2.0, "p_brand": 1.5}, "qid", "q", top=5, where=F.col("p_size") <= 25)
    return found.select("qid", "id", F.col("place").cast("bigint").alias("place"))


@register("qry9_indexed_search", QUERIES["qry9_search"][1])
def qry9_indexed(spark, sf_dir):
    documents = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = postings.Postings(spark, new_folder(spark, "index"), ("text",))
    half = documents.agg(F.floor(F.max("id") / 2)).first()[0]
    index.append(documents.where(F.col("id") <= half))
    index.append(documents)  # from the high-water mark
    found = index.search(v.table(spark, sf_dir, "benchmark"), {"text": 1.0}, "item_id", "text")
    return found.select("item_id", F.col("id").alias("doc_id"), F.col("place").cast("bigint").alias("place"))


@register("snk11_appended_documents", awards_sql("SELECT segment, sum(documents) AS documents, max(high) AS high FROM (SELECT CASE WHEN id <= (SELECT max(id) FROM awards) // 3 THEN 0 ELSE 1 END AS segment, 1 AS documents, id AS high FROM awards) s GROUP BY segment"))
def snk11_appended(spark, sf_dir):
    events = v.award_events(spark, sf_dir).select("id", "recipient_name", "agency_name")
    index = postings.Postings(spark, new_folder(spark, "index"), ("recipient_name", "agency_name"))
    third = events.agg(F.floor(F.max("id") / 3)).first()[0]
    index.append(events.where(F.col("id") <= third))
    index.append(events)
    index.append(events)  # nothing above the mark
    return index.marks().select(F.col("segment").cast("bigint").alias("segment"), "documents", "high")


RUN_RULES = [
    {"pack": "priority", "rule": "urgent", "type": "phrase", "pattern": "urgent", "weight": 5},
    {"pack": "sector", "rule": "heavy", "type": "regex", "pattern": "BUILDING|MACHINERY", "weight": 3, "case_insensitive": False},
    {"pack": "sector", "rule": "never", "type": "regex", "pattern": "building", "weight": 7, "case_insensitive": False},
]


def _run(spark, sf_dir, **options):
    events = v.award_events(spark, sf_dir).withColumns({"hash": F.col("award_id"), "snippet": F.concat_ws(" ", "psc", "naics", "agency_name")})
    customer = v.table(spark, sf_dir, "customer").where("c_nationkey < 10")
    none = [F.lit(None).cast("string").alias(c) for c in ("duns", "cage", "recipient_id", "parent_code")]
    known = customer.select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("UEI"), F.col("c_custkey").cast("string")).alias("uei"), *none, F.col("c_name").alias("name"))
    return runs.source_run(events.where("occurred_at < timestamp '1999-01-01'").select("hash"), events.drop("entity_id", "keywords"), RUN_RULES, known, **options)


_RUN_SQL = f"""WITH {v.AWARDS_SQL},
x AS (SELECT awards.*, 5 * CAST(lower(psc) LIKE '%urgent%' AS INT) + 3 * CAST(naics IN ('BUILDING', 'MACHINERY') AS INT) AS w, c_nationkey < 10 AS has FROM awards JOIN customer ON c_custkey = entity_id WHERE occurred_at >= TIMESTAMP '1999-01-01'),
s AS (SELECT id, w + CASE WHEN has THEN 10 ELSE 0 END AS score, row_number() OVER (ORDER BY w + CASE WHEN has THEN 10 ELSE 0 END DESC, occurred_at DESC, id DESC) AS rank FROM x WHERE w + CASE WHEN has THEN 10 ELSE 0 END >= 1)
"""


@register("pip1_source_run", _RUN_SQL + "SELECT id, CAST(score AS BIGINT) AS score, rank FROM s WHERE rank <= 200")
def pip1(spark, sf_dir):
    return _run(spark, sf_dir).snapshot.select("id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("pip1_run_correlations", _RUN_SQL + "SELECT lane, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members FROM (SELECT 'same_uei' AS lane, recipient_uei AS k, count(*) AS n FROM x GROUP BY recipient_uei UNION ALL SELECT 'same_agency', agency_name, count(*) FROM x GROUP BY agency_name UNION ALL SELECT 'same_psc', psc, count(*) FROM x GROUP BY psc UNION ALL SELECT 'same_naics', naics, count(*) FROM x GROUP BY naics) u WHERE n BETWEEN 2 AND 200 GROUP BY lane")
def pip1_lanes(spark, sf_dir):
    return _run(spark, sf_dir, skip=("rank",)).correlations.groupBy("lane").agg(F.count("*").alias("clusters"), F.sum("event_count").alias("members"))


@register("pip2_run_gates", _RUN_SQL + "SELECT 'ranked' AS metric, (SELECT count(*) FROM s WHERE rank <= 200) >= 100 AS ok UNION ALL SELECT 'unlinked_pct', (SELECT 100e0 * count(CASE WHEN NOT has THEN 1 END) / count(*) FROM x) <= 50 UNION ALL SELECT 'missing', false")
def pip2(spark, sf_dir):
    run = _run(spark, sf_dir)
    ranked = run.snapshot.agg(F.lit("ranked").alias("metric"), F.count("*").cast("double").alias("value"))
    unlinked = run.links.agg(F.lit("unlinked_pct").alias("metric"), (100 * F.count_if(F.col("entity_id").isNull()) / F.count("*")).alias("value"))
    policy = spark.createDataFrame([("ranked", ">=", 100.0), ("unlinked_pct", "<=", 50.0), ("missing", ">=", 1.0)], "metric string, op string, bound double")
    return runs.gated_run(run, ranked.union(unlinked), policy).select("metric", "ok")


@register("pip3_evaluation_run", _RUN_SQL + ", b AS (SELECT id, row_number() OVER (ORDER BY w + CASE WHEN country = 'ASIA' THEN 4 ELSE 0 END DESC, occurred_at DESC, id DESC) AS rank FROM x WHERE w + CASE WHEN country = 'ASIA' THEN 4 ELSE 0 END >= 1), o AS (SELECT * FROM b WHERE rank <= 200), n AS (SELECT * FROM s WHERE rank <= 200) SELECT count(CASE WHEN o.rank <= 10 AND n.rank <= 10 THEN 1 END) AS overlap, count(CASE WHEN n.rank <= 10 AND coalesce(o.rank, 999) > 10 THEN 1 END) AS promoted, count(CASE WHEN o.rank <= 10 AND coalesce(n.rank, 999) > 10 THEN 1 END) AS demoted, count(o.id) AS base_rows, count(n.id) AS target_rows FROM o FULL OUTER JOIN n ON o.id = n.id")
def pip3(spark, sf_dir):
    weights = F.aggregate(F.transform("clauses", lambda c: c["weight"]), F.lit(0), lambda a, w: a + w)
    return runs.evaluation_run(_run(spark, sf_dir), weights + F.when(F.col("country") == "ASIA", 4).otherwise(0))
