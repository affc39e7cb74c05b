"""Readers of landed feeds, rule files, term lists and reviewer labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import clean_code, clean_text, naics_code, parsed_date

RULE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "pattern")] + [T.StructField("weight", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType()))])
PACK = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("default_weight", T.IntegerType()), T.StructField("weight", T.IntegerType()), T.StructField("rules", T.ArrayType(RULE))]
)
ONTOLOGY = T.StructType([T.StructField("defaults", T.StructType([T.StructField("default_weight", T.IntegerType()), T.StructField("case_insensitive", T.BooleanType())])), T.StructField("packs", T.ArrayType(PACK))])
FIELDS = ("snippet", "place_text", "doc_id", "source_url", "raw_json")
DEFAULT_FIELDS = ("snippet", "place_text", "doc_id")


def record_pages(spark: SparkSession, path: str, member: str, one_a_file: bool = True) -> DataFrame:
    """(raw_json, source_file, page): the records of the list ``member`` of every landed page, and an empty page as one row without a record.

    ``page`` numbers pages within the read. A file is one page, or holds a page a line (which Spark can split).
    """
    pages = spark.read.schema(f"{member} array<string>").json(path, multiLine=one_a_file, recursiveFileLookup=True)
    numbered = pages.select(member, F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("page"))
    return numbered.select(F.explode_outer(member).alias("raw_json"), "source_file", "page")


def award_pages(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """One row per record of ``results[]``: the record as a JSON text, and its file."""
    return record_pages(spark, path, "results", one_a_file).where("raw_json is not null").drop("page")


def notice_pages(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """One row per record of ``opportunitiesData[]``. Files of several search terms are read together; ``merge.first_rows`` makes records unique."""
    return record_pages(spark, path, "opportunitiesData", one_a_file).where("raw_json is not null").drop("page")


def page_diagnostics(pages: DataFrame) -> DataFrame:
    """Per file of ``record_pages``: pages with records, empty pages, records."""
    per_page = pages.groupBy("source_file", "page").agg(F.count("raw_json").alias("n"))
    return per_page.groupBy("source_file").agg(F.count_if(F.col("n") > 0).alias("pages_with_data"), F.count_if(F.col("n") == 0).alias("empty_pages"), F.sum("n").alias("records"))


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Flat rules of ontology files: enabled packs; weight of the rule, else the pack, else the file."""
    return flat_rules(spark.read.schema(ONTOLOGY).json(path, multiLine=True))


def parsed_ontologies(texts: DataFrame, text: str) -> DataFrame:
    """Ontologies from a column of JSON texts."""
    return texts.select(F.from_json(text, ONTOLOGY).alias("o")).select("o.*")


def flat_rules(ontologies: DataFrame) -> DataFrame:
    """(pack, rule, type, pattern, weight, weight_source, fields, case_insensitive); ``tagging.tag`` takes such a table."""
    packs = ontologies.select("defaults", F.explode("packs").alias("p")).where(F.coalesce("p.enabled", F.lit(True)))
    rules = packs.select("defaults", "p", F.explode("p.rules").alias("r"))
    weight = F.coalesce("r.weight", "p.default_weight", "p.weight", "defaults.default_weight")
    source = F.when(F.col("r.weight").isNotNull(), "rule").when(F.coalesce("p.default_weight", "p.weight").isNotNull(), "pack").otherwise("defaults")
    allowed = F.filter(F.coalesce("r.fields", F.array()), lambda f: f.isin(*FIELDS))
    fields = F.when(F.size(allowed) > 0, allowed).otherwise(F.array(*map(F.lit, DEFAULT_FIELDS)))
    return rules.where(weight.isNotNull()).select(F.col("p.id").alias("pack"), F.col("r.id").alias("rule"), F.lower("r.type").alias("type"), F.col("r.pattern").alias("pattern"), weight.alias("weight"), source.alias("weight_source"), fields.alias("fields"), F.coalesce("defaults.case_insensitive", F.lit(True)).alias("case_insensitive"))


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, place): terms of newline-delimited files in order, from their first place on; comments and repeats dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("term"), F.monotonically_increasing_id().alias("place"))
    return lines.where("term != '' and not startswith(term, '#')").groupBy("term").agg(F.min("place").alias("place"))


def merged_terms(*lists: DataFrame) -> DataFrame:
    """Several ``term_list`` tables as one, in the order given; a term counts where it comes first."""
    every = [t.select("term", F.struct(F.lit(k).alias("list"), "place").alias("place")) for k, t in enumerate(lists)]
    return reduce(DataFrame.unionByName, every).groupBy("term").agg(F.min("place").alias("place"))


LABELS = "snapshot_id string, event_id string, rank string, decision string, foia_ready string"
YES, NO = ("yes", "y", "true", "1"), ("no", "n", "false", "0")


def label_files(spark: SparkSession, csv: str | None = None, jsonl: str | None = None) -> DataFrame:
    """Reviewer labels of CSV files and JSON Lines files below folders; a row that isn't valid carries its ``problem``."""
    read = []
    if csv is not None:
        rows = spark.read.csv(csv, header=True, recursiveFileLookup=True, escape='"')
        read.append(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in LABELS.replace(" string", "").split(", ")], F.col("_metadata.file_path").alias("source_file")))
    if jsonl is not None:
        read.append(spark.read.schema(LABELS).json(jsonl, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("source_file")))
    return checked_labels(reduce(DataFrame.unionByName, read))


def checked_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with decision, rank and foia_ready in their own types, and ``problem``: decision, foia_ready, rank, identity or duplicate."""
    decision, ready = F.lower(clean_text(F.col("decision"))), F.lower(clean_text(F.col("foia_ready")))
    rank, event = F.expr("try_cast(rank as int)"), clean_text(F.col("event_id"))
    answer = F.when(ready.isin(*YES), "yes").when(ready.isin(*NO), "no")
    problem = F.when(decision.isNotNull() & ~decision.isin("keep", "reject", "unclear"), "decision").when(ready.isNotNull() & answer.isNull(), "foia_ready").when(rank.isNull() | (rank < 1), "rank").when(event.isNull(), "identity")
    out = rows.withColumns({"problem": problem, "decision": decision, "foia_ready": answer, "rank": rank, "event_id": event})
    twice = out.where("event_id is not null").groupBy("snapshot_id", "event_id").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = twice.select(F.col("snapshot_id").alias("_s"), F.col("event_id").alias("_e"), "_n")
    out = out.join(repeated, F.col("snapshot_id").eqNullSafe(F.col("_s")) & (F.col("event_id") == F.col("_e")), "left")
    return out.withColumn("problem", F.coalesce("problem", F.when(F.col("_n").isNotNull(), "duplicate"))).drop("_s", "_e", "_n")


def json_field(raw: str, *names: str):
    return F.coalesce(*[clean_text(F.get_json_object(raw, f"$['{n}']" if " " in n else f"$.{n}")) for n in names])


def normalized_awards(records: DataFrame) -> DataFrame:
    """Award records (raw_json) as event rows keyed by a SHA-256 natural key."""
    get = lambda *n: json_field("raw_json", *n)
    guaid, award = get("generated_unique_award_id"), get("Award ID", "award_id")
    key = F.coalesce(get("internal_id"), get("source_record_id"), guaid, award, F.col("raw_json"))
    return records.select(
        F.lit("AWARDS").alias("source"),
        F.sha2(key, 256).alias("hash"),
        parsed_date(get("Action Date", "action_date")).alias("occurred_at"),
        get("Description", "description").alias("snippet"),
        guaid.alias("generated_unique_award_id"),
        award.alias("award_id"),
        clean_code(get("piid")).alias("piid"),
        F.coalesce(get("source_record_id"), guaid, award, get("document_id")).alias("source_record_id"),
        F.coalesce(get("document_id"), award, guaid).alias("doc_id"),
        get("Recipient Name", "recipient_name").alias("recipient_name"),
        clean_code(get("Recipient UEI", "recipient_uei")).alias("recipient_uei"),
        naics_code(get("naicsCode", "naics_code")).alias("naics"),
        clean_code(get("awarding_agency_code")).alias("agency_code"),
        clean_code(get("place_of_performance_state")).alias("state"),
        clean_code(get("place_of_performance_country")).alias("country"),
        F.when(guaid.isNotNull(), F.concat(F.lit("https://www.usaspending.gov/award/"), guaid)).alias("source_url"),
        "raw_json",
    )


def normalized_notices(records: DataFrame) -> DataFrame:
    """Notice records (raw_json) as event rows keyed by ``SAM.gov:<noticeId>``."""
    get = lambda *n: json_field("raw_json", *n)
    notice = get("noticeId")
    state = F.coalesce(get("placeOfPerformance.state.code"), get("placeOfPerformance.state"))
    country = F.coalesce(get("placeOfPerformance.country.code"), get("placeOfPerformance.country"))
    foreign = F.when(F.coalesce(country, F.lit("USA")) != "USA", country)
    return records.select(
        F.lit("NOTICES").alias("source"),
        F.sha2(F.coalesce(F.concat(F.lit("SAM.gov:"), notice), F.col("raw_json")), 256).alias("hash"),
        parsed_date(get("postedDate")).alias("occurred_at"),
        get("title").alias("snippet"),
        notice.alias("notice_id"),
        get("solicitationNumber").alias("solicitation_number"),
        F.lower(get("noticeType", "type")).alias("notice_type"),
        naics_code(get("naicsCode")).alias("naics"),
        clean_code(get("classificationCode")).alias("psc"),
        get("fullParentPathName").alias("agency_name"),
        clean_code(get("fullParentPathCode")).alias("agency_code"),
        get("award.awardee.name").alias("recipient_name"),
        clean_code(get("award.awardee.ueiSAM")).alias("recipient_uei"),
        F.concat_ws(", ", get("placeOfPerformance.streetAddress"), get("placeOfPerformance.city.name"), F.concat_ws(" ", state, get("placeOfPerformance.zip")), foreign).alias("place_text"),
        F.replace(get("uiLink"), F.lit("beta.sam.gov"), F.lit("sam.gov")).alias("source_url"),
        "raw_json",
    )


def ontology_summary(ontologies: DataFrame) -> DataFrame:
    """(sha256, packs, rules) of every ontology; the hash is over its JSON with sorted keys, so spacing and order of keys don't matter."""
    text = F.to_json(F.parse_json(F.to_json(F.struct("defaults", "packs"))))
    rules = F.aggregate(F.coalesce("packs", F.array().cast(ONTOLOGY["packs"].dataType)), F.lit(0), lambda n, p: n + F.greatest(F.size(p["rules"]), F.lit(0)))
    return ontologies.select(F.sha2(text, 256).alias("sha256"), F.greatest(F.size("packs"), F.lit(0)).alias("packs"), rules.alias("rules"))
