"""Event views over the given star-schema tables: awards (orders), notices (line items), texts, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02"
TEXT = "string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def award_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(place, customer.c_nationkey == place.n_nationkey)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.lit("AWARDS").alias("source"),
        F.col("o_orderdate").alias("occurred_at"),
        F.col("c_custkey").alias("entity_id"),
        F.col("o_orderkey").cast(TEXT).alias("award_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast(TEXT)).alias("piid"),
        F.col("c_name").alias("recipient_name"),
        F.concat(F.lit("UEI"), F.col("c_custkey").cast(TEXT)).alias("recipient_uei"),
        F.col("n_name").alias("agency_name"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("country"),
        F.col("c_mktsegment").alias("naics"),
        F.col("o_orderpriority").alias("psc"),
        F.lower("o_orderpriority").alias("notice_type"),
        F.col("o_totalprice").alias("amount"),
        F.array(F.concat(F.lit("seg:"), F.lower("c_mktsegment")), F.concat(F.lit("prio:"), F.lower("o_orderpriority")), F.concat(F.lit("status:"), F.lower("o_orderstatus")), F.concat(F.lit("nation:"), F.lower("n_name"))).alias("keywords"),
    )


AWARDS_SQL = """awards AS (
  SELECT o_orderkey AS id, 'AWARDS' AS source, o_orderdate AS occurred_at, c_custkey AS entity_id, CAST(o_orderkey AS VARCHAR) AS award_id,
         'C' || CAST(o_custkey AS VARCHAR) AS piid, c_name AS recipient_name, 'UEI' || CAST(c_custkey AS VARCHAR) AS recipient_uei,
         n_name AS agency_name, n_name AS state, r_name AS country, c_mktsegment AS naics, o_orderpriority AS psc,
         lower(o_orderpriority) AS notice_type, o_totalprice AS amount,
         'seg:' || lower(c_mktsegment) AS k1, 'prio:' || lower(o_orderpriority) AS k2, 'status:' || lower(o_orderstatus) AS k3, 'nation:' || lower(n_name) AS k4
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def notice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    seller = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "s_name", "n_name")
    rows = line.join(part, line.l_partkey == part.p_partkey).join(seller, line.l_suppkey == seller.s_suppkey)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.lit("NOTICES").alias("source"),
        F.col("l_shipdate").alias("occurred_at"),
        F.col("s_suppkey").alias("entity_id"),
        F.col("l_orderkey").cast(TEXT).alias("solicitation_number"),
        F.col("s_name").alias("recipient_name"),
        F.concat(F.lit("UEI"), F.col("s_suppkey").cast(TEXT)).alias("recipient_uei"),
        F.col("n_name").alias("agency_name"),
        F.col("p_type").alias("psc"),
        F.col("p_brand").alias("naics"),
        F.array(F.concat(F.lit("brand:"), F.lower("p_brand")), F.concat(F.lit("type:"), F.lower("p_type")), F.concat(F.lit("flag:"), F.lower("l_returnflag")), F.concat(F.lit("mode:"), F.lower("l_linestatus"))).alias("keywords"),
    )


NOTICES_SQL = """notices AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, 'NOTICES' AS source, l_shipdate AS occurred_at, s_suppkey AS entity_id,
         CAST(l_orderkey AS VARCHAR) AS solicitation_number, s_name AS recipient_name, 'UEI' || CAST(s_suppkey AS VARCHAR) AS recipient_uei,
         n_name AS agency_name, p_type AS psc, p_brand AS naics
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer labels: decision by quality (null where unlabelled), rank inside each source."""
    from pyspark.sql.window import Window

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), F.asc("doc_id")))
    rows = documents.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.col("source").alias("snapshot"), F.col("lang").alias("family"), rank.alias("rank"), F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "reject").alias("decision"), "toxic")


LABELS_SQL = """label_rows AS (
  SELECT d.doc_id, d.source AS snapshot, d.lang AS family, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank,
         CASE WHEN l.quality = 1 THEN 'keep' WHEN l.quality = 0 THEN 'reject' END AS decision, l.toxic AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
