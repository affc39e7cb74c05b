"""A corpus cleaning pipeline of five operators, each stage reading what the one before wrote.

1. language: documents without a recognised language (``und``) go.
2. near_duplicates: one document of each SimHash component stays.
3. decontaminate: documents that contain a benchmark item go.
4. secrets: every secret span in a text is masked; the document stays.
5. packing: all documents are packed into sequences (one row per piece).

All stages but the last return the columns of ``documents``, whatever their names and types. A null text has
no language and goes in the first stage (the others take it as empty); repeated rows are one row after the
second; null ids are packed like any other; texts of any length stay whole; an empty table passes through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate as dc
from tracelake.llm import packing, ppm, secrets, simhash
from tracelake.llm.scratch import fresh, short_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (found,) = fresh(docs)
    return ppm.identify_languages(docs, name=found).where(F.col(found)["lang_pred"] != ppm.UNKNOWN).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (items,) = fresh(docs)
    return dc.find_contained(docs, benchmark, name=items).where(F.size(items) == 0).drop(items)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = short_batches(docs).withColumn("text", secrets.mask_udf()(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("packing", pack)]

#: No stage's model can be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
