"""A stored inverted index: appended from a high-water mark, searched by its terms' partitions alone.

``postings`` holds (field, term, key, tf, length), partitioned by segment and by the hash of the term; ``lengths`` the number and summed length of each field's
documents by segment; ``marks`` the highest id of each segment. A segment is what one append has found above the mark. It is
written over under its own number until its mark stands, so an append that broke off is done again without repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .search import BROADCAST_TERMS, words_of
from .store import begun

BUCKETS = 256
MARKS = "segment int, high long, documents long"
LENGTHS = "field string, docs long, words long, segment int"
POSTINGS = "field string, term string, id long, tf long, length int, segment int, bucket int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches):
    """Rows (id, field, words, length) -> (id, field, term, tf, length), each word of a row once."""
    for batch in batches:
        lists = batch.column(2)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        size = max(1, len(words.dictionary))
        pair, tf = np.unique(row * size + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        at, term = (pa.array(x) for x in np.divmod(pair, size))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.dictionary.take(term), pa.array(tf.astype(np.int64)), batch.column(3).take(at)], names=["id", "field", "term", "tf", "length"])


class Postings:
    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...], key: str = "id"):
        self.spark, self.path, self.fields, self.key = spark, path, fields, key
        for name, kind in (("marks", MARKS), ("postings", POSTINGS), ("lengths", LENGTHS)):
            begun(spark, f"{path}/{name}", kind)

    def marks(self) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(f"{self.path}/marks")

    def high_water(self) -> tuple[int, int | None]:
        """(number of segments, highest id indexed)."""
        row = self.marks().agg(F.coalesce(F.max("segment") + 1, F.lit(0)).alias("n"), F.max("high").alias("high")).first()
        return row["n"], row["high"]

    def append(self, documents: DataFrame) -> int:
        """Index the documents above the mark; returns how many there were."""
        segment, high = self.high_water()
        new = documents if high is None else documents.where(F.col(self.key) > high)
        fields = [F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("w")) for f in self.fields]
        rows = new.select(F.col(self.key).cast("long").alias("id"), F.explode(F.array(*fields)).alias("x")).select("id", "x.field", "x.w", F.size("x.w").alias("length"))
        found = new.agg(F.max(F.col(self.key).cast("long")).alias("high"), F.count_distinct(F.col(self.key).cast("long")).alias("n")).first()
        if not found["n"]:
            return 0
        # a document's words are counted where it is read; postings are shuffled once, and those of a bucket go to several tasks by id, so that neither a bucket nor a frequent term is one task
        terms = rows.mapInArrow(_counted, "id long, field string, term string, tf long, length int").withColumn("bucket", bucket_of(F.col("term"))).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(8)))
        whole = terms.repartition("bucket", "_part").groupBy("bucket", "_part", "field", "term", "id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        whole = whole.select("field", "term", "id", "tf", "length", "bucket").sortWithinPartitions("bucket", "term")
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        rows.groupBy("field").agg(F.count("*").alias("docs"), F.sum("length").alias("words")).write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
        self.spark.createDataFrame([(segment, found["high"], found["n"])], MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        return found["n"]

    def _committed(self, kind: str, schema: str) -> DataFrame:
        segments = [r["segment"] for r in self.marks().select("segment").collect()]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("segment").isin(segments))

    def search(self, queries: DataFrame, boosts: dict[str, float], query_key: str, query_text: str, top: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_key, key, score, place): the ``top`` documents of every query by the best of their fields' BM25 scores (ties by key)."""
        wanted = stored(queries.select(query_key, F.explode(F.array_distinct(words_of(F.col(query_text)))).alias("term")).withColumn("bucket", bucket_of(F.col("term"))), "asked")
        terms = wanted.select("term", "bucket").distinct()
        few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        small = F.broadcast if few else (lambda x: x)
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
        stats = self._committed("lengths", LENGTHS).groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("avg_length"))
        every = self._committed("postings", POSTINGS)
        rows = every.where(F.col("bucket").isin(buckets) & F.col("field").isin(*boosts)).join(small(terms.select("term")), "term", "left_semi")
        df = rows.groupBy("field", "term").agg(F.count("*").alias("df"))
        weights = df.join(F.broadcast(stats), "field").select("field", "term", "avg_length", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
        scored = rows.join(small(weights.join(wanted.drop("bucket"), "term")), ["field", "term"]).groupBy(query_key, "id", "field").agg(F.bround(F.sum(gain), 4).alias("score"))
        boost = F.create_map(*[x for f, n in boosts.items() for x in (F.lit(f), F.lit(float(n)))])
        best = scored.groupBy(query_key, "id").agg(F.max(F.bround(F.col("score") * boost[F.col("field")], 4)).alias("score"))
        place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc("id")))
        return best.withColumn("place", place).where(F.col("place") <= top).withColumnRenamed("id", self.key)
