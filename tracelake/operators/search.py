"""Field-boosted BM25 search.

The queries, which are few beside the documents, go to every task as an index from words to queries. A document is scored where it is read, against
all of them, and a task hands on no more than its own ``top`` documents of each query, so neither words nor pairs of query and document
are shuffled or kept. Queries with more words in all than ``ASKED_WORDS``, and keys that aren't numbers, are joined with postings instead.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Queries with more distinct terms than this are joined by shuffle instead of being sent to every task.
BROADCAST_TERMS = 500_000
#: Queries with at most so many words in all, each counted once a query, are an index in every task.
ASKED_WORDS = 1_000_000
#: Scores of a block of documents and all queries that are held at once.
BLOCK_SCORES = 4_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def bm25(documents: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, top: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``top`` documents of every query over one field (ties by key)."""
    return fielded(documents, queries, key, {text: 1.0}, query_key, query_text, top, k1, b)


def fielded(documents: DataFrame, queries: DataFrame, key: str, boosts: dict[str, float], query_key: str, query_text: str, top: int = 10, k1: float = 1.2, b: float = 0.75, where: Column | None = None) -> DataFrame:
    """The ``top`` documents of every query: best of the fields' BM25 scores times their boosts (ties by key).

    ``where`` filters documents (source, category) before anything is counted. Rows of one key are one document with the words of all.
    """
    docs = documents if where is None else documents.where(where)
    asked = queries.select(query_key, F.explode(F.array_distinct(words_of(F.col(query_text)))).alias("term"))
    whole = isinstance(documents.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole and 0 < asked.limit(ASKED_WORDS + 1).count() <= ASKED_WORDS:
        return _scored_in_place(docs, asked, key, boosts, query_key, top, k1, b)
    return _by_postings(docs, queries, key, boosts, query_key, query_text, top, k1, b)


def _scored_in_place(docs: DataFrame, asked: DataFrame, key: str, boosts: dict[str, float], query_key: str, top: int, k1: float, b: float) -> DataFrame:
    spark, n = docs.sparkSession, len(boosts)
    words = [words_of(F.col(f)).alias(f"_w{i}") for i, f in enumerate(boosts)]
    rows = docs.select(F.col(key).cast("long").alias("_key"), *words).select("*", *[F.size(f"_w{i}").alias(f"_n{i}") for i in range(n)])
    stats = rows.agg(F.count("*"), *[F.avg(f"_n{i}") for i in range(n)]).first()
    again = docs.groupBy(F.col(key).cast("long").alias("_again")).count().where("count > 1").select("_again")
    merged = None
    if not again.isEmpty():  # a word's document is as long as the longest of the rows that hold the word
        same, each = F.col("_key").eqNullSafe(F.col("_again")), lambda i: F.transform(f"_w{i}", lambda _: F.col(f"_n{i}"))
        merged = rows.join(again, same, "left_semi").groupBy("_key").agg(*[F.flatten(F.collect_list(f"_w{i}")).alias(f"_w{i}") for i in range(n)], *[F.flatten(F.collect_list(each(i))).alias(f"_n{i}") for i in range(n)])
        rows = rows.join(again, same, "left_anti")
    by_query: dict = {}
    for r in asked.collect():  # at most ASKED_WORDS
        by_query.setdefault(r[0], []).append(r[1])
    names = sorted({t for x in by_query.values() for t in x})
    number = {t: i for i, t in enumerate(names)}
    # queries that ask for the same words have the same answer
    kinds: dict[tuple, int] = {}
    kind_of = [(q, kinds.setdefault(tuple(sorted(number[t] for t in x)), len(kinds))) for q, x in by_query.items()]
    asking = [[] for _ in names]
    for terms, kind in kinds.items():
        for t in terms:
            asking[t].append(kind)
    asking = [np.array(x, np.int64) for x in asking]
    wanted = spark.createDataFrame([(t,) for t in names], "term string")
    idf = [np.zeros(len(names)) for _ in boosts]
    every = rows.select(*[f"_w{i}" for i in range(n)])
    every = every if merged is None else every.unionByName(merged.select(every.columns))
    found = every.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.array_distinct(f"_w{i}").alias("w")) for i in range(n)])).alias("x")).select("x.field", F.explode("x.w").alias("term"))
    for r in found.join(F.broadcast(wanted), "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df")).collect():
        idf[r["field"]][number[r["term"]]] = np.log(1 + (stats[0] - r["df"] + 0.5) / (r["df"] + 0.5))
    scale, lengths = [float(x) for x in boosts.values()], [float(stats[1 + i] or 0) for i in range(n)]
    n_kinds = len(kinds)

    def best(batches):
        known = pa.array(names, pa.string())
        kind, score, keys = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        least, last = np.full(n_kinds, -1.0), np.zeros(n_kinds, np.int64)
        step = max(1, BLOCK_SCORES // n_kinds)
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            for start in range(0, len(ids), step):
                part = batch.slice(start, step)
                here, block = ids[start : start + step], np.full((part.num_rows, n_kinds), -1.0)
                for i in range(n):
                    lists, size = part.column(1 + i), part.column(1 + n + i)
                    term = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(here)), pc.list_value_length(lists).to_numpy())
                    pair, tf = np.unique(term[term >= 0].astype(np.int64) * len(here) + row[term >= 0], return_counts=True)
                    t, d = np.divmod(pair, len(here))
                    if pa.types.is_list(size.type):
                        length = np.zeros(len(pair))
                        np.maximum.at(length, np.searchsorted(pair, term[term >= 0].astype(np.int64) * len(here) + row[term >= 0]), size.flatten().to_numpy()[term >= 0])
                    else:
                        length = size.to_numpy()[d]
                    gain = idf[i][t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / lengths[i])) if len(t) else np.zeros(0)
                    sums = np.zeros(block.shape)
                    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else []
                    for x, y in zip(first, [*first[1:], len(t)]):
                        sums[np.ix_(d[x:y], asking[t[x]])] += gain[x:y, None]
                    block = np.maximum(block, np.where(sums > 0, np.round(np.round(sums, 4) * scale[i], 4), -1.0))
                d, q = np.nonzero((block >= 0) & ((block > least) | ((block == least) & (here[:, None] < last))))
                if len(d):
                    kind, score, keys = np.concatenate([kind, q]), np.concatenate([score, block[d, q]]), np.concatenate([keys, here[d]])
                    order = np.lexsort((keys, -score, kind))
                    kind, score, keys = kind[order], score[order], keys[order]
                    begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
                    place = np.arange(len(kind)) - np.repeat(begin, np.diff(np.r_[begin, len(kind)]))
                    kind, score, keys, place = (x[place < top] for x in (kind, score, keys, place))
                    full = place == top - 1
                    least[kind[full]], last[kind[full]] = score[full], keys[full]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys, mask=keys == -(2**63)), pa.array(score)], names=["_kind", "_key", "score"])

    scored = [x.select("_key", *[f"_w{i}" for i in range(n)], *[f"_n{i}" for i in range(n)]).mapInArrow(best, "_kind long, _key long, score double") for x in (rows, merged) if x is not None]
    place = F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("score"), F.asc("_key")))
    answers = functools.reduce(DataFrame.unionByName, scored).withColumn("place", place).where(F.col("place") <= top)
    of = spark.createDataFrame(kind_of, T.StructType([asked.schema[query_key], T.StructField("_kind", T.LongType())]))
    return answers.join(of, "_kind").select(query_key, F.col("_key").cast(docs.schema[key].dataType).alias(key), "score", "place")


def _by_postings(docs: DataFrame, queries: DataFrame, key: str, boosts: dict[str, float], query_key: str, query_text: str, top: int, k1: float, b: float) -> DataFrame:
    """Only words that some query asks for become postings: they are picked before the shuffle, which moves one row for each document and asked word."""
    fields = [F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("w")) for f in boosts]
    rows = docs.select(key, F.explode(F.array(*fields)).alias("x")).select(key, "x.field", "x.w", F.size("x.w").alias("length"))
    stats = rows.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"))
    wanted = queries.select(query_key, F.explode(F.array_distinct(words_of(F.col(query_text)))).alias("term"))
    terms = wanted.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda x: x)
    postings = rows.select(key, "field", "length", F.explode("w").alias("term")).join(small(terms), "term", "left_semi")
    postings = postings.groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(stats), "field").select("field", "term", "avg_length", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = weights.join(wanted, "term")
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = postings.join(small(asked), ["field", "term"]).groupBy(query_key, key, "field").agg(F.bround(F.sum(gain), 4).alias("score"))
    boost = F.create_map(*[x for f, n in boosts.items() for x in (F.lit(f), F.lit(float(n)))])
    best = scored.groupBy(query_key, key).agg(F.max(F.bround(F.col("score") * boost[F.col("field")], 4)).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key)))
    return best.withColumn("place", place).where(F.col("place") <= top)
