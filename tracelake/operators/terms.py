"""Which of many terms a text contains: one pass of an Aho-Corasick automaton over each text, however many terms there are.

Terms are dealt into parts of at most ``PART_BYTES`` of UTF-8. Each part goes to the workers once, as a broadcast of that size at most, and
becomes an automaton there; a text's answers from all parts are put together in its row, so nothing is joined or shuffled.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 32 << 20

MOST_BUILT = 4  # automata that a worker keeps
_BUILT: dict[str, object] = {}


def automaton(pairs: list[tuple[str, list[int]]]):
    """Automaton of (term, values) that yields values."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, values in pairs:
        found.add_word(term, values)
    found.make_automaton()
    return found


def _matcher(spark: SparkSession, pairs: list[tuple[str, list[int]]]):
    sent, name = spark.sparkContext.broadcast(pairs), uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def match(texts: pa.Array) -> pa.Array:
        if name not in _BUILT:
            if len(_BUILT) >= MOST_BUILT:
                _BUILT.clear()
            _BUILT[name] = automaton(sent.value)
        built = _BUILT[name]
        return pa.array([sorted({v for _, values in built.iter(t) for v in values}) if t else [] for t in texts.to_pylist()], pa.list_(pa.int64()))

    return match


def contained(text: Column, terms: DataFrame, term: str = "term", value: str = "value") -> Column:
    """Sorted array of the values (long) of all terms that the text contains, ignoring case; empty terms are in no text."""
    spark = terms.sparkSession
    wanted = terms.select(F.lower(term).alias("t"), F.col(value).cast("long").alias("v")).where("t != '' AND v IS NOT NULL").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    parts = -(-size // PART_BYTES)
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.array().cast("array<bigint>")]
    for k in range(parts):
        some = wanted.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).groupBy("t").agg(F.collect_set("v").alias("v"))
        if pairs := [(r["t"], r["v"]) for r in some.collect()]:
            found.append(_matcher(spark, pairs)(low))
    return F.array_sort(F.array_distinct(F.concat(*found)))
