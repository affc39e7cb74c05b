"""Ordered rows in blocks of bounded size, so that no group of rows has to meet in one task.

``numbered`` sorts a table over all tasks and numbers its rows from 0 without gaps. Rows whose numbers share ``number div BLOCK``
are a block; the rows of one group in one block are a run. What a run does is summed up in a short text (JSON), whatever its
length, and ``contexts`` tells every run what it has to know of the rest of its group: summaries are combined upwards
over blocks of blocks, contexts are pushed downwards again. A group of a third of all rows takes one more level
for each factor of ``BLOCK``, and no task reads more than ``BLOCK`` summaries of a group at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import short_batches, stored

BLOCK = 1024
OUT_ROWS = 256


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``seq``, their number in the order of the columns ``order`` (nulls first); written to shared storage.

    Rows are dealt out by ranges of the order, sorted where they arrive, and written with their place in the partition; one number a
    partition (its size) goes to the driver.
    """
    spark, keys = rows.sparkSession, [F.col(c).asc_nulls_first() for c in order]
    place = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    table = stored(place, name)
    part = F.shiftright("_place", 33)
    sizes = sorted(table.groupBy(part.alias("part")).count().collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _start long").coalesce(1)
    return table.join(F.broadcast(offsets), part == F.col("_part")).withColumn("seq", F.col("_start") + F.col("_place") - F.shiftleft("_part", 33)).drop("_place", "_part", "_start")


def block_of(seq: Column) -> Column:
    return F.floor(seq / F.lit(BLOCK)).cast("long")


def streamed(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[Iterator[dict]], Iterable[dict]], schema: str, dealt: bool = True) -> DataFrame:
    """``each`` is called with an iterator over the rows (dictionaries) of every group of ``keys``, in order; what it yields are the rows returned.

    Rows of a group arrive one by one; only what ``each`` keeps is in memory. ``dealt``: rows have yet to be brought together.
    """
    sides = [F.col(k) for k in keys]
    sorted_rows = (rows.repartition(*sides) if dealt else rows).sortWithinPartitions(*keys, *order)
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        every = (r for b in batches for r in b.to_pylist())
        out = []
        for _, group in itertools.groupby(every, key=lambda r: tuple(r[k] for k in keys)):
            for x in each(group):
                out.append(x)
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return short_batches(sorted_rows).mapInArrow(run, schema)


def contexts(runs: DataFrame, combine: Callable[[list[str]], str], root: Callable[[str], str], push: Callable[[str, list[str]], list[str]], name: str) -> DataFrame:
    """(grp, block, context) of every run.

    ``runs`` has (grp, block, summary). ``combine`` makes one summary of those of consecutive runs, ``root`` the context of a whole group
    from its summary, ``push`` the contexts of consecutive runs from that of all of them and their summaries.
    """
    kind = dict(runs.dtypes)["grp"]
    one, up, down = f"grp {kind}, block long, summary string", f"grp {kind}, block long, summary string", f"grp {kind}, block long, context string"
    spark = runs.sparkSession

    def rooted(table: DataFrame) -> DataFrame:
        return streamed(table, ["grp"], ["block"], lambda g: ({"grp": r["grp"], "block": r["block"], "context": root(r["summary"])} for r in g), down)

    def combined(group):
        rows = list(group)
        yield {"grp": rows[0]["grp"], "block": rows[0]["above"], "summary": combine([r["summary"] for r in rows])}

    def pushed(group):
        rows = list(group)
        for r, context in zip(rows, push(rows[0]["context"], [r["summary"] for r in rows])):
            yield {"grp": r["grp"], "block": r["block"], "context": context}

    above = block_of(F.col("block")).alias("above")
    levels, found = [], []
    now = stored(runs.select("grp", "block", "summary"), f"{name}-runs")
    while True:
        sizes = stored(now.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-many")
        split = now["grp"].eqNullSafe(sizes["grp"])
        found.append(rooted(now.join(sizes, split, "left_anti")))
        levels.append(now.join(sizes, split, "left_semi"))
        if sizes.isEmpty():
            break
        now = stored(streamed(levels[-1].select("grp", above, "block", "summary"), ["grp", "above"], ["block"], combined, up), f"{name}-runs")
    answer = stored(found.pop(), f"{name}-contexts")
    levels.pop()
    while levels:
        below, alone = levels.pop(), found.pop()
        wide = below.select(F.col("grp").alias("g"), above, F.col("block").alias("b"), "summary")
        told = wide.join(answer, wide["g"].eqNullSafe(answer["grp"]) & (wide["above"] == answer["block"])).select(F.col("g").alias("grp"), "above", F.col("b").alias("block"), "summary", "context")
        answer = stored(streamed(told, ["grp", "above"], ["block"], pushed, down).unionByName(alone), f"{name}-contexts")
    return answer


def summed(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``weight`` (long) over all rows ahead of each in the order of the columns ``order``."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_ahead", T.LongType())])
    kind = to_arrow_schema(schema)

    def add(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(values, dtype=np.int64) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int64)), pa.array(ends - values, pa.int64())], names=kind.names)
            total = int(ends[-1]) if len(ends) else total

    table = stored(sorted_rows.mapInArrow(add, schema), name)
    sizes = sorted(table.groupBy("_part").agg(F.sum(weight)).collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _start long").coalesce(1)
    return table.join(F.broadcast(offsets), "_part").withColumn("before", F.col("_start") + F.col("_ahead")).drop("_part", "_start", "_ahead")
