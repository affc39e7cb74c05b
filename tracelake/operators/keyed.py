"""Joins and ranks that no single key and no single task has to carry."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast, with one short row each.
MOST_FREQUENT = 10_000

Write = Callable[[DataFrame], DataFrame]


def join_by_frequency(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with a table of one short row for each key that says, in ``count``, how many rows the key has.

    Keys of at least 1 / ``MOST_FREQUENT`` of all rows, so at most that many, are broadcast; only rows of rarer keys are shuffled.
    Null keys match nothing.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * MOST_FREQUENT >= total
    heavy, light = F.broadcast(table.where(often).drop(count)), table.where(~often).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(light, keys, how))


def numbered(rows: DataFrame, order: list, name: str, write: Write) -> DataFrame:
    """``rows`` with ``name``, their rank from 1 in the order of the sort columns ``order`` (which has to be total).

    Rows are dealt out by ranges of the order, sorted where they arrive and written with their place; one number a partition goes to the driver.
    """
    placed = write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=1)
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _start long").coalesce(1)
    ranked = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return ranked.withColumn(name, F.col("_start") + F.col("_place") - F.shiftleft("_part", 33)).drop("_place", "_part", "_start")
