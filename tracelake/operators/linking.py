"""Match-or-create linking of events to organisations, in event order, as a fixpoint over tables.

Events are taken by id. Each looks up its identifiers from the strongest to the weakest - UEI, DUNS, CAGE, recipient id, parent-path code, name
(its display name, ignoring case) - among the entities that events before it have left; the first kind that some entity holds decides, of
several holders the oldest. The event fills the identifiers that its entity lacks (the first value stays for ever) or, if
nothing matches, creates an entity with its own. So an event's entity depends on all earlier ones, but only through who holds which value since when.

Events that no chain of identifiers connects don't touch each other, so every component of events and known entities is linked by itself: one of bounded
size (``FOLD_EVENTS``, ``FOLD_VALUES``) by a fold in event order, many components side by side, a larger one by a fixpoint over tables.

The fixpoint: from a guess of every event's entity follows who holds which value since when, and from that the next guess. An
event's entity depends on earlier events alone, so with every round at least one more step of each chain of dependence is settled for good, and a
guess that repeats itself is the sequential result. Rounds run over the first event of each distinct identity only. One pass over all events then looks for a later event that
would still have filled an identifier; if there are some, the first for each entity and identifier joins the rounds.

Holders of one value are reduced to those that are older than all holders before them, first in buckets, and values are joined by
frequency, so neither a name that a third of all events bear nor a value that many entities hold meets in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keyed import Write, join_by_frequency, numbered

#: Identifiers from the strongest to the weakest (fixed order); the last is the name.
SLOTS = ("uei", "duns", "cage", "recipient_id", "parent_code", "name")
NAME = len(SLOTS) - 1
KNOWN, NEW = 0, 1
BEFORE_ALL = -(2**63)
BUCKETS = 64
#: A component of at most so many rows and so many different identifiers is folded by one task, which holds its identifiers alone; larger ones go through rounds.
FOLD_EVENTS, FOLD_VALUES = 4_000_000, 1_000_000
FOLD_BATCH = 100_000


def _slots(name: str) -> list:
    """The identifiers of a row; recipient ids as they stand, others without regard to case."""
    return [F.lower(name) if k == NAME else F.col(c) if c == "recipient_id" else F.upper(c) for k, c in enumerate(SLOTS)]


def _values(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, slot, v): every identifier of every row."""
    listed = [F.struct(F.lit(k).alias("slot"), v.alias("v")) for k, v in enumerate(_slots(name))]
    return rows.select(key, F.explode(F.array(*listed)).alias("i")).select(key, "i.slot", "i.v").where("v IS NOT NULL")


def _held(values: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(who, slot, since, v): the identifiers of every entity, from the events linked to it; a name comes from its creator alone."""
    linked = values.join(links, "id").where((F.col("slot") != NAME) | ((F.col("who.kind") == NEW) & (F.col("who.key") == F.col("id"))))
    every = linked.select("who", "slot", F.struct(F.col("id").alias("since"), "v").alias("s")).unionByName(known)
    return every.groupBy("who", "slot").agg(F.min("s").alias("s")).select("who", "slot", "s.since", "s.v")


def _records(held: DataFrame) -> DataFrame:
    """(slot, v, records): by time, each holder that is older than all before it."""

    def records(rows: DataFrame, *keys) -> DataFrame:
        before = Window.partitionBy("slot", "v", *keys).orderBy("since", "who").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_oldest", F.min("who").over(before)).where(F.col("_oldest").isNull() | (F.col("who") < F.col("_oldest"))).drop("_oldest")

    few = records(held.withColumn("_bucket", F.pmod(F.xxhash64("who"), F.lit(BUCKETS))), "_bucket").drop("_bucket")
    return records(few).groupBy("slot", "v").agg(F.array_sort(F.collect_list(F.struct("since", "who"))).alias("records"))


def _looked_up(values: DataFrame, counts: DataFrame, held: DataFrame, write: Write) -> DataFrame:
    """(id, who): for the events that some entity matches."""
    found = join_by_frequency(values, write(counts.join(_records(held), ["slot", "v"])), ["slot", "v"], "n")
    earlier = F.filter("records", lambda r: r["since"] < F.col("id"))
    hit = found.withColumn("_e", earlier).where(F.size("_e") > 0).select("id", "slot", F.element_at("_e", -1)["who"].alias("who"))
    return hit.groupBy("id").agg(F.min(F.struct("slot", "who")).alias("m")).select("id", "m.who")


def _counted(values: DataFrame) -> DataFrame:
    return values.groupBy("slot", "v").agg(F.count("*").alias("n"))


def _settled(rows: DataFrame, known: DataFrame, write: Write, guess: DataFrame | None = None) -> DataFrame:
    """(id, who) of the events ``rows`` among themselves and with the known entities; ``guess`` may say it of some."""
    values = write(_values(rows, "id", "display"))
    counts = write(_counted(values))
    own = F.struct(F.lit(NEW).alias("kind"), F.col("id").alias("key"))
    begun = rows.select("id") if guess is None else rows.select("id").join(guess, "id", "left")
    links = begun.select("id", own.alias("who") if guess is None else F.coalesce("who", own).alias("who"))
    while True:
        found = _looked_up(values, counts, _held(values, links, known), write).withColumnRenamed("who", "_who")
        after = write(links.join(found, "id", "left").select("id", F.coalesce("_who", own).alias("who"), (F.coalesce("_who", own) != F.col("who")).alias("moved")))
        links = after.select("id", "who")
        if after.where("moved").isEmpty():
            return links


def _components(rows: DataFrame, write: Write) -> DataFrame:
    """(a, b): for every node the smallest node ``b`` that it is connected with through rows (arrays ``nodes``), but for those that are it themselves.

    Large and small stars in turn: the rounds grow with the logarithm of the number of nodes, and no node's neighbours are collected.
    """
    edges = write(rows.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).where("a != b").select("a", "b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = write(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges
        before = now


_FOLDED = "id long, kind int, key long, slot int, since long, v string"
_FOLDED_KIND = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("slot", pa.int32()), ("since", pa.int64()), ("v", pa.string())])


def _fold(batches):
    """Rows (label, kind, key, identifiers) by label, known entities first, then events by id -> whom each event is linked to, and what every entity holds."""
    label, index, held, out = None, [{} for _ in SLOTS], {}, []

    def ended():
        for (kind, key), own in held.items():
            out.extend((None, kind, key, k, *x) for k, x in enumerate(own) if x is not None)
            if len(out) >= FOLD_BATCH:
                yield put()
        held.clear()
        for x in index:
            x.clear()

    def put():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOLDED_KIND.types)], schema=_FOLDED_KIND)
        out.clear()
        return batch

    for batch in batches:
        for component, kind, key, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if component != label:
                yield from ended()
                label = component
            hit = None if kind == KNOWN else next((x for x in (index[k].get(v) for k, v in enumerate(values) if v is not None) if x is not None), None)
            who, since = hit or (kind, key), BEFORE_ALL if kind == KNOWN else key
            own = held.setdefault(who, [None] * len(SLOTS))
            for k, v in enumerate(values):
                if v is not None and own[k] is None and (hit is None or k != NAME):
                    own[k] = (since, v)
                    index[k][v] = min(index[k].get(v, who), who)
            if kind != KNOWN:
                out.append((key, *who, None, None, None))
            if len(out) >= FOLD_BATCH:
                yield put()
    yield from ended()
    if out:
        yield put()


def _by_component(named: DataFrame, known: DataFrame, write: Write) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, who) and the identifiers held of all components of bounded size, and (label, kind, key) of the rows of the larger ones."""
    names = [f"v{k}" for k in range(len(SLOTS))]
    told = known.groupBy("who", "slot").agg(F.min("s").alias("s")).groupBy("who").agg(*[F.max(F.when(F.col("slot") == k, F.col("s.v"))).alias(n) for k, n in enumerate(names)])
    told = told.select("who.kind", "who.key", *names)
    events = named.select(F.lit(NEW).alias("kind"), F.col("id").cast("long").alias("key"), *[v.alias(n) for v, n in zip(_slots("display"), names)])
    nodes = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.xxhash64(F.lit(k), n)) for k, n in enumerate(names)]))
    rows = write(told.unionByName(events).withColumn("nodes", nodes))
    stars = _components(rows.select("nodes"), write)
    rows = write(rows.withColumn("a", F.array_min("nodes")).join(stars, "a", "left").select(F.coalesce("b", "a").alias("label"), "kind", "key", *names))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).join(stars.groupBy(F.col("b").alias("label")).agg(F.count("*").alias("more")), "label", "left")
    # at most a FOLD_VALUES-th as many as there are rows
    large = [r["label"] for r in sizes.where((F.col("n") > FOLD_EVENTS) | (F.coalesce("more", F.lit(0)) >= FOLD_VALUES)).select("label").collect()]
    few = rows.where(~F.col("label").isin(large)) if large else rows
    done = write(few.repartition("label").sortWithinPartitions("label", "kind", "key").mapInArrow(_fold, _FOLDED))
    who = F.struct("kind", "key").alias("who")
    return done.where("id IS NOT NULL").select("id", who), done.where("id IS NULL").select(who, "slot", "since", "v"), rows.where(F.col("label").isin(large) if large else F.lit(False)).select("label", "kind", "key")


def linked(events: DataFrame, entities: DataFrame, write: Write) -> tuple[DataFrame, DataFrame]:
    """Links of events (``entities.identity`` columns) and the identifiers that entities hold afterwards.

    Links: (id, entity_id, created_by, status): ``linked`` to a known entity (entity_id, uei, ..., name), or to one that the event ``created_by`` created
    (``created`` for that event itself), or ``skipped_no_name``. Identifiers: (kind, key, slot, since, v). ``write`` stores a table in shared storage and reads it back.
    """
    known = write(_values(entities, "entity_id", "name").select(F.struct(F.lit(KNOWN).alias("kind"), F.col("entity_id").cast("long").alias("key")).alias("who"), "slot", F.struct(F.lit(BEFORE_ALL).cast("long").alias("since"), "v").alias("s")))
    rows = write(events.select("id", *SLOTS[:-1], "display"))
    named = rows.where("display IS NOT NULL")
    found, held, rest = _by_component(named, known, write)
    if not rest.isEmpty():
        rest = write(rest)
        more, also = _by_rounds(write(named.join(rest.where(F.col("kind") == NEW).select(F.col("key").alias("id")), "id", "left_semi")), known.join(rest.where(F.col("kind") == KNOWN).select(F.struct("kind", "key").alias("who")), "who", "left_semi"), write)
        found, held = found.unionByName(more), held.unionByName(also)
    own = F.struct(F.lit(NEW).alias("kind"), F.col("id").alias("key"))
    who = F.when(F.col("display").isNotNull(), F.coalesce("who", own))
    status = F.when(F.col("display").isNull(), "skipped_no_name").when((F.col("_w.kind") == NEW) & (F.col("_w.key") == F.col("id")), "created").otherwise("linked")
    links = rows.select("id", "display").join(found, "id", "left").withColumn("_w", who)
    return links.select("id", F.when(F.col("_w.kind") == KNOWN, F.col("_w.key")).alias("entity_id"), F.when(F.col("_w.kind") == NEW, F.col("_w.key")).alias("created_by"), status.alias("status")), held.select("who.kind", "who.key", "slot", "since", "v")


def _by_rounds(named: DataFrame, known: DataFrame, write: Write) -> tuple[DataFrame, DataFrame]:
    """(id, who) of the events that some entity matches, and the identifiers held, by the fixpoint."""
    identity = [*SLOTS[:-1], F.lower("display").alias("display")]
    work = write(named.select("id", *identity).groupBy(*SLOTS[:-1], "display").agg(F.min("id").alias("id")))
    values = write(_values(named, "id", "display"))
    counts = write(_counted(values))
    found = None
    while True:
        held = write(_held(_values(work, "id", "display"), _settled(work, known, write, found), known))
        found = write(_looked_up(values, counts, held, write))
        ours = work.select("id").withColumn("_in", F.lit(True))
        late = values.where(F.col("slot") != NAME).join(found, "id").join(ours, "id", "left_anti")
        filled = held.select("who", "slot", "since").join(late.groupBy("who", "slot").agg(F.count("*").alias("n")), ["who", "slot"], "right")
        unfilled = join_by_frequency(late, write(filled.select("who", "slot", "n", "since")), ["who", "slot"], "n").where(F.col("since").isNull() | (F.col("since") > F.col("id")))
        missing = write(unfilled.groupBy("who", "slot").agg(F.min("id").alias("id")).select("id").distinct())
        if missing.isEmpty():
            return found, held
        work = write(work.unionByName(named.select("id", *identity).join(missing, "id", "left_semi")))


def entity_table(links: DataFrame, held: DataFrame, entities: DataFrame, events: DataFrame, write: Write) -> tuple[DataFrame, DataFrame]:
    """(entities after the run, links with final entity ids): created entities are numbered after the known ones by their creating events."""
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0)).cast("long").alias("top"))
    created = numbered(links.where("status = 'created'").select("created_by"), [F.col("created_by")], "_n", write).crossJoin(F.broadcast(top)).select("created_by", (F.col("_n") + F.col("top")).alias("_new"))
    slots = [F.max(F.when(F.col("slot") == k, F.col("v"))).alias(f"_{c}") for k, c in enumerate(SLOTS[:-1])]
    after = held.groupBy("kind", "key").agg(*slots)
    kept = entities.join(after.where(F.col("kind") == KNOWN), entities["entity_id"] == F.col("key"), "left").select("entity_id", *[F.coalesce(c, f"_{c}").alias(c) for c in SLOTS[:-1]], "name")
    makers = events.select(F.col("id").alias("created_by"), F.col("display").alias("name"))
    made = after.where(F.col("kind") == NEW).withColumnRenamed("key", "created_by").join(created, "created_by").join(makers, "created_by").select(F.col("_new").alias("entity_id"), *[F.col(f"_{c}").alias(c) for c in SLOTS[:-1]], "name")
    final = links.join(created, "created_by", "left").select("id", F.coalesce("entity_id", "_new").alias("entity_id"), "status")
    return kept.unionByName(made), final


def counters(links: DataFrame) -> DataFrame:
    """(scanned, linked, skipped_no_name, created) of a run; linked counts creating events too."""
    count = lambda s: F.count_if(F.col("status") == s)
    return links.agg(F.count("*").alias("scanned"), (count("linked") + count("created")).alias("linked"), count("skipped_no_name").alias("skipped_no_name"), count("created").alias("created"))
