"""Linking by match-or-create against a sequential fold; joins and ranks by frequency and by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import entities, keyed, linking
from tracelake.storage import stored

SLOTS = linking.SLOTS
EVENTS = "id long, source string, recipient_uei string, recipient_duns string, recipient_cage string, recipient_id string, parent_path_code string, recipient_name string, parent_path_name string, organization_type string"
ENTITIES = "entity_id long, uei string, duns string, cage string, recipient_id string, parent_code string, name string"


def fold(events, known):
    """(id -> entity, entities) by taking events one after the other; a created entity is (1, event id)."""
    held = [((0, k[0]), dict(zip(SLOTS, [*k[1:6], k[6].lower() if k[6] else None]))) for k in sorted(known)]
    out = {}
    for e in sorted(events, key=lambda e: e["id"]):
        if e["display"] is None:
            out[e["id"]] = None
            continue
        own = {s: e[s] for s in SLOTS[:-1]} | {"name": e["display"].lower()}
        hit = next((x for s in SLOTS for x in [next((h for h in held if own[s] and h[1][s] == own[s]), None)] if x), None)
        if hit is None:
            hit = ((1, e["id"]), own)
            held.append(hit)
        else:
            for s in SLOTS[:-1]:
                hit[1][s] = hit[1][s] or own[s]
        out[e["id"]] = hit[0]
    return out, held


def write(df):
    return stored(df, "linking")


def check(spark, rows, known):
    events = entities.identity(spark.createDataFrame(rows, EVENTS).repartition(3))
    table = spark.createDataFrame(known, ENTITIES)
    links, held = linking.linked(events, table, write)
    found = {r["id"]: (0, r["entity_id"]) if r["entity_id"] is not None else (1, r["created_by"]) if r["created_by"] is not None else None for r in links.collect()}
    wanted, after = fold([r.asDict() for r in events.collect()], known)
    assert found == wanted
    values = {}
    for r in held.collect():
        values.setdefault((r["kind"], r["key"]), {})[SLOTS[r["slot"]]] = r["v"]
    assert values == {who: {s: v for s, v in own.items() if v} for who, own in after}
    return links, held, events, table


def test_events_that_share_identifiers_step_by_step_are_one_entity(spark):
    rows = [(1, "A", "U1", "D1", None, None, None, "Acme", None, None), (2, "A", None, "D1", None, None, None, "Acme Inc", None, None), (3, "A", "U2", None, None, None, None, "Acme", None, None)]
    links, *_ = check(spark, rows, [])
    assert linking.counters(links).first().asDict() == {"scanned": 3, "linked": 3, "skipped_no_name": 0, "created": 1}


def test_identifiers_are_taken_up_in_order(spark):
    rows = [
        (1, "A", None, "D1", None, None, None, None, None, None),  # named by its DUNS
        (2, "A", None, "D1", "C1", None, None, "One", None, None),  # brings the CAGE code
        (3, "A", "U2", None, "C1", None, None, "Two", None, None),  # brings the UEI
        (4, "A", "U3", None, None, None, None, "duns:d1", None, None),  # by name; its UEI has no place
        (5, "A", "U3", None, None, None, None, "Three", None, None),  # so this one is new
        (6, "A", "U3", None, None, None, None, "duns:d1", None, None),  # the same identity as 4 is another entity now
        (7, entities.NOTICES, None, None, None, None, "097.ABC", None, "Navy", "OFFICE"),
        (8, entities.NOTICES, None, None, None, None, "097.abc", None, "Army", None),
        (9, "A", None, None, None, "097.ABC", None, None, None, None),
        (10, "A", None, None, None, None, "097.ABC", None, None, None),  # only notices have a parent path
    ]
    links, held, events, table = check(spark, rows, [(50, "U9", None, None, None, None, "Known")])
    names = {r["id"]: r["display"] for r in events.collect()}
    assert (names[1], names[7], names[9], names[10]) == ("DUNS:D1", "Navy", "RID:097.ABC", None)
    after, final = linking.entity_table(links, held, table, events, write)
    assert [tuple(r) for r in after.orderBy("entity_id").collect()] == [(50, "U9", None, None, None, None, "Known"), (51, "U2", "D1", "C1", None, None, "DUNS:D1"), (52, "U3", None, None, None, None, "Three"), (53, None, None, None, "097.ABC", "097.ABC", "Navy")]
    assert {r["id"]: r["entity_id"] for r in final.collect()} == {1: 51, 2: 51, 3: 51, 4: 51, 5: 52, 6: 52, 7: 53, 8: 53, 9: 53, 10: None}


@pytest.mark.parametrize("seed,few", [(1, 4), (3, 12)])
def test_linking_equals_a_sequential_fold(spark, seed, few):
    rng = random.Random(seed)
    some = lambda kind, share: f"{kind}{rng.randrange(few)}" if rng.random() < share else None
    rows = [(i, rng.choice(["A", entities.NOTICES]), some("U", 0.4), some("D", 0.3), some("C", 0.3), some("r", 0.2), some("P", 0.3), some("Name ", 0.5), some("Path ", 0.3), None) for i in range(80)]
    known = [(k, f"U{k}" if k % 2 else None, None, f"C{k}", None, None, f"NAME {k % 3}") for k in range(4)]
    check(spark, rows, known)


def test_linking_of_nothing(spark):
    none = spark.createDataFrame([], EVENTS)
    assert linking.linked(entities.identity(none), spark.createDataFrame([], ENTITIES), write)[0].count() == 0


def test_joins_by_frequency_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_FREQUENT", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(100)] + [(100, None)], "id long, k string")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k4'").withColumn("x", F.upper("k"))
    assert {(r["id"], r["x"]) for r in keyed.join_by_frequency(rows, table, ["k"], "n").collect()} == {(i, "HOT" if i % 2 else f"K{i}") for i in range(100) if i != 4}
    assert keyed.join_by_frequency(rows, table, ["k"], "n", "left").count() == 101


def test_ranks_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    ranked = keyed.numbered(rows.repartition(7), [F.col("v").desc()], "rank", write).collect()
    assert [r["v"] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted((i * 7919 % 1009 for i in range(1000)), reverse=True)
    assert sorted(r["rank"] for r in ranked) == list(range(1, 1001))


def _dense(seed, n=80):
    rng = random.Random(seed)
    some = lambda kind, share: f"{kind}{rng.randrange(12)}" if rng.random() < share else None
    return [(i, "A", some("U", 0.4), some("D", 0.3), some("C", 0.3), some("r", 0.2), None, some("Name ", 0.5), None, None) for i in range(n)]


def test_large_components_go_through_rounds_and_others_are_folded(spark, monkeypatch):
    monkeypatch.setattr(linking, "FOLD_EVENTS", 40)
    pairs = [(1000 + i, "A", f"X{i // 2}", f"Y{i}", None, None, None, f"Pair {i}", None, None) for i in range(12)]
    check(spark, _dense(3) + pairs, [(1, "U1", None, "C2", None, None, "Name 3"), (2, "X1", None, None, None, None, None), (3, None, "Z", None, None, None, "alone")])


def test_tables_written_do_not_grow_with_the_chain_of_dependence(spark):
    written = []

    def counted(df):
        written.append(1)
        return write(df)

    rows = [(i, "A", None, *((f"D{i // 2}", f"C{(i + 1) // 2}") if i % 2 else (f"D{i // 2}", f"C{(i + 1) // 2}")), None, None, f"N{i}", None, None) for i in range(40)]
    links, _ = linking.linked(entities.identity(spark.createDataFrame(rows, EVENTS)), spark.createDataFrame([], ENTITIES), counted)
    assert links.count() == 40 and len(written) <= 20
