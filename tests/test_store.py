"""Keyed store, landing stream and stored postings: repeats, restarts, broken writes, and what is read and written."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import postings, search, store
from tracelake.storage import new_folder
from tracelake.streaming import landing

SCHEMA = "hash string, psc string, naics string, n long"


def new_store(spark, buckets=8):
    return store.EventStore(spark, new_folder(spark, "events"), T.StructType.fromDDL(SCHEMA), columns=("psc", "naics"), buckets=buckets)


def files_of(table):
    root = table.path.removeprefix("file://") + "/rows"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_merged_once_and_blanks_are_filled(spark):
    table = new_store(spark)
    first = spark.createDataFrame([("a", None, "1", 1), ("b", " n/a ", None, 2), ("c", "x", "3", 3), (None, "x", "x", 4)], SCHEMA)
    assert table.merge(first, batch=5) == {"batch": 5, "fetched": 4, "normalized": 3, "inserted": 3, "backfilled": 0, "status": "success"}
    second = spark.createDataFrame([("a", "y", "9", 1), ("c", "z", "9", 3), ("d", "w", None, 5), ("d", "w", None, 5)], SCHEMA)
    assert table.merge(second, batch=6)["backfilled"] == 1
    want = [("a", "y", "1", 1), ("b", " n/a ", None, 2), ("c", "x", "3", 3), ("d", "w", None, 5)]
    assert sorted(map(tuple, table.rows().collect())) == want
    assert table.merge(spark.createDataFrame([("e", "e", "e", 9)], SCHEMA), batch=6)["inserted"] == 1 and sorted(map(tuple, table.rows().collect())) == want  # that number has been merged
    assert table.merge(second, batch=7) == {"batch": 7, "fetched": 4, "normalized": 3 + 1, "inserted": 0, "backfilled": 0, "status": "success"}
    assert table.merge(first.where("hash IS NULL"), batch=8)["status"] == "failed"


def test_only_touched_buckets_are_read_and_changed_ones_rewritten_without_shuffling_the_store(spark):
    table = new_store(spark, buckets=32)
    table.merge(spark.range(2000).select(F.col("id").cast("string").alias("hash"), F.lit(None).cast("string").alias("psc"), F.lit("n").alias("naics"), "id").toDF("hash", "psc", "naics", "n"), batch=0)
    before = files_of(table)
    batch = spark.createDataFrame([("7", "filled", None, 7), ("8", None, "never", 8), ("new", "x", "x", 1)], SCHEMA)
    keyed = batch.withColumn("bucket", store.bucket_of(F.col("hash"), 32))
    table.few = True
    plan = plan_of(table.present(keyed))
    assert "hashpartitioning" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:200]
    table.merge(batch, batch=1)
    after = files_of(table)
    changed = {p.split("bucket=")[1].split("/")[0] for p in before.keys() ^ after.keys() if "bucket=" in p}
    gone = {p.split("bucket=")[1].split("/")[0] for p in before.keys() - after.keys() if "bucket=" in p}
    number = lambda k: str(keyed.where(F.col("hash") == k).first()["bucket"])
    assert gone == {number("7")} and changed == {number("7"), number("new")}
    assert table.rows().count() == 2001 and table.rows().where("psc = 'filled'").count() == 1


def test_a_broken_run_leaves_a_ledger_row_and_is_done_again(spark, monkeypatch):
    table = new_store(spark)
    table.merge(spark.createDataFrame([("a", None, "1", 1), ("b", None, "2", 2)], SCHEMA), batch=0)
    batch = spark.createDataFrame([("a", "y", None, 1), ("c", "z", None, 3)], SCHEMA)
    monkeypatch.setattr(store.EventStore, "_replace", lambda self, written: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(batch, batch=1)
    assert table.ledger().where("batch = 1").first()["status"] == "aborted"
    monkeypatch.undo()
    # the buckets noted before the break take the old ones' place first, even if these are gone
    again = store.EventStore(spark, table.path, T.StructType.fromDDL(SCHEMA), columns=("psc", "naics"), buckets=8)
    assert again.merge(batch, batch=1)["status"] == "success"
    assert sorted(map(tuple, again.rows().collect())) == [("a", "y", "1", 1), ("b", None, "2", 2), ("c", "z", None, 3)]

    def broken(df):
        return df.withColumn("n", F.raise_error(F.lit("bad page")).cast("long"))

    with pytest.raises(Exception, match="bad page"):
        again.merge(batch, broken, batch=2)
    assert again.ledger().where("batch = 2").first()["status"] == "aborted"


def test_a_stream_goes_on_after_a_restart(spark, monkeypatch):
    table, folder = new_store(spark), new_folder(spark, "landing")
    root = folder.removeprefix("file://")
    os.makedirs(f"{root}/pages")

    def page(name, *rows):
        with open(f"{root}/pages/{name}.json", "w") as f:
            f.write("".join(row + "\n" for row in rows))

    def land():
        query = landing.land(landing.pages(spark, f"{folder}/pages", SCHEMA, files=1), table, f"{folder}/state")
        query.awaitTermination()

    page("1", '{"hash": "a", "n": 1}', '{"hash": "b", "psc": "p", "n": 2}', '{"hash": "a", "n": 1}', "no json")
    land()
    page("2", '{"hash": "a", "n": 1}', '{"hash": "a", "psc": "late", "n": 9}', '{"hash": "c", "n": 3}')
    merge = store.EventStore.merge

    def dies(self, *args, **kwargs):
        merge(self, *args, **kwargs)
        raise OSError("the driver is lost after the merge, before the stream has noted it")

    monkeypatch.setattr(store.EventStore, "merge", dies)
    with pytest.raises(Exception):
        land()
    monkeypatch.undo()
    land()  # the same micro-batch again
    land()  # nothing new
    assert sorted(map(tuple, table.rows().collect())) == [("a", "late", None, 1), ("b", "p", None, 2), ("c", None, None, 3)]
    ledger = [r["status"] for r in table.ledger().where("fetched > 0").orderBy("batch").collect()]  # the rest only moved the watermark
    assert ledger == ["success", "success"]


def test_a_stored_index_finds_what_a_whole_search_finds(spark):
    texts = [(i, f"word{i % 7} word{i % 11} {'rare' if i == 40 else 'common'} common", f"title{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(texts, "id long, text string, title string")
    asked = spark.createDataFrame([(1, "rare word3"), (2, "title2 word5 nothing"), (3, "")], "q long, words string")
    boosts = {"text": 1.0, "title": 2.0}
    index = postings.Postings(spark, new_folder(spark, "index"), tuple(boosts))
    assert [index.append(docs.where("id < 20")), index.append(docs.where("id < 45")), index.append(docs), index.append(docs)] == [20, 25, 15, 0]
    whole = search.fielded(docs, asked, "id", boosts, "q", "words", top=5)
    rows = lambda df: sorted((r["q"], r["place"], r["id"], r["score"]) for r in df.collect())
    assert rows(index.search(asked, boosts, "q", "words", top=5)) == rows(whole)
    # an append that broke off before its mark is written over
    docs.limit(1).select(F.lit("text").alias("field"), F.lit("ghost").alias("term"), F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("tf"), F.lit(1).alias("length"), F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=3")
    assert rows(index.search(asked, boosts, "q", "words", top=5)) == rows(whole)
    more = docs.withColumn("id", F.col("id") + 60)
    assert index.append(docs.unionByName(more)) == 60
    assert rows(index.search(asked, boosts, "q", "words", top=5)) == rows(search.fielded(docs.unionByName(more), asked, "id", boosts, "q", "words", top=5))
    assert "bucket#" in plan_of(index.search(asked, boosts, "q", "words")).split("PartitionFilters")[1][:300]


def test_snapshots_are_written_over_and_read_by_partition(spark):
    from tracelake.operators.snapshots import Snapshots

    table = Snapshots(spark, new_folder(spark, "snapshots"))
    rows = spark.createDataFrame([(i, float(i % 5), None) for i in range(50)], "id long, score double, occurred_at timestamp")
    table.freeze(rows.limit(3), "a")
    table.freeze(rows, "a")
    table.freeze(rows.where("id < 40").withColumn("score", F.when(F.col("id") == 39, 99.0).otherwise(F.col("score"))), "b")
    found = [r["id"] for r in table.items("a").orderBy("rank").collect()]
    assert found == sorted(range(50), key=lambda i: (-(i % 5), -i))
    assert table.items("b").orderBy("rank").first()["id"] == 39
    change = {r["id"]: r["change_type"] for r in table.delta("a", "b").collect()}
    assert change[45] == "removed" and change[39] == "changed" and len(change) == 50
    plan = plan_of(table.delta("a", "b"))
    assert plan.count("PartitionFilters: [") >= 2 and plan.count("snapshot_id") >= 2


def test_an_append_keeps_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(postings, "stored", lambda df, name: kept.append(name) or df)
    index = postings.Postings(spark, f"file://{tmp_path}/index", ("text",))
    assert index.append(spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None)], "id long, text string").repartition(3)) == 2 and not kept
    rows = spark.read.parquet(f"{tmp_path}/index/postings/segment=0").collect()
    assert sorted((r["term"], r["id"], r["tf"], r["length"]) for r in rows) == [("a", 1, 3, 3), ("b", 1, 1, 3)]
