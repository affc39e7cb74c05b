"""Version 3 scores, gates and exports on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import quality, relevance
from tracelake.sources import exports

EVENT = "id long, clauses array<struct<pack:string,rule:string,weight:int>>, keywords array<string>, links array<struct<lane:string,key:string>>, pairs array<struct<k1:string,k2:string>>, pair_bonus int"


def test_version_3(spark):
    rows = [
        (1, [("sam_proxy_a", "x", 2)], ["sam_proxy_a:x", "sam_dod_b:y"], [("same_doc_id", "k")], [("sam_proxy_a:x", "sam_dod_b:y")], 9),
        (2, [("operational_noise_terms", "admin_facility_ops_noise", 1)], ["place:here"], None, None, 0),
        (3, None, None, None, None, 0),
    ]
    has = relevance.Context({n: F.lit(True) for n in ("id", "url", "agency", "time")})
    got = {r["id"]: r for r in relevance.score_v3(spark.createDataFrame(rows, EVENT), has, metadata=F.lit(False)).collect()}
    one, two, three = (got[k] for k in (1, 2, 3))
    # 6 for the clause, 1 for the second keyword (the first repeats the clause's rule), 1 for the second pack
    assert (one["proxy_relevance"], one["pair_bonus_applied"], one["ranking_tier"]) == (8, 5, "highest")
    assert [tuple(s) for s in one["top_positives"]] == [(6, "sam_proxy_a:x"), (1, "sam_dod_b:y")]
    # a suppressed, uncorroborated event: 4 for the clause, 4 uncorroborated, 2 routine
    assert (two["proxy_relevance"], two["noise_penalty"], two["ranking_tier"], two["investigability"]) == (0, 10, "context_only", 2)
    assert (three["score"], three["ranking_tier"], three["gate_penalty"]) == (2, "context_only", 0)


def test_gates(spark):
    metrics = quality.long_metrics(spark.createDataFrame([(5.0, None)], "a double, b double"))
    rows = [("a", ">=", 9, "volume", "error", True), ("b", ">", 0, "time", "warning", False)]
    ok = lambda p: {r["metric"]: r["ok"] for r in quality.checked(metrics, p).collect()}
    assert ok(quality.policy(spark, rows)) == {"a": False, "b": False}
    assert ok(quality.policy(spark, rows, {"a": 5})) == {"a": True, "b": False}
    with pytest.raises(ValueError):
        quality.policy(spark, rows, {"c": 1})


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"']), (2, None)], "id long, words array<string>")
    exports.write_both(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "out/json")).collect())) == sorted(map(tuple, df.collect()))
    assert {r["words"] for r in spark.read.csv(str(tmp_path / "out/csv"), header=True, escape='"').collect()} == {'["a","b\\""]', None}


def test_places_are_not_sent_to_every_task(spark, tmp_path, monkeypatch):
    places = spark.range(1000).selectExpr("id", "'general' AS family", "'primary' AS role")
    leads = spark.createDataFrame([(5, 1, "2024-01-01"), (2000, 2, "2024-01-02")], "id long, rank int, occurred_at string").withColumn("occurred_at", F.to_timestamp("occurred_at"))
    written = []
    monkeypatch.setattr(exports, "write_both", lambda df, *a: written.append(df))
    exports.export_snapshot(leads, str(tmp_path), places, "general")
    assert [r["id"] for r in written[0].collect()] == [5]
    assert "BroadcastHashJoin" not in written[0]._jdf.queryExecution().executedPlan().toString()
