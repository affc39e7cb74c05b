"""Operators on small hand-made inputs, and streaming against batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake import streaming
from tracelake.operators import candidates, entities, filters, lanes, merge, review, scoring, tagging
from tracelake.sources import canonical, landed

AT = dt.datetime(2024, 3, 1)


def events(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"id long, {columns}")


def test_same_field_lanes(spark):
    rows = [("AW-001", "PI-100", "DOE", "R425", "541330", "VA", "USA"), ("AW-001", "PI-100", "DOE", "R425", "541330", "VA", "USA"), ("AW-001", "PI-101", "DOE", "R425", "541330", "VA", "USA"), ("AW-002", "PI-200", "NASA", "J099", "541512", "MD", None)]
    df = events(spark, rows, "award_id string, piid string, agency_code string, psc string, naics string, state string, country string")
    found = lanes.same_field(df, ("same_award_id", "same_contract_id", "same_agency", "same_psc", "same_naics", "same_place_region"))
    got = {r["lane"]: (r["key"], r["event_count"]) for r in found.collect()}
    assert got == {"same_award_id": ("AW-001", 3), "same_contract_id": ("piid:PI-100", 2), "same_agency": ("DOE", 3), "same_psc": ("R425", 3), "same_naics": ("541330", 3), "same_place_region": ("USA:VA", 3)}
    assert {(r["correlation_key"], r["event_id"]) for r in lanes.links(df, found, ("same_contract_id",)).collect()} == {("same_contract_id|*|30|piid:PI-100", 1), ("same_contract_id|*|30|piid:PI-100", 2)}
    assert lanes.same_field(df, ("same_naics",), max_events=2).count() == 0
    assert [r["status"] for r in lanes.key_report(df, "same_naics", max_events=2).collect()] == ["capped", "below_min"]
    with pytest.raises(ValueError):
        lanes.same_field(df, ("same_naics",), min_events=1)


def test_keyword_pairs(spark):
    df = events(spark, [(["Pack:Alpha", "pack:beta"],)] * 3 + [(["pack:solo"],)] + [(["noise_pack:x", "pack:alpha"],)], "keywords array<string>")
    (r,) = lanes.keyword_pairs(df).collect()
    assert (r["k1"], r["k2"], r["c12"], r["c1"], r["c2"]) == ("pack:alpha", "pack:beta", 3, 4, 3)
    assert lanes.keyword_pairs(df, ratio=0.4, floor=0).count() == 0


def test_reconcile(spark):
    old = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], "correlation_key string, event_count long")
    new = spark.createDataFrame([("b", 3), ("c", 5), ("d", 2)], "correlation_key string, event_count long")
    assert {tuple(r) for r in lanes.reconcile(old, new).collect()} == {("a", "deleted"), ("b", "unchanged"), ("c", "updated"), ("d", "created")}
    assert {r["status"] for r in lanes.reconcile(new, new).collect()} == {"unchanged"}


NOTICE = "occurred_at timestamp, solicitation_number string, recipient_uei string, recipient_name string, agency_code string, naics string, state string"
AWARD = "occurred_at timestamp, award_id string, recipient_uei string, recipient_name string, agency_code string, naics string, state string"


def test_candidate_join_scores(spark):
    n = events(spark, [(AT, "ABC-123-456", "u1", "Acme Inc", "97", "541330", "VA"), (AT, "ZZ", None, "Beta Corp", "12", "1", "MD"), (AT, "QQ", None, "Gamma", None, None, None)], NOTICE)
    a = events(spark, [(AT - dt.timedelta(days=10), "abc123456", "U1", "ACME", "97", "541330", "VA"), (AT - dt.timedelta(days=120), "x", None, "Beta Company", "12", "1", "MD"), (AT, "y", None, "Delta", "1", "2", "DC")], AWARD)
    got = {(r["notice_id"], r["award_event_id"]): r for r in candidates.candidate_join(n, a).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1]["score"] == 100 and got[1, 1]["likely_incumbent"]
    assert got[2, 2]["score"] == 20 + 12 + 10 + 8 + 7 and got[2, 2]["evidence"] == ["recipient_name", "awarding_agency", "naics", "place_region", "time_window"]
    assert got[2, 2]["delta_days"] == 120.0


def test_evidence_counts_by_ids(spark):
    # two rows of one id: each of its joins has the evidence of both rows, as a join by ids in SQL gives it
    n = events(spark, [(AT, "ABC-123-456", None, None, "97", None, None), (AT - dt.timedelta(days=20), "ABC-123-456", None, None, None, None, None)], NOTICE).withColumn("id", F.lit(7).cast("long"))
    a = events(spark, [(AT - dt.timedelta(days=10), "abc123456", None, None, "97", None, None)], AWARD)
    scored = candidates.scored_pairs(n, a)
    found = candidates.best_pairs(scored)
    assert sorted(r["score"] for r in found.collect()) == [70, 92]
    got = {r["evidence"]: (r["pairs"], r["avg_score"], r["incumbents"]) for r in candidates.evidence_counts(found, scored).collect()}
    assert got == {"identifier_exact": (4, 81.0, 2), "awarding_agency": (2, 81.0, 1), "time_window": (2, 81.0, 1)}


def test_candidate_join_blocks_common_keys(spark):
    n = events(spark, [(AT, None, None, None, "97", "541330", None)], NOTICE)
    a = events(spark, [(AT, None, None, None, "97", "541330", None)] * 12, AWARD)
    assert candidates.candidate_join(n, a, min_score=1, max_per_key=5).count() == 0
    assert candidates.candidate_join(n, a, min_score=1).count() == 10


RULES = [{"pack": "p", "rule": "phrase", "type": "phrase", "pattern": "Data Link", "weight": 5, "fields": ["snippet", "place_text"]}, {"pack": "p", "rule": "regex", "type": "regex", "pattern": r"\brad(ar|io)\b", "weight": 12, "fields": ["snippet"]}]


def test_tagging_and_scores(spark):
    df = events(spark, [("A data LINK and a Radar", "data link"), (None, None), ("radios", "x")], "snippet string, place_text string")
    rows = {r["id"]: r for r in tagging.tag(df, RULES, ("snippet", "place_text")).collect()}
    assert [(c["rule"], c["field"], c["match"]) for c in rows[1]["clauses"]] == [("phrase", "place_text", "Data Link"), ("phrase", "snippet", "Data Link"), ("regex", "snippet", "Radar")]
    assert rows[1]["keywords"] == ["p:phrase", "p:regex"] and rows[1]["tag_score"] == 22 and rows[2]["clauses"] == [] and rows[3]["clauses"] == []
    one = spark.range(1)
    w = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    got = one.select(scoring.score_v1(w(5, 12), F.lit(0), F.lit(False)), scoring.score_v1(w(), F.lit(3), F.lit(False)), scoring.score_v1(w(4), F.lit(0), F.lit(True)), scoring.score_v2(w(9, 8, 7, 6, 5, 4, 3, 2), F.lit(0), F.lit(False), F.lit(3)), scoring.tiered_sum(w(4, 3, -2, 1), 2, 0.5)).first()
    assert list(got) == [17, 9, 14, 39 + 2 + 3, 8]


def test_pair_bonus(spark):
    rows = spark.createDataFrame([(1, 0.5, 4), (1, 0.1, 9), (2, 3.0, 2), (3, 0.9, 1)], "id long, npmi double, event_count long")
    assert {r["id"]: (r["pair_count"], r["bonus"]) for r in scoring.pair_bonus(rows).collect()} == {1: (2, 3), 2: (1, 12), 3: (1, 0)}


def test_snapshot_delta(spark):
    schema = "id string, rank int, score long"
    got = scoring.delta(spark.createDataFrame([("h1", 1, 10), ("h2", 2, 5)], schema), spark.createDataFrame([("h2", 1, 20), ("h3", 2, 7)], schema)).collect()
    assert {r["id"]: (r["change_type"], r["rank_delta"], r["score_delta"]) for r in got} == {"h1": ("removed", None, None), "h2": ("changed", -1, 15), "h3": ("new", None, None)}


def test_precision_and_acceptance(spark):
    rows = spark.createDataFrame([("s2", 1, 1, "keep"), ("s2", 2, 2, "reject"), ("s2", 3, 3, "unclear"), ("s3", 4, 1, "reject"), ("s3", 5, 2, "keep")], "snapshot string, doc_id long, rank int, decision string")
    assert {r["k"]: (r["decisive"], r["precision"]) for r in review.precision_at(rows, (1, 2, 3)).collect()} == {1: (2, 0.5), 2: (4, 0.5), 3: (4, 0.5)}
    (s,) = review.label_summary(rows).collect()
    assert s["acceptance_rate"] == 0.5 and s["items"] == 5


def test_filters_and_paging(spark):
    df = events(spark, [("A", AT, 1, ["k"], "VA", "USA"), ("a", None, None, [], "USA", "VA"), ("B", AT, 2, ["kk"], "MD", "USA")], "source string, occurred_at timestamp, entity_id long, keywords array<string>, state string, country string")
    ids = lambda **f: [r["id"] for r in filters.query_events(df, **f).collect()]
    assert ids() == [3, 1, 2] and ids(descending=False) == [2, 1, 3] and ids(limit=1, offset=1) == [1]
    assert ids(keyword="k") == [1] and ids(region="va,usa") == [1, 2] and ids(has_entity=False) == [2] and ids(exclude_source="A") == [3, 2]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("h1", None, "x"), ("h2", "n/a", "y")], "hash string, naics string, psc string")
    new = spark.createDataFrame([("h1", "1", "z"), ("h2", "2", None), ("h3", "3", "w"), ("h3", "3", "w")], "hash string, naics string, psc string")
    once = merge.upserted(old, new, ("naics", "psc"))
    assert sorted(map(tuple, once.collect())) == [("h1", "1", "x"), ("h2", "2", "y"), ("h3", "3", "w")]
    assert sorted(map(tuple, merge.upserted(once, new, ("naics", "psc")).collect())) == sorted(map(tuple, once.collect()))


def test_entity_groups(spark, tmp_path):
    rows = [("U1", None, None), (None, "D1", None), ("U1", "D1", None), (None, None, "C9"), ("U2", None, "C9"), (None, None, None)]
    df = events(spark, rows, "recipient_uei string, recipient_duns string, recipient_cage string")
    n = iter(range(1000))

    def write(t):
        path = str(tmp_path / f"t{next(n)}")
        t.write.parquet(path)
        return spark.read.parquet(path)

    got = {r["id"]: r["entity_id"] for r in entities.shared_identifier_groups(entities.identity(df), write).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_landed_feeds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/page_1.json").write_text('{"results": [{"generated_unique_award_id": "AWARD-1", "Action Date": "2024-02-29", "Recipient UEI": "abc", "naicsCode": "54-1330"}, {"Award ID": "X", "action_date": "not-a-date", "Recipient Name": " N/A "}]}')
    rows = landed.normalized_awards(landed.award_pages(spark, str(tmp_path / "a"))).orderBy("award_id").collect()
    assert rows[0]["source_record_id"] == "AWARD-1" and rows[0]["recipient_uei"] == "ABC" and rows[0]["naics"] == "541330" and rows[0]["source_url"].endswith("AWARD-1")
    assert rows[1]["occurred_at"] is None and rows[1]["source_url"] is None and rows[1]["recipient_name"] is None
    (tmp_path / "n").mkdir()
    (tmp_path / "n/page_1.json").write_text('{"opportunitiesData": [{"noticeId": "N1", "postedDate": "2018-05-04", "title": "T", "uiLink": "https://beta.sam.gov/x", "placeOfPerformance": {"city": {"name": "Bonn"}, "country": {"code": "DEU"}}}]}')
    import hashlib

    (n,) = landed.normalized_notices(landed.notice_pages(spark, str(tmp_path / "n"))).collect()
    assert n["hash"] == hashlib.sha256(b"SAM.gov:N1").hexdigest() and n["source_url"] == "https://sam.gov/x" and "DEU" in n["place_text"]
    (tmp_path / "rules.json").write_text('{"defaults": {"default_weight": 2}, "packs": [{"id": "p", "default_weight": 3, "rules": [{"id": "r", "type": "phrase", "pattern": "x"}, {"id": "s", "type": "regex", "pattern": "y", "weight": 7, "fields": ["snippet", "bad"]}]}, {"id": "off", "enabled": false, "rules": [{"id": "z", "pattern": "q", "type": "phrase"}]}]}')
    got = {r["rule"]: (r["weight"], r["weight_source"], r["fields"]) for r in landed.rule_table(spark, str(tmp_path / "rules.json")).collect()}
    assert got == {"r": (3, "pack", ["snippet", "place_text", "doc_id"]), "s": (7, "rule", ["snippet"])}
    (tmp_path / "terms.txt").write_text("# c\nalpha\n beta \nalpha\n\n")
    assert sorted(r["term"] for r in landed.term_list(spark, str(tmp_path / "terms.txt")).collect()) == ["alpha", "beta"]


def test_canonical_fields_of_odd_records(spark):
    texts = [None, "", "[1]", "not json", "{}", '{"UEI": "a", "uei": "b", "place_of_performance": {"state": {"name": "x"}, "city": " Bonn "}}', '{"naics": {"code": "54-1"}, "award": {"recipient": {"legalBusinessName": "N"}}, "officeAddress": {"city": "C"}, "placeOfPerformance": {}, "active": true}', '{"Award ID": " NaN ", "awardId": 7, "notice_id": null}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_json string")
    award = {r["id"]: r for r in canonical.award_fields(rows).collect()}
    assert len(award) == len(texts) and len(award[0].asDict()) == 33
    assert all(award[i][c] is None for i in range(5) for c in canonical.AWARD_FIELDS)
    assert award[5]["recipient_uei"] == "A" and award[5]["place_of_performance_city"] == "Bonn" and award[5]["place_of_performance_state"] is None
    assert award[6]["naics_code"] is None and award[7]["award_id"] == award[7]["document_id"] == award[7]["source_record_id"] == "7"
    notice = {r["id"]: r for r in canonical.notice_fields(rows).collect()}
    assert notice[6]["naics_code"] == "541" and notice[6]["recipient_name"] == "N" and notice[6]["place_of_performance_city"] == "C" and notice[5]["recipient_uei"] == "A"
    context = {r["id"]: r for r in canonical.context_fields(rows).collect()}
    assert context[6]["sam_active"] is True and context[6]["sam_naics_code"] == "541" and all(context[1][c] is None for c in canonical.CONTEXT_FIELDS)


def test_term_lists_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\nbeta\nalpha\nbeta\n")
    (tmp_path / "b.txt").write_text("gamma\nalpha\n")
    merged = landed.merged_terms(landed.term_list(spark, str(tmp_path / "a.txt")), landed.term_list(spark, str(tmp_path / "b.txt")))
    assert [r["term"] for r in merged.orderBy("place").collect()] == ["beta", "alpha", "gamma"]


def test_label_rows_that_are_not_valid(spark):
    rows = [("s", "1", "1", "keep", "yes"), ("s", "2", "0", "keep", None), ("s", " ", "3", None, "no"), ("s", "4", "4", "perhaps", "no"), ("s", "5", "5", "REJECT", "sure"), ("s", "6", "6", None, None), ("s", "6", "7", "keep", "n"), (None, "7", "8", "unclear", "1"), (None, "7", "9", "unclear", "1")]
    got = landed.checked_labels(spark.createDataFrame(rows, landed.LABELS)).orderBy("rank").collect()
    assert {r["rank"]: r["problem"] for r in got} == {0: "rank", 1: None, 3: "identity", 4: "decision", 5: "foia_ready", 6: "duplicate", 7: "duplicate", 8: "duplicate", 9: "duplicate"}
    assert {r["rank"]: r["foia_ready"] for r in got}[8] == "yes" and {r["rank"]: r["decision"] for r in got}[5] == "reject"


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = streaming.activity(stream, delay="60 days").writeStream.outputMode("update").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("SELECT start, event_type, max(events) AS events FROM activity GROUP BY 1, 2")
    want = batch.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("events"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_ingest_drops_repeats(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = spark.createDataFrame([("h1", AT), ("h2", AT), ("h1", AT)], "hash string, occurred_at timestamp")
    rows.write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    streaming.ingest(stream, lambda df, _: df.write.mode("append").parquet(str(out)), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["hash"] for r in spark.read.parquet(str(out)).collect()) == ["h1", "h2"]


def test_rule_table_to_tags(spark):
    texts = spark.createDataFrame([('{"defaults": {"default_weight": 2, "case_insensitive": false}, "packs": [{"id": "p", "rules": [{"id": "a", "type": "phrase", "pattern": "Acme"}, {"id": "bad", "type": "regex", "pattern": "(["}, {"id": "n", "type": "regex", "pattern": "(?P<y>20\\\\d\\\\d)", "weight": 7}]}, {"id": "off", "enabled": false, "rules": [{"id": "z", "type": "phrase", "pattern": "e"}]}]}',)], "t string")
    rules = landed.flat_rules(landed.parsed_ontologies(texts, "t"))
    df = spark.createDataFrame([(1, "Acme 2024"), (2, "acme"), (3, None)], "id long, snippet string")
    got = {r["id"]: (r["keywords"], r["tag_score"], [c["match"] for c in r["clauses"]]) for r in tagging.tag(df, rules).collect()}
    assert got == {1: (["p:a", "p:n"], 9, ["Acme", "2024"]), 2: ([], 0, []), 3: ([], 0, [])}
    spaced = spark.createDataFrame([('{"packs": [{"rules": [{"id": "a"}], "id": "p"}], "defaults": {}}',), ('{"defaults":{},"packs":[{"id":"p","rules":[{"id":"a"}]}]}',)], "t string")
    one = landed.ontology_summary(landed.parsed_ontologies(spaced, "t")).distinct().collect()
    assert [(r["packs"], r["rules"], len(r["sha256"])) for r in one] == [(1, 1, 64)]


def test_windows_and_switches():
    assert filters.posted_window(today="2024-03-31") == ("2024-03-01", "2024-03-31")
    assert filters.posted_window(posted_from="2024-01-01", posted_to="2024-01-02") == ("2024-01-01", "2024-01-02")
    for bad in ({"days": 0}, {"days": 366}, {"posted_from": "2024-01-01"}, {"days": 3, "posted_from": "2024-01-01", "posted_to": "2024-01-02"}, {"posted_from": "2024-01-03", "posted_to": "2024-01-02"}):
        with pytest.raises(ValueError):
            filters.posted_window(**bad)
    assert filters.clamped_window((None, None), "a", "b") == ("a", "b") and filters.clamped_window(("2024-01-05", "2024-02-01"), None, "2024-03-01") == ("2024-01-05", "2024-02-01")
    assert filters.any_filter(source=None, agency="") is False and filters.any_filter(uei="x")


def test_first_rows_are_the_same_in_every_order(spark):
    rows = [("k", i, [i], {"a": i}) for i in range(50)] + [(None, 1, None, None), (None, 2, None, None)]
    schema = "hash string, n int, xs array<int>, m map<string,int>"
    one, two = (merge.first_rows(spark.createDataFrame(r, schema).select("hash", "n", "xs"), "hash").collect() for r in (rows, rows[::-1]))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 2
    assert merge.first_rows(spark.createDataFrame(rows, schema), "hash", ("n",)).where("hash = 'k'").first()["n"] == 0
    assert merge.new_rows(spark.createDataFrame([("k",)], "hash string"), spark.createDataFrame(rows, schema)).count() == 1


def test_runs_skip_stages(spark):
    from tracelake.operators import linking, runs

    new = spark.createDataFrame([(1, "h1", "urgent", "U1", "Acme", AT, 5.0), (2, "h2", "calm", None, None, AT, 1.0), (3, "h1", "urgent", "U1", "Acme", AT, 5.0)], "id long, hash string, snippet string, recipient_uei string, recipient_name string, occurred_at timestamp, amount double")
    known = spark.createDataFrame([(9, "u1", None, None, None, None, "x")], "entity_id long, uei string, duns string, cage string, recipient_id string, parent_code string, name string")
    rules = [{"pack": "p", "rule": "r", "type": "phrase", "pattern": "URGENT", "weight": 4}]
    run = runs.source_run(spark.createDataFrame([("h9",)], "hash string"), new, rules, known, lane_names=("same_uei",))
    assert [(r["id"] in (1, 3), r["score"]) for r in run.snapshot.collect()] == [(True, 14)]
    assert run.ledger.first().asDict() == {"fetched": 3, "normalized": 3, "inserted": 2, "status": "success"}
    assert linking.counters(run.links).first().asDict() == {"scanned": 2, "linked": 1, "skipped_no_name": 1, "created": 0}
    bare = runs.source_run(new.limit(0).select("hash"), new, rules, known, skip=("ingest", "link", "correlate"))
    assert bare.events.count() == 3 and bare.links is None and bare.correlations is None and bare.skipped == ["ingest", "link", "correlate"] and bare.snapshot.count() == 2
    with pytest.raises(ValueError):
        runs.source_run(new, new, rules, known, skip=("nothing",))


def test_versions_and_explanations(spark):
    from tracelake.operators import surfaces

    side = lambda rows: spark.createDataFrame(rows, "id long, rank int, score int")
    r = surfaces.version_overlap(side([(1, 1, 9), (2, 2, 8), (3, 3, 7)]), side([(2, 1, 9), (4, 2, 5)]), top=2).first()
    assert tuple(r) == (1, 1, 1, 3, 2)
    kind = "b struct<clause_score:int,noise_penalty:int,pair_bonus:int,keyword_score:int,entity_bonus:int,lead_family:string>"
    rows = spark.createDataFrame([((1, 0, 0, 0, 0, None), (3, 2, 1, 1, 1, "f")), ((1, 0, 0, 0, 0, "f"), (1, 0, 0, 0, 0, "f"))], f"{kind}, t{kind[1:]}")
    got = [r[0] for r in rows.select(surfaces.delta_explanation(F.col("b"), F.col("t"), ("clause_score", "noise_penalty", "pair_bonus", "keyword_score", "entity_bonus", "lead_family"))).collect()]
    assert got == ["clauses +2; keywords +1; entity +1; pair +1", "No material score-component change."]
    with pytest.raises(ValueError):
        surfaces.query_leads(rows, sort_by="nonsense")


def test_ranks_of_a_long_ranking(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select("id", (F.pmod(F.xxhash64("id"), F.lit(50))).alias("score"), F.when(F.col("id") % 3 == 0, F.lit(AT)).alias("occurred_at"))

    def store(df):
        df.write.parquet(str(tmp_path / "ranked"))
        return spark.read.parquet(str(tmp_path / "ranked"))

    one, many = (scoring.snapshot(rows, "s", f).select("id", "rank").collect() for f in (None, store))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(many) == 5000


def test_many_terms_are_found_in_one_pass(spark, monkeypatch):
    from tracelake.operators import tagging, terms

    texts = [(1, "The quick Brown fox"), (2, None), (3, ""), (4, "ÉTÉ à la foxtrot"), (5, "x" * 10_000 + "needle")]
    words = [("fox", 1), ("FOX", 2), ("brown f", 3), ("été", 4), ("needle", 5), ("", 6), (None, 7), ("absent", 8), ("ox", 1)]
    df, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "term string, value long")
    want = {1: [1, 2, 3], 2: [], 3: [], 4: [1, 2, 4], 5: [5]}
    found = df.select("id", terms.contained(F.col("text"), table).alias("v"))
    assert {r["id"]: r["v"] for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(terms, "PART_BYTES", 40)
    assert {r["id"]: r["v"] for r in df.select("id", terms.contained(F.col("text"), table).alias("v")).collect()} == want
    assert df.select(terms.contained(F.col("text"), table.limit(0)).alias("v")).distinct().collect()[0]["v"] == []
    packs = {"a": ["fox", "quick", "zzz"], "b": [f"none{i}" for i in range(10)]}
    few = {r["id"]: r["keywords"] for r in tagging.pack_terms(df, F.col("text"), packs).collect()}
    monkeypatch.setattr(tagging, "MANY_TERMS", 5)
    assert {r["id"]: r["keywords"] for r in tagging.pack_terms(df, F.col("text"), packs).collect()} == few and few[1] == ["a:fox", "a:quick"]


def test_raw_records_are_bounded_json(spark):
    import json

    from tracelake.functions import normalize as nz

    deep = {"k": {"k": {"k": {"k": {"k": {"k": 1}}}}}}
    cases = [
        ('{"b": 1, "a": [1.5, "é", null, true]}', '{"a":[1.5,"é",null,true],"b":1}'),
        ("no json", "no json"), (None, None), ("", ""), ("[]", "[]"),
        (json.dumps({"x" * 200: deep}), json.dumps({"x" * 200: {"k": {"k": {"k": {"k": {"k": "__depth_truncated__"}}}}}}, separators=(",", ":"))),
        (json.dumps(list(range(70)) + ["x" * 60]), json.dumps([*range(32), "__truncated_items__:7", *range(39, 70), "x" * 60], separators=(",", ":"))),
        (json.dumps({f"k{i:03}": i for i in range(66)}), json.dumps({"__truncated_keys__": 2} | {f"k{i:03}": i for i in range(66) if i < 32 or i >= 34}, separators=(",", ":"))),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    assert {r["i"]: r["b"] for r in rows.select("i", nz.bounded_json(F.col("c")).alias("b")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    long = json.dumps({"note": "x" * 70_000 + "ultra_secret_widget"})
    kept = spark.createDataFrame([(long,)], "c string").select(nz.bounded_json(F.col("c")).alias("b")).first()["b"]
    assert kept.endswith('ultra_secret_widget"}') and len(json.loads(kept)["note"]) == 2048


def test_rules_that_an_engine_refuses_are_dropped_and_named(spark):
    from tracelake.operators import tagging

    rule = lambda name, pattern, **more: {"pack": "p", "rule": name, "type": "regex", "pattern": pattern, "weight": 1} | more
    rules = [rule("broken", "([a-z"), rule("null", None), rule("python only", r"(?P<a>x)(?(a)y|z)"), rule("named", r"(?P<q>['\"]).*?(?P=q)"), rule("plain", "UR"), rule("exact", "UR", case_insensitive=False), {"pack": "p", "rule": "phrase", "type": "phrase", "pattern": "([a-z", "weight": 2}]
    assert sorted(r["rule"] for r in tagging.invalid_rules(rules)) == ["broken", "null", "python only"]
    tagged = tagging.tag(spark.createDataFrame([("urgent 'now' ([a-z",)], "snippet string"), rules).first()
    assert tagged["keywords"] == ["p:named", "p:phrase", "p:plain"] and {c["match"] for c in tagged["clauses"] if c["rule"] == "named"} == {"'now'"}


def test_search_in_place_equals_search_by_postings(spark):
    import random

    from tracelake.operators import search

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(i % 57 if i else None, text(rng.randrange(9)), rng.choice([None, text(3)])) for i in range(60)]  # repeated keys, a null key, empty texts
    documents = spark.createDataFrame(docs, "id long, t string, u string").repartition(3)
    queries = spark.createDataFrame([(1, "a b"), (2, "B, a!"), (3, "zz"), (4, "c d e f"), (5, None)], "q long, text string")
    got = search.fielded(documents, queries, "id", {"t": 2.0, "u": 1.5}, "q", "text", top=4)
    want = search._by_postings(documents, queries, "id", {"t": 2.0, "u": 1.5}, "q", "text", 4, 1.2, 0.75)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("q", "id", "score", "place").collect()))


def test_search_shuffles_no_pairs_of_query_and_document(spark):
    from tracelake.operators import search

    documents = spark.range(3000).selectExpr("id", "'same words' AS t")
    queries = spark.range(500).selectExpr("id AS q", "concat('same ', id % 7) AS text")
    found = search.bm25(documents, queries, "id", "t", "q", "text", top=2)
    assert {(r["q"], r["id"]) for r in found.collect()} == {(q, i) for q in range(500) for i in (0, 1)}
    assert "Exchange hashpartitioning(q" not in found._jdf.queryExecution().executedPlan().toString()
