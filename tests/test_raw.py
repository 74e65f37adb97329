"""Request lines: what is read, what goes to quarantine, and why."""

import json

from pyspark.sql import functions as F

from veilcount.operators import validate
from veilcount.sources import fixtures, raw
from veilcount.streaming import ingest


def read(spark, *bodies):
    lines = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    asked = raw.requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    return asked, raw.events_of(asked)


def test_lines_that_are_no_requests(spark):
    event = {"event_id": "e"}
    bodies = ["", "   ", "{", '{"events": [}', "[]", "7", "null", "{}", {"events": None}, {"events": {}}, {"events": [event] * 500}, {"events": [event] * 501}, {"api_key": "k", "events": []}]
    asked, events = read(spark, *bodies)
    got = [(r["reason"], r["text"]) for r in raw.refused_lines(asked).collect()]
    assert sorted(x for x, _ in got) == sorted(["malformed_json"] * 2 + ["not_an_object"] * 3 + ["no_events"] * 3 + ["batch_too_large"])
    assert {t for x, t in got if x == "malformed_json"} == {"{", '{"events": [}'}
    assert events.count() == 500
    assert asked.where("reason is null").count() == 2


def test_fields_keep_their_text(spark):
    one = {"event_id": 17, "name": "view", "occurred_at": "2024-01-02", "identifier": None, "jurisdiction": {"a": 1}, "builder": True, "properties": {"a": [1, {"b": None}], "c": "é"}, "workspace_id": "forged"}
    asked, events = read(spark, {"api_key": "k1", "opt_out": True, "events": [one, None, "text", [1], {}]}, {"api_key": 5, "events": [{"event_id": "x"}]})
    rows = {(r["api_key"], r["position"]): r for r in events.collect()}
    r = rows["k1", 0]
    assert (r["event_id"], r["name"], r["identifier"], r["jurisdiction"], r["builder"], r["opt_out"], r["reason"]) == ("17", "view", None, None, "true", True, None)
    assert json.loads(r["properties"]) == one["properties"] and "workspace_id" not in events.columns
    assert [rows["k1", i]["reason"] for i in (1, 2, 3, 4)] == ["event_not_an_object"] * 3 + [None]
    assert (rows["5", 0]["event_id"], rows["5", 0]["opt_out"], rows["5", 0]["properties"]) == ("x", False, None)
    assert sorted(x["text"] for x in raw.refused_events(events).collect()) == ['"text"', "[1]", "null"]


def test_one_pass_tells_all_outcomes(spark, tmp_path):
    event = {"event_id": "e", "name": "view", "properties": {"n": 1}}
    bodies = ["", "{", "[]", "null", "{}", {"events": [event] * 501}, {"api_key": "k", "events": []}, {"api_key": "k", "opt_out": True, "events": [event, None, "text", [event], {}]}]
    asked, events = read(spark, *bodies)
    told = raw.outcomes(asked)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for part, before in (("lines_refused", raw.refused_lines(asked)), ("events_refused", raw.refused_events(events))):
        assert order(told.where(F.col("part") == part).select("reason", "text").collect()) == order(before.collect())
    good = events.where("reason is null").drop("event", "reason")
    assert order(told.where("part = 'events'").select(*good.columns).collect()) == order(good.collect()) and good.count() == 2
    assert told.count() == 5 + 3 + 2
    # a line is parsed once
    spark.createDataFrame([(json.dumps(bodies[-1]),)], raw.LINE).write.text(f"{tmp_path}/lines")
    plan = raw.outcomes(raw.requests(raw.lines(spark, f"{tmp_path}/lines")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_requests_go_through_ingest(spark):
    event = {"event_id": "e1", "name": "view", "occurred_at": "2024-01-02T03:04:05Z", "identifier": "user-1", "jurisdiction": "US", "ip": "10.1.2.3", "properties": {"email": "x@y.zz", "n": 3}}
    _, events = read(spark, {"api_key": "key-1", "events": [event, event | {"event_id": ""}]}, {"api_key": "?", "events": [event]})
    known = ingest.sample_knowledge(spark, "/root/testdata/sf0.001")
    out = ingest.judged(events.where("reason is null").drop("event", "reason").withColumn("ingest_seq", F.col("position").cast("long")), known).collect()
    assert sorted((r["workspace_id"] or "", r["reject_reason"] or "", r["country"]) for r in out) == [("", "unauthorized", "US"), ("ws_1", "", "US"), ("ws_1", "missing_event_id", "US")]


def test_a_key_registered_twice(spark):
    keys = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), (None, "x", 1)], "api_key string, workspace_id string, version int")
    e = spark.createDataFrame([("1", "k"), ("2", None), ("3", "")], "event_id string, api_key string")
    assert {r["event_id"]: r["workspace_id"] for r in validate.attach_workspace(e, keys).collect()} == {"1": "new", "2": None, "3": None}


def test_sample_lines_have_every_kind(spark):
    asked = raw.requests(fixtures.request_lines(spark, "/root/testdata/sf0.01"))
    assert {r[0] for r in asked.select("reason").distinct().collect()} == {None, "malformed_json", "not_an_object", "no_events", "batch_too_large"}


def answers(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b), i) for i, b in enumerate(bodies)], "value string, at long")


def keys(spark):
    return spark.createDataFrame([("k", "w")], "api_key string, workspace_id string")


def test_consent_lines(spark):
    good = {"api_key": "k", "identifier": "u", "purposes": {"product_analytics": False, "coop_licensing": True, "benchmark_contribution": "yes", "other": True}, "jurisdiction": None, "noticeVersion": 3}
    lines = answers(spark, good, good | {"api_key": "?"}, good | {"identifier": ""}, good | {"purposes": {"benchmark_contribution": None}}, good | {"purposes": [True]}, {"identifier": "u"}, "[1]", "{", "  ", good | {"workspace_id": "forged"})
    got = {r["at"]: r for r in raw.decisions_of(lines, keys(spark)).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {0: None, 1: "unauthorized", 2: "missing_identifier", 3: "no_purposes", 4: "no_purposes", 5: "unauthorized", 6: "not_an_object", 7: "malformed_json", 9: None}
    assert (got[0]["workspace_id"], got[0]["purposes"], got[0]["jurisdiction"], got[0]["notice_version"]) == ("w", {"product_analytics": False, "coop_licensing": True}, None, "3")
    assert got[9]["workspace_id"] == "w"


def test_erasure_lines(spark):
    lines = answers(spark, {"api_key": "k", "identifier": "u"}, {"api_key": "k", "identifier": 5, "jurisdiction": "EU"}, {"api_key": "k"}, {"identifier": "u"}, "null")
    got = {r["at"]: (r["reason"], r["identifier"], r["jurisdiction"]) for r in raw.erasures_of(lines, keys(spark)).collect()}
    assert got == {0: (None, "u", "unknown"), 1: (None, "5", "EU"), 2: ("missing_identifier", None, "unknown"), 3: ("unauthorized", "u", "unknown"), 4: ("not_an_object", None, "unknown")}


def test_deal_lines(spark):
    good = {"deal_id": "d", "gross_cents": 10, "cohort_keys": ["a", "b"]}
    lines = answers(spark, good, good | {"direct_cost_cents": 3}, good | {"direct_cost_cents": "3"}, good | {"gross_cents": None}, good | {"gross_cents": -2}, good | {"cohort_keys": "a"}, good | {"deal_id": None})
    got = {r["at"]: (r["reason"], r["direct_cost_cents"]) for r in raw.deals_of(lines).collect()}
    assert got == {0: (None, 0), 1: (None, 3), 2: ("bad_amount", None), 3: ("bad_amount", 0), 4: ("bad_amount", 0), 5: ("no_cohorts", 0), 6: ("missing_deal_id", 0)}
