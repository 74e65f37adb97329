"""Stored events: first writes, erasure of some days only, consent as of a time, and keys that nobody has."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilcount.constants import DAY_US, PURPOSES
from veilcount.operators import consent, insights, validate
from veilcount.sources import filters, fixtures
from veilcount.sources.store import EVENT, SUBJECT, EventStore
from veilcount.streaming import ingest

SCHEMA = "workspace_id string, event_id string, subject_key string, at long, properties map<string, string>"


def events(spark, rows):
    return spark.createDataFrame([(w, e, k, day * DAY_US + i, {"n": e}) for i, (w, e, k, day) in enumerate(rows)], SCHEMA)


def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store", StructType.fromDDL(SCHEMA))


def files(kept):
    return {(r[0], r[1]) for r in kept.events().select("day", F.input_file_name()).distinct().collect()}


def test_filters_name_every_stored_key_and_few_others(spark):
    rows = spark.range(6000).select((F.col("id") % 3).cast("string").alias("day"), F.concat(F.lit("w"), F.col("id") % 7).alias("w"), F.col("id").alias("k"))
    small = filters.summary(rows, "day", ["w", "k"], 1 << 16, 4)
    found = filters.may_hold(small, rows.select("w", "k"), "day", ["w", "k"], 1 << 16, 4)
    assert found.join(rows, ["day", "w", "k"]).count() == 6000
    others = spark.range(10**6, 10**6 + 6000).select(F.lit("w1").alias("w"), F.col("id").alias("k"))
    # 2000 keys and 4 hashes in 65,536 bits: 0.02 % a day
    assert filters.may_hold(small, others, "day", ["w", "k"], 1 << 16, 4).count() < 30


def test_a_key_is_looked_for_in_one_word(spark):
    """A probe is a row for each key and partition, and needs no aggregate."""
    rows = spark.range(50).select(F.col("id").cast("string").alias("day"), F.col("id").alias("k"))
    small = filters.summary(rows, "day", ["k"])
    assert small.count() == 50
    assert {r["day"] for r in filters.may_hold_any(small, rows.where("k < 7"), "day", ["k"]).collect()} == {str(i) for i in range(7)}
    assert filters.may_hold_any(small.where("false"), rows, "day", ["k"]).count() == 0


def test_stored_events_are_not_judged_again(spark, tmp_path, monkeypatch):
    sf, seen, stored, plain = "/root/testdata/sf0.001", [], [], ingest.judged
    known = ingest.sample_knowledge(spark, sf)
    raw = fixtures.raw_events(spark, sf).where("event_id <> ''").withColumn("arrival_us", F.col("ingest_seq") * 1_000_000 + ingest.HALF)
    kept = EventStore(spark, f"file://{tmp_path}/store", StructType.fromDDL(ingest.CLEAN), "arrival_us")

    def judged(rows, *others):
        seen.append(rows.count())
        return plain(rows, *others)

    monkeypatch.setattr(ingest, "judged", judged)
    # after the last record of the sample's ledger
    for late in (30 * DAY_US, 70 * DAY_US):
        raw.withColumn("arrival_us", F.col("arrival_us") + late).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.store_batches(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), lambda: known, kept, f"{tmp_path}/state").awaitTermination()
        stored.append(kept.events().count())
    # the ledger is the same, so what was refused is refused again
    assert stored[0] == stored[1] > 500 and seen == [raw.count(), raw.count() - stored[0]]


def test_first_writes_win_over_batches(spark, tmp_path):
    kept = store(spark, tmp_path)
    first = events(spark, [("a", "e1", "s1", 1), ("a", "e2", "s1", 1), ("b", "e1", "s1", 2), ("a", "e1", "s9", 1), ("a", "e1", "s9", 3)])
    kept.append_once(first)
    assert sorted(r[:3] for r in kept.events().select("workspace_id", "event_id", "subject_key").collect()) == [("a", "e1", "s1"), ("a", "e2", "s1"), ("b", "e1", "s1")]
    before = files(kept)
    # the same batch again, and late repeats under other days
    kept.append_once(first)
    kept.append_once(events(spark, [("a", "e1", "s1", 700), ("b", "e1", "s1", 701)]))
    assert files(kept) == before
    kept.append_once(events(spark, [("b", "e2", "s1", 2), ("a", "e1", "s1", 9)]))
    assert kept.events().count() == 4
    assert before < files(kept)


def test_a_filter_without_its_events_does_no_harm(spark, tmp_path, monkeypatch):
    """A job that died after the filters and before the events is run again."""
    kept, batch = store(spark, tmp_path), events(spark, [("a", "e1", "s1", 1)])
    rows = batch.withColumn("day", F.lit("1970-01-02"))
    for name, keys in (("subjects", SUBJECT), ("ids", EVENT)):
        filters.summary(rows, "day", keys).write.mode("append").partitionBy("day").parquet(f"{kept.path}/{name}")
    kept.append_once(batch)
    assert kept.events().count() == 1
    assert kept.days_with(batch, EVENT) == ["1970-01-02"]


def test_erasure_rewrites_only_days_with_the_subject(spark, tmp_path):
    kept = store(spark, tmp_path)
    rows = [("a", f"e{i}", f"s{i % 5}", i // 10) for i in range(100)] + [("a", "only", "gone", 50), ("b", "x", "gone", 1), ("a", "y", "gone", 3)]
    kept.append(events(spark, rows))
    before = files(kept)
    keys = spark.createDataFrame([("a", "gone", 1), ("a", "gone", 2), ("c", "s1", 1)], "workspace_id string, subject_key string, epoch int")
    gone = {r["day"]: r["events_deleted"] for r in kept.erase(keys).collect()}
    assert gone == {"1970-01-04": 1, "1970-02-20": 1}
    after = files(kept)
    assert {d for d, _ in before - after} == set(gone) and {d for d, _ in after - before} == {"1970-01-04"}
    want = sorted((w, e, k, {"n": e}) for w, e, k, _ in rows if (w, k) != ("a", "gone"))
    assert sorted((r["workspace_id"], r["event_id"], r["subject_key"], r["properties"]) for r in kept.events().collect()) == want
    # the filters know it, and a second run finds nothing
    assert kept.days_with(keys, SUBJECT) == []
    assert kept.erase(keys).count() == 0
    assert files(kept) == after
    # an erased event may come back only as a new one
    kept.append_once(events(spark, [("a", "only", "new", 50), ("a", "e3", "s3", 50)]))
    assert kept.events(["1970-02-20"]).select("subject_key").collect()[0][0] == "new"


@pytest.mark.parametrize("replaced", [0, 1, 2])
def test_an_erasure_that_dies_is_ended_by_the_next_run(spark, tmp_path, monkeypatch, replaced):
    kept = store(spark, tmp_path)
    rows = [("a", f"e{i}", f"s{i % 3}", i // 10) for i in range(30)] + [("a", "alone", "s0", 40)]
    kept.append(events(spark, rows))
    done, plain = [], EventStore._replace

    def dies(self, rows, name):
        if len(done) == replaced:
            # between a folder's end and the new one's place
            self._delete("events/day=1970-01-02")
            raise RuntimeError
        done.append(name)
        plain(self, rows, name)

    keys = spark.createDataFrame([("a", "s0")], "workspace_id string, subject_key string")
    monkeypatch.setattr(EventStore, "_replace", dies)
    with pytest.raises(RuntimeError):
        kept.erase(keys)
    monkeypatch.setattr(EventStore, "_replace", plain)
    kept.append_once(events(spark, [("a", "e31", "s1", 1)]))
    want = sorted([(w, e) for w, e, k, _ in rows if k != "s0"] + [("a", "e31")])
    assert sorted(tuple(r) for r in kept.events().select("workspace_id", "event_id").collect()) == want
    assert kept.erase(keys).count() == 0 and kept.days_with(keys, SUBJECT) == []
    assert "1970-02-10" not in {d for d, _ in files(kept)}


def test_only_named_days_are_read(spark, tmp_path):
    kept = store(spark, tmp_path)
    kept.append(events(spark, [("a", f"e{i}", f"s{i}", i) for i in range(20)]))
    asked = spark.createDataFrame([("a", "s3"), ("a", "s7")], "workspace_id string, subject_key string")
    assert kept.days_with(asked, SUBJECT) == ["1970-01-04", "1970-01-08"]
    read = kept.events(kept.days_with(asked, SUBJECT))
    assert len(read.select(F.input_file_name()).distinct().collect()) == 2


@pytest.fixture(scope="module")
def ledger():
    random.seed(21)
    sources, names = ("explicit_ui", "explicit_ui", "gpc", "workspace_default", "regulatory_default"), ("granted", "denied", "withdrawn")
    return [("w", i, random.choice(("s1", "s2", "s3")), random.choice(PURPOSES), random.choice(names), random.choice(sources), random.randint(0, 40), "US", "v1") for i in range(300)]


RECORDS = "workspace_id string, seq long, subject_key string, purpose string, state string, source string, at long, jurisdiction string, notice_version string"


def test_states_are_the_decisions_of_every_beginning(spark, ledger):
    got = {(r["subject_key"], r["purpose"], r["at"], r["seq"]): r["state"] for r in consent.states(spark.createDataFrame(ledger, RECORDS)).collect()}
    ordered = sorted(ledger, key=lambda r: (r[6], r[1]))
    for cut in (1, 2, 5, 17, 60, 150, 300):
        now = {(r["subject_key"], r["purpose"]): r["state"] for r in consent.decisions(spark.createDataFrame(ordered[:cut], RECORDS)).collect()}
        last = {(r[2], r[3]): got[r[2], r[3], r[6], r[1]] for r in ordered[:cut]}
        assert last == now


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_consent_as_of_a_time(spark, ledger, slot):
    asks = [("w", s, j, t, i) for i, (s, j, t) in enumerate((s, j, t) for s in ("s1", "s2", "s3", "s4", None) for j in ("US", "EU") for t in (-5, 0, 3, 20, 20, 39, 40, 41, 10**9))]
    df = spark.createDataFrame(asks, "workspace_id string, subject_key string, jurisdiction string, at long, event_id int")
    got = {r["event_id"]: r["purposes"] for r in consent.permitted_at(df, spark.createDataFrame(ledger, RECORDS), slot_us=slot).collect()}
    assert len(got) == len(asks)
    for t in {a[3] for a in asks}:
        before = spark.createDataFrame([r for r in ledger if r[6] <= t], RECORDS)
        then = df.where(F.col("at") == t)
        for r in consent.permitted(then, before).select("subject_key", "jurisdiction", "purposes").distinct().collect():
            for w, s, j, at, i in asks:
                if (s, j, at) == (r["subject_key"], r["jurisdiction"], t):
                    assert got[i] == r["purposes"], (s, j, at)


def test_keys_decide_the_workspace(spark):
    raw = fixtures.raw_events(spark, "/root/testdata/sf0.001").limit(1).drop("api_key", "workspace_id", "event_id")
    forged = raw.crossJoin(spark.createDataFrame([("ws_unknown", "1", None), ("ws_unknown", "2", "nobody's"), ("ws_unknown", "3", "key-3"), ("ws_1", "4", ""), (None, "5", "key-4")], "workspace_id string, event_id string, api_key string"))
    known = ingest.sample_knowledge(spark, "/root/testdata/sf0.001")
    got = {r["event_id"]: r for r in ingest.judged(forged.withColumns({"name": F.lit("view"), "identifier": F.lit("user-1"), "occurred_at": F.lit("2024-01-02 03:04:05"), "jurisdiction": F.lit("US")}), known).collect()}
    for i in "124":
        assert (got[i]["workspace_id"], got[i]["reject_reason"], got[i]["purposes"]) == (None, "unauthorized", [])
    assert (got["3"]["workspace_id"], got["5"]["workspace_id"]) == ("ws_3", "ws_4")
    assert all(got[i]["reject_reason"] != "unauthorized" and got[i]["subject_key"] and got[i]["anchor"] for i in "35")


def test_members_opt_in_and_are_screened(spark):
    rows = [("a", 1, True, "x", "invoices"), ("a", 2, None, "x", "invoices"), ("b", 1, None, "x", "y"), ("b", 2, True, "x", "y"), ("c", 1, True, "x", "an app for kids"), ("d", 1, False, "x", "y"), ("e", 1, True, None, None)]
    p = spark.createDataFrame(rows, "workspace_id string, version int, coop_enrolled boolean, app_name string, description string").withColumns({"vertical": F.lit("b2b_saas"), "hostname": F.lit("h.app")})
    assert sorted(r[0] for r in validate.coop_members(insights.enrolled(p)).collect()) == ["b", "e"]


def test_records_and_texts_of_ingest_are_read_once(spark):
    sf = "/root/testdata/sf0.001"
    accepted = ingest.judged(fixtures.raw_events(spark, sf), ingest.sample_knowledge(spark, sf)).where("reject_reason is null")
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    # the events, the decisions, their workspaces and the ranges
    assert plan.count("Relation") == 4
    # a search for each category, not a second one in a filter
    assert plan.count("23andme") == 1
