"""The tree over all lanes, the ledger as a stream, the rollup by batches, and sketches."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilcount.constants import DAY_US, PURPOSES
from veilcount.operators import consent, incremental, insights, metrics
from veilcount.sources.store import SUBJECT, EventStore
from veilcount.streaming import ledger

RECORDS = "workspace_id string, seq long, subject_key string, purpose string, state string, source string, at long, jurisdiction string, notice_version string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(lanes, depth):
    level = {}
    for w, h in lanes:
        level.setdefault(sha(w)[:depth], []).append(f"{w}:{h}")
    for n in range(depth, 0, -1):
        up = {}
        for prefix, children in level.items():
            up.setdefault(prefix[: n - 1], []).append(f"{prefix}:{sha('|'.join(sorted(children)))}")
        level = up
    return sha("|".join(sorted(level[""]))) if level else sha("")


@pytest.mark.parametrize("depth", [1, 3])
def test_tree_of_lanes(spark, depth):
    lanes = [(f"ws{i}", sha(str(i))) for i in range(200)]
    df = spark.createDataFrame(lanes, "workspace_id string, head string")
    nodes = consent.commitments(df, depth)
    top = nodes.where("level = 0")
    assert top.first()["hash"] == root(lanes, depth)
    assert consent.commitments(df.where("false"), depth).count() == 0
    proofs = consent.inclusion_proofs(df, nodes, depth)
    ok = consent.verified_inclusion(proofs, df.withColumn("head", F.when(F.col("workspace_id") == "ws7", "x").otherwise(F.col("head"))), top.select(F.col("hash").alias("head")), depth)
    assert {r["workspace_id"] for r in ok.where("not included").collect()} == {"ws7"}
    assert ok.where("included").count() == 199
    # a forged inner node, and a root that isn't this one
    forged = proofs.withColumn("children", F.when((F.col("workspace_id") == "ws9") & (F.col("level") == depth - 1), F.array(F.lit("x"))).otherwise(F.col("children")))
    assert {r[0] for r in consent.verified_inclusion(forged, df, top.select(F.col("hash").alias("head")), depth).where("not included").collect()} == {"ws9"}
    assert consent.verified_inclusion(proofs, df, top.select(F.lit("0" * 64).alias("head")), depth).where("included").count() == 0


def test_differences_are_found_from_the_root_down(spark):
    lanes = [(f"ws{i}", sha(str(i))) for i in range(300)]
    other = [(w, sha("!") if w == "ws5" else h) for w, h in lanes if w != "ws9"] + [("new", sha("n"))]
    mine, theirs = (consent.commitments(spark.createDataFrame(x, "workspace_id string, head string"), 2) for x in (lanes, other))
    got = {r["child"].split(":")[0] for r in consent.differing_lanes(mine, theirs, 2).collect()}
    assert got == {"ws5", "ws9", "new"}
    assert consent.differing_lanes(mine, mine, 2).count() == 0


def test_empty_ledger_has_a_head(spark):
    chain = consent.append(spark.createDataFrame([], RECORDS))
    assert consent.ledger_head(chain).first()["head"] == sha("")


def test_stream_continues_the_chain(spark, tmp_path):
    random.seed(5)
    rows = sorted(((random.choice("ab"), i, f"s{i % 7}", random.choice(PURPOSES), random.choice(("granted", "denied")), "explicit_ui", 1000 + i // 3, "US", random.choice(("v1", None))) for i in range(90)), key=lambda r: (r[6], r[1]))
    for part in (rows[:30], rows[30:33], rows[33:]):
        spark.createDataFrame(part, RECORDS).write.mode("append").parquet(f"file://{tmp_path}/in")
        ledger.run_ledger(spark, spark.readStream.schema(RECORDS).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}")
    cut = lambda df: sorted((r["workspace_id"], r["place"], r["seq"], r["prev_hash"], r["hash"]) for r in df.collect())
    out = spark.read.parquet(f"file://{tmp_path}/chain")
    assert cut(out) == cut(consent.append(spark.createDataFrame(rows, RECORDS)))
    assert {r["broken_at"] for r in consent.first_broken(out).collect()} == {None}


EVENTS = "workspace_id string, event_id string, subject_key string, name string, at long, builder string, purposes array<string>"


def test_rollup_by_batches_is_the_whole_rollup(spark, tmp_path):
    random.seed(9)
    names, found = ("view", "purchase", "click"), []
    for i in range(600):
        w = random.choice("abc")
        t = random.randint(0, 40 * DAY_US) // DAY_US * DAY_US + random.choice((0, 1, DAY_US - 1, random.randint(0, DAY_US - 1)))
        found.append((w, f"e{i}", f"s{random.randint(0, 60)}", random.choice(names), t, random.choice(("lovable", "bolt", "unknown", None)), list(PURPOSES[: random.choice((2, 3, 3, 3, 3, 1))])))
    kinds = [metrics.activation("purchase", 2), metrics.retention(3, 9), metrics.conversion("view", "purchase", 5)]
    config = spark.createDataFrame([("a", "v1", None), ("b", "v2", "v0")], "workspace_id string, vertical string, builder string")
    kept = incremental.Rollup(spark, f"file://{tmp_path}/r", kinds, EventStore(spark, f"file://{tmp_path}/events", StructType.fromDDL(EVENTS)))
    parts = [found[:250], found[250:258], found[250:258], found[258:]]
    so_far = []
    for n, part in enumerate(parts):
        kept.update(n, spark.createDataFrame(part, EVENTS))
        so_far = sorted({(*r[:6], tuple(r[6])) for r in [*so_far, *part]}, key=str)
        whole = metrics.rollup(spark.createDataFrame([(*r[:6], list(r[6])) for r in so_far], EVENTS), config, kinds)
        for kept_now in (kept.observations(config), kept.observations(config)) if n == 1 else (kept.observations(config),):
            assert sorted(map(str, kept_now.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    # a batch that is run again changes nothing
    before = sorted(map(str, kept.observations(config).collect()))
    kept.update(3, spark.createDataFrame(parts[3], EVENTS))
    assert sorted(map(str, kept.observations(config).collect())) == before


def test_erased_subjects_leave_the_counts(spark, tmp_path):
    random.seed(10)
    rows = [(w, f"e{w}{i}", f"s{random.randint(0, 20)}", random.choice(("view", "purchase")), random.randint(0, 20 * DAY_US), "bolt", list(PURPOSES)) for w in "ab" for i in range(120)]
    rows += [("a", "last", "s1", "view", 30 * DAY_US, "bolt", list(PURPOSES))]
    kinds, config = [metrics.activation("purchase", 7)], spark.createDataFrame([("a", "v"), ("b", "v")], "workspace_id string, vertical string")
    kept = incremental.Rollup(spark, f"file://{tmp_path}/r", kinds, EventStore(spark, f"file://{tmp_path}/events", StructType.fromDDL(EVENTS)))
    kept.update(0, spark.createDataFrame(rows, EVENTS))
    gone = [("a", "s1"), ("b", "s2"), ("c", "s3")]
    keys = spark.createDataFrame(gone, "workspace_id string, subject_key string")
    for _ in range(2):
        kept.erase(1, keys)
        whole = metrics.rollup(spark.createDataFrame([r for r in rows if (r[0], r[2]) not in gone], EVENTS), config, kinds)
        assert sorted(map(str, kept.observations(config).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert kept.events.of_subjects(keys).count() == kept.facts.of_subjects(keys).count() == 0
    # the subject may come back, as a new one
    more = [("a", "again", "s1", "view", 25 * DAY_US, "bolt", list(PURPOSES))]
    kept.update(2, spark.createDataFrame(more, EVENTS))
    whole = metrics.rollup(spark.createDataFrame([r for r in rows if (r[0], r[2]) not in gone] + more, EVENTS), config, kinds)
    assert sorted(map(str, kept.observations(config).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_a_batch_leaves_other_subjects_alone(spark, tmp_path):
    rows = [("a", f"e{i}", f"s{i}", "view", i * DAY_US, "bolt", list(PURPOSES)) for i in range(30)]
    kept = incremental.Rollup(spark, f"file://{tmp_path}/r", [metrics.activation("view", 1)], EventStore(spark, f"file://{tmp_path}/events", StructType.fromDDL(EVENTS)))
    kept.update(0, spark.createDataFrame(rows, EVENTS))
    files = lambda s: {tuple(r) for r in s.events().select("day", F.input_file_name()).distinct().collect()}
    before = files(kept.facts)
    kept.update(1, spark.createDataFrame([("a", "late", "s9", "view", 2 * DAY_US, "bolt", list(PURPOSES))], EVENTS))
    # the subject's first day moved from the tenth to the third
    assert {d for d, _ in before - files(kept.facts)} == {"1970-01-10"} and {d for d, _ in files(kept.facts) - before} == {"1970-01-03"}
    assert kept.events.days_with(spark.createDataFrame([("a", "s9")], "workspace_id string, subject_key string"), SUBJECT) == ["1970-01-03", "1970-01-10"]


def test_sketches_add_up_over_days(spark):
    e = spark.range(60_000).select(F.lit("a").alias("workspace_id"), (F.col("id") % 20_000).cast("string").alias("subject_key"), (F.col("id") % 30 * F.lit(DAY_US)).alias("at"))
    daily = insights.daily_sketches(e)
    assert daily.count() == 30
    r = insights.sketched_subjects(daily).first()
    assert r["total_events"] == 60_000 and abs(r["distinct_subjects"] - 20_000) < 20_000 * 0.05
    half = {r["period"]: r["distinct_subjects"] for r in insights.sketched_subjects(daily, F.when(F.col("day") < "1970-01-16", "first").otherwise("second")).collect()}
    for period, days in (("first", range(15)), ("second", range(15, 30))):
        exact = len({i % 20_000 for i in range(60_000) if i % 30 in days})
        assert abs(half[period] - exact) < exact * 0.05
    small = insights.daily_sketches(e.where("cast(subject_key as int) < 5"))
    assert insights.sketched_subjects(small).first()["distinct_subjects"] == 5


def test_records_are_sorted_without_what_is_made_from_them(spark):
    """A lane is one task's, so its rows are sorted as narrow as they come: texts for hashes are made afterwards."""
    r = spark.range(6).select(F.lit("w").alias("workspace_id"), F.col("id").alias("seq"), F.lit("s").alias("subject_key"), F.lit("p").alias("purpose"), F.lit("granted").alias("state"), F.lit("ui").alias("source"), F.col("id").alias("at"), F.lit("EU").alias("jurisdiction"), F.lit("v").alias("notice_version"))
    whole = consent.append(r)
    above, _, below = whole._jdf.queryExecution().executedPlan().toString().partition("Sort [")
    assert "concat_ws" in above and below and "concat_ws" not in below
    first = consent.append(r.where("seq < 4"))
    later = consent.append(r.where("seq >= 4"), consent.heads(first))
    assert {x["place"]: x["hash"] for x in first.unionByName(later).collect()} == {x["place"]: x["hash"] for x in whole.collect()}
