"""Accounting by workspace: the attacks on budgets by name and on rows as units don't work on it."""

import random

import pytest
from pyspark.sql import functions as F

from veilcount.operators import accounting, cohorts, release

COHORT = {"builder": "lovable", "vertical": "b2b_saas", "size_bucket": "1k-10k", "period": "2026-W30"}
ROWS = "workspace_id string, builder string, vertical string, size_bucket string, period string, metric string, value double, subject_count long"


def obs(w, value, subjects, **cohort):
    c = COHORT | cohort
    return (w, c["builder"], c["vertical"], c["size_bucket"], c["period"], "activation_rate", value, subjects)


def one_by_one(members, requests, spent, cap):
    """The plain version: request after request."""
    used, out = dict(spent), {}
    for r, period, epsilon in sorted(requests):
        who = members[r]
        out[r] = all(used.get((w, period), 0) + epsilon <= cap for w in who)
        if out[r]:
            for w in who:
                used[w, period] = used.get((w, period), 0) + epsilon
    return out, {k: v for k, v in used.items() if v != spent.get(k, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_decide_like_one_request_after_the_other(spark, seed):
    random.seed(seed)
    sets = [random.sample("abcdefgh", random.randint(1, 4)) for _ in range(8)]
    requests = [(i, random.choice("pq"), random.choice((100, 250, 400))) for i in range(40)]
    members = {i: random.choice(sets) for i, _, _ in requests}
    spent = {("a", "p"): 300, ("b", "q"): 900}
    want, used = one_by_one(members, requests, spent, 1000)
    frame = spark.createDataFrame
    m = frame([(i, w) for i, who in members.items() for w in who * 2], "request long, workspace_id string")
    r = frame([(i, p, e / 1000) for i, p, e in requests], "request long, period string, epsilon double")
    s = frame([(w, p, e / 2000) for (w, p), e in spent.items() for _ in range(2)], "workspace_id string, period string, epsilon double")
    granted, spends = accounting.decisions(m, r, s, 1.0)
    assert {x["request"]: x["granted"] for x in granted.collect()} == want
    assert {(x["workspace_id"], x["period"]): round(x["epsilon"] * 1000) for x in spends.collect()} == {k: v - spent.get(k, 0) for k, v in used.items()}


def test_nothing_asked(spark):
    granted, spends = accounting.decisions(spark.createDataFrame([], "request long, workspace_id string"), spark.createDataFrame([], "request long, period string, epsilon double"))
    assert granted.count() == spends.count() == 0


def test_sets_have_one_name_in_any_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, "ab"), (5, "a"), (5, "b"), (5, "c")], "g int, workspace_id string")
    got = {r["g"]: r["h"] for r in df.repartition(5).groupBy("g").agg(accounting.set_hash().alias("h")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def gate(spark, rows, requests, **more):
    o = spark.createDataFrame(rows, ROWS)
    who = o.select("workspace_id").distinct()
    asked = spark.createDataFrame([(*[(COHORT | c)[k] for k in COHORT], m, i) for i, (c, m) in enumerate(requests)], "builder string, vertical string, size_bucket string, period string, metric string, request long")
    return release.hardened_gate(o, who, asked, {"activation_rate": (0.0, 1.0)}, more.pop("secret", "s"), more.pop("nonce", "n"), release.Policy(), **more)


def test_one_population_has_one_budget(spark):
    """Fifty requests at a tenth each: ten are granted, whoever asks again and under whatever name of the metric."""
    rows = [obs(f"w{i}", i / 60, 20) for i in range(60)]
    out, held, spends = gate(spark, rows, [({}, "activation_rate")] * 50 + [({}, "activation_rate" + " " * i) for i in range(1, 10)])
    assert sorted(r["request"] for r in out.collect()) == list(range(10))
    reasons = {r["request"]: r["reason"] for r in held.collect()}
    assert [reasons[i] for i in range(10, 50)] == ["privacy_budget_exhausted"] * 40 and [reasons[i] for i in range(50, 59)] == ["unknown_metric"] * 9
    assert {round(r["epsilon"], 9) for r in spends.collect()} == {1.0}
    # and the next run has nothing left
    again = gate(spark, rows, [({}, "activation_rate")], spent=spends)
    assert again[0].count() == 0


def test_rungs_that_hold_one_another_share_a_budget(spark):
    world = [obs(f"core{i}", 0.2 + i % 20 * 0.03, 40) for i in range(40)] + [obs(f"ob{i}", 0.2 + i % 20 * 0.03, 25, builder="bolt") for i in range(40)]
    world += [obs(f"os{i}", 0.2 + i % 20 * 0.03, 30, builder="v0", size_bucket="100-1k") for i in range(40)] + [obs(f"ov{i}", 0.2 + i % 20 * 0.03, 35, vertical="marketplace", size_bucket="10k-100k") for i in range(40)]
    rungs = [{}, {"builder": "any"}, {"builder": "any", "size_bucket": "any"}, {"builder": "any", "size_bucket": "any", "vertical": "any"}]
    o = cohorts.ladder(spark.createDataFrame(world, ROWS)).select(*[c.split()[0] for c in ROWS.split(", ")])
    asked = spark.createDataFrame([(*[(COHORT | r)[k] for k in COHORT], "activation_rate", i * 10 + j) for i, r in enumerate(rungs) for j in range(10)], "builder string, vertical string, size_bucket string, period string, metric string, request long")
    out, held, spends = release.hardened_gate(o, o.select("workspace_id").distinct(), asked, {"activation_rate": (0.0, 1.0)}, "s", "n", release.Policy())
    # ten answers, not forty: the narrow rung used up what its members have
    assert sorted(r["request"] for r in out.collect()) == list(range(10))
    assert {r["reason"] for r in held.collect()} == {"privacy_budget_exhausted"}
    assert max(r["epsilon"] for r in spends.collect()) == pytest.approx(1.0)


def test_rows_of_one_workspace_are_one_value(spark):
    """600 rows of one workspace among 999 others move the mean by less than the noise's scale, so one release can't tell."""
    rest = [obs(f"w{i}", i / 999, 5) for i in range(999)]
    means = {}
    for v in (0.62, 0.0):
        o = spark.createDataFrame([obs("stuffer", v, 1)] * 600 + rest, ROWS)
        each = accounting.one_value_each(o, release.KEYS)
        assert each.count() == 1000
        means[v] = each.agg(F.avg("value")).first()[0]
        trials = each.crossJoin(spark.range(60).withColumnRenamed("id", "trial"))
        noisy = release.noisy_means(trials, ["trial"], release.secret_table(spark, "s", "n"), 0.1 / 6)
        means[v, "right"] = noisy.where(F.col("mean") > 0.43).count()
    assert abs(means[0.62] - means[0.0]) < 1 / 1000
    assert abs(means[0.62, "right"] - means[0.0, "right"]) <= 6


def test_the_median_does_not_follow_a_stuffer(spark):
    rest, found = [obs(f"w{i}", i / 1000, 5) for i in range(1000)], []
    for v in (0.62, 0.2):
        each = accounting.one_value_each(spark.createDataFrame([obs("stuffer", v, 1)] * 2000 + rest, ROWS), release.KEYS)
        q = release.dp_quantiles(each, release.KEYS, release.secret_table(spark, "s", "n"), 1.0).first()["ladder"]
        found.append(q[2])
    assert abs(found[0] - found[1]) < 0.02 and abs(found[0] - 0.5) < 0.03


def test_means_are_by_subjects_and_clamped(spark):
    rows = [obs("a", 0.2, 3), obs("a", 0.8, 1), obs("a", 0.9, 0), obs("b", 9.0, 2), obs("c", None, 2)]
    got = {r["workspace_id"]: (round(r["value"], 6), r["subject_count"]) for r in accounting.one_value_each(spark.createDataFrame(rows, ROWS), release.KEYS).collect()}
    assert got == {"a": (0.35, 4), "b": (1.0, 2), "c": (0.0, 2)}


def test_limits_have_a_floor_and_refusals_are_coarse(spark):
    rows = [obs(f"w{i}", i / 9, 100) for i in range(7)]
    out, held, spends = gate(spark, rows, [({}, "activation_rate")], contributors=2, subjects=1, share=1.0)
    assert out.count() == spends.count() == 0
    assert held.first()["explanation"] == "Fewer than 10 comparable apps are missing."


def test_stamps_need_the_secret(spark):
    rows = [obs(f"w{i}", i / 60, 20) for i in range(60)]
    a, b = (gate(spark, rows, [({}, "activation_rate")], secret=s)[0].first()["stamp"] for s in ("one", "two"))
    assert a != b and len(a) == 64
