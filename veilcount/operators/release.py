"""The release gate: consent, k-anonymity, budget, noise and provenance, in this order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.constants import BUDGET, BUDGET_TEXT, DOMINANCE_TEXT, EPSILON_PER_QUERY, MAX_CONTRIBUTOR_SHARE, MIN_CONTRIBUTORS, MIN_SUBJECTS, NO_CONSENT_TEXT, QUANTILES, UNKNOWN_METRIC_TEXT
from veilcount.functions.noise import clamp, generalised, gumbel, laplace, secret_table, uniform
from veilcount.sources.tables import saved

from .accounting import decisions, one_value_each
from .cohorts import COHORT, cohort_string, explanation, k_anonymity

KEYS = [*COHORT, "metric"]
#: Ranges of cohorts and values together that ranks are counted by, so that the broadest cohort isn't one task's, however
#: its values lie; None: as many as the session has shuffle partitions.
RANGES: int | None = None


def budget_decisions(requests: DataFrame, spent: DataFrame | None = None, budget: float = BUDGET) -> DataFrame:
    """``requests`` (budget_key, request, epsilon) with ``granted``, in the order of ``request`` within a key.

    ``spent`` (budget_key, epsilon) counts before them. A request that does not
    fit is refused and costs nothing, so that a later, smaller one may fit: a
    key's requests are read by one task, in order, without being held in
    memory. Sums are of whole billionths.
    """
    units = lambda c: F.round(F.col(c).cast("decimal(18,9)") * 1_000_000_000).cast("long")
    given = requests.select("budget_key", "request", "epsilon", units("epsilon").alias("cost"))
    if spent is None:
        given = given.withColumn("before", F.lit(0).cast("long"))
    else:
        given = given.join(spent.groupBy("budget_key").agg(F.sum(units("epsilon")).alias("before")), "budget_key", "left").fillna(0, ["before"])
    limit = round(budget * 1_000_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, 0
        for b in batches:
            granted = []
            for own, before, cost in zip(*(b[c].to_pylist() for c in ("budget_key", "before", "cost")), strict=True):
                if (own,) != key:
                    key, used = (own,), before
                granted.append(used + cost <= limit)
                used += cost if granted[-1] else 0
            kept = b.drop_columns(["before", "cost"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(granted, pa.bool_())], [*kept.schema.names, "granted"])

    in_order = given.repartition("budget_key").sortWithinPartitions("budget_key", "request")
    return in_order.mapInArrow(fold, given.drop("before", "cost").schema.add("granted", "boolean"))


def noisy_means(rows: DataFrame, keys: list[str], noise: DataFrame, epsilon: float, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(keys, n, mean): clamped values, Laplace noise of sensitivity (hi - lo) / n, clamped again."""
    if epsilon <= 0 or hi <= lo:
        raise ValueError("epsilon must be positive and hi above lo")
    low, high = F.lit(lo), F.lit(hi)
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(clamp(F.col("value"), low, high).cast("decimal(28,12)")).cast("double").alias("t"))
    u = uniform(*map(F.col, keys), F.lit("mean"))
    mean = F.col("t") / F.col("n") + laplace((high - low) / F.col("n") / F.lit(epsilon), u)
    return each.join(noise, F.lit(True)).select(*keys, "n", clamp(mean, low, high).alias("mean"))


def noisy_counts(groups: DataFrame, keys: list[str], count: str, noise: DataFrame, epsilon: float) -> DataFrame:
    u = uniform(*map(F.col, keys), F.lit("count"))
    return groups.join(noise, F.lit(True)).select(*keys, F.greatest(F.lit(0), F.floor(F.col(count) + laplace(F.lit(1 / epsilon), u) + 0.5)).cast("long").alias("noisy_count"))


def dp_quantiles(rows: DataFrame, keys: list[str], noise: DataFrame, epsilon: float, lo: float = 0.0, hi: float = 1.0, targets: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, ladder): quantiles by the exponential mechanism, sorted.

    A gap between neighbouring values weighs its width times
    exp(-epsilon * abs(rank - target) / 2); the gap of greatest log weight plus
    Gumbel noise is a draw with these weights, so one maximum replaces a
    running sum. The result is uniform within the gap. Gaps without width have
    no weight, so equal values are counted before they are ranked. Ranks are
    those within a range of values, after the counts of all lower ranges; what
    was dealt by ranges is written once, so that both see the same ones.
    A missing value counts as ``lo``, as in ``noisy_means``.
    """
    if epsilon <= 0 or hi <= lo:
        raise ValueError("epsilon must be positive and hi above lo")
    low, high = F.lit(float(lo)), F.lit(float(hi))
    z = rows.groupBy(*keys, clamp(F.col("value"), low, high).alias("z")).agg(F.count("*").alias("c"))
    z = z.repartitionByRange(*keys, "z") if RANGES is None else z.repartitionByRange(RANGES, *keys, "z")
    z = saved(z.withColumn("slot", F.spark_partition_id()))
    cohort, within = Window.partitionBy(*keys), Window.partitionBy(*keys, "slot").orderBy("z")
    counts = z.groupBy(*keys, "slot").agg(F.sum("c").alias("c"), F.min("z").alias("least"))
    up = F.coalesce(F.sum("c").over(cohort.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "slot", up.alias("lower"), F.lead("least").over(cohort.orderBy("slot")).alias("above"), F.sum("c").over(cohort).alias("n"))
    rank = F.col("lower") + F.sum("c").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = z.join(counts, [*keys, "slot"]).select(*keys, "z", "c", rank.alias("i"), F.coalesce(F.lead("z").over(within), "above").alias("next"), "n")
    own = F.struct(F.col("i").alias("i"), F.col("z").alias("a"), F.coalesce("next", high).alias("b"))
    ahead = F.struct(F.lit(0).cast("long").alias("i"), low.alias("a"), F.col("z").alias("b"))
    gaps = placed.select(*keys, "n", F.explode(F.when(F.col("i") == F.col("c"), F.array(ahead, own)).otherwise(F.array(own))).alias("g")).select(*keys, "n", "g.*").where("b > a")
    each = gaps.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in targets)))).join(noise, F.lit(True))
    draw = F.log(F.col("b") - F.col("a")) - F.lit(epsilon) * F.abs(F.col("i") - F.col("q") * F.col("n")) / 2 + gumbel(uniform(*map(F.col, keys), F.lit("gap"), F.col("q").cast("string"), F.col("i").cast("string")))
    chosen = each.groupBy(*keys, "q").agg(F.max_by(F.struct("a", "b"), draw).alias("g"))
    inside = uniform(*map(F.col, keys), F.lit("place"), F.col("q").cast("string"))
    value = clamp(F.col("g.a") + inside * (F.col("g.b") - F.col("g.a")), low, high)
    return chosen.join(noise, F.lit(True)).select(*keys, value.alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("ladder"))


def gate(observations: DataFrame, consented: DataFrame, requests: DataFrame, head: DataFrame, secret: str, nonce: str, epsilon: float = EPSILON_PER_QUERY, budget: float = BUDGET, lo: float = 0.0, hi: float = 1.0, spent: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(releases, suppressions, spends) for ``requests`` (cohort columns, metric, request).

    ``observations`` carry the cohort that they are released under;
    ``consented`` (workspace_id) is who takes part in the co-op; ``head`` has
    the ledger's commitment. Rows without consent influence nothing, not even
    the thresholds. Every request ends up in exactly one of the first two
    results. ``spends`` (budget_key, epsilon, nonce) has what this run spent;
    with all earlier ones as ``spent``, the next run goes on from there.
    Observations of cohorts that nobody asks for are left out at once; what is
    decided is written to a table, since all three results come from it.
    """
    spark = observations.sparkSession
    noise = secret_table(spark, secret, nonce)
    wanted = observations.join(requests.select(*KEYS).distinct(), KEYS, "left_semi")
    pool = wanted.join(consented.select("workspace_id").distinct(), "workspace_id", "left_semi")
    verdicts = k_anonymity(pool, KEYS, **limits)
    judged = requests.join(verdicts, KEYS, "left").withColumn("reason", F.when(F.col("ok").isNull(), "no_consented_observations").otherwise(F.col("reason")))
    fit = judged.where("ok").select(F.concat_ws("::", cohort_string(), "metric").alias("budget_key"), "request", F.lit(epsilon).alias("epsilon"))
    judgement = budget_decisions(fit, spent, budget)
    decided = judged.withColumn("budget_key", F.concat_ws("::", cohort_string(), "metric")).join(judgement.drop("epsilon"), ["budget_key", "request"], "left")
    decided = saved(decided.withColumn("reason", F.when(F.col("ok") & ~F.col("granted"), "privacy_budget_exhausted").otherwise(F.col("reason"))))
    spends = decided.where("granted").select("budget_key", F.lit(epsilon).alias("epsilon"), F.lit(nonce).alias("nonce"))
    text = F.when(F.col("reason") == "no_consented_observations", NO_CONSENT_TEXT).when(F.col("reason") == "privacy_budget_exhausted", BUDGET_TEXT).otherwise(explanation())
    suppressed = decided.where("reason is not null").select(*KEYS, "request", "reason", text.alias("explanation"))

    share = epsilon / 6
    passed = decided.where("reason is null").select(*KEYS, "request", "contributor_count", "subject_count")
    rows = pool.join(passed.select(*KEYS, "request"), KEYS)
    ladder = dp_quantiles(rows, [*KEYS, "request"], noise, share, lo, hi)
    means = noisy_means(rows, [*KEYS, "request"], noise, share, lo, hi)
    names = [f"p{int(q * 100)}" for q in QUANTILES]
    out = passed.join(ladder, [*KEYS, "request"]).join(means, [*KEYS, "request"])
    out = out.select(*KEYS, "request", generalised(F.col("contributor_count")).alias("contributor_count"), generalised(F.col("subject_count")).alias("subject_count"), *(F.round(F.element_at("ladder", i + 1), 6).alias(c) for i, c in enumerate(names)), F.round("mean", 6).alias("mean"), F.lit(epsilon).alias("epsilon_spent"))
    return out.join(F.broadcast(head), F.lit(True)).withColumn("provenance_hash", provenance(lo, hi)).drop("head"), suppressed, spends


@dataclass(frozen=True)
class Policy:
    """What no caller may go below, and how much one workspace may weigh."""

    contributors: int = MIN_CONTRIBUTORS
    subjects: int = MIN_SUBJECTS
    share: float = MAX_CONTRIBUTOR_SHARE
    cap: float = BUDGET
    most_subjects: int = 10_000


def hardened_gate(observations: DataFrame, consented: DataFrame, requests: DataFrame, registry: dict[str, tuple[float, float]], secret: str, nonce: str, policy: Policy, epsilon: float = EPSILON_PER_QUERY, spent: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gate with a workspace as what is protected: (releases, suppressions, spends), for the requests in their order.

    Against ``gate``: a workspace counts as one value, whatever it sends;
    limits may be stricter than the policy and never laxer; what is spent is
    each workspace's own and the policy's cap holds over all its releases of a
    period, so nested rungs and other names add up; metrics are those of the
    ``registry`` (name: bounds); counts are noised before they are generalised,
    on two of eight parts of epsilon, with a workspace's subjects up to
    ``most_subjects``; refusals tell a band and no exact number. ``request`` is
    a number of its own for each row of ``requests``. ``spends`` has
    (workspace_id, period, epsilon), to be passed on as ``spent``.
    """
    spark = observations.sparkSession
    limits = {"contributors": max(policy.contributors, limits.get("contributors", 0)), "subjects": max(policy.subjects, limits.get("subjects", 0)), "share": min(policy.share, limits.get("share", 1.0))}
    noise = secret_table(spark, secret, nonce)
    bounds = spark.createDataFrame([(m, float(lo), float(hi)) for m, (lo, hi) in registry.items()], "metric string, lo double, hi double")
    asked = requests.join(F.broadcast(bounds), "metric", "left")
    named = asked.where("lo is not null")
    pool = observations.join(named.select(*KEYS).distinct(), KEYS, "left_semi").join(consented.select("workspace_id").distinct(), "workspace_id", "left_semi")
    each = None
    for lo, hi in sorted(set(registry.values())):
        some = pool.where(F.col("metric").isin([m for m, b in registry.items() if b == (lo, hi)]))
        one = one_value_each(some, KEYS, lo, hi)
        each = one if each is None else each.unionByName(one)
    each = saved(each)
    judged = saved(asked.join(k_anonymity(each, KEYS, **limits), KEYS, "left").withColumn("reason", F.when(F.col("lo").isNull(), "unknown_metric").when(F.col("ok").isNull(), "no_consented_observations").otherwise(F.col("reason"))))
    fit = judged.where("reason is null").select(*KEYS, "request", F.lit(epsilon).alias("epsilon"))
    granted, spends = decisions(each.join(fit, KEYS).select("request", "workspace_id"), fit, spent, policy.cap)
    decided = saved(judged.join(granted, "request", "left").withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("granted"), "privacy_budget_exhausted").otherwise(F.col("reason"))))
    band = generalised(F.col("shortfall"))
    told = (
        F.when(F.col("reason") == "unknown_metric", UNKNOWN_METRIC_TEXT).when(F.col("reason") == "no_consented_observations", NO_CONSENT_TEXT).when(F.col("reason") == "privacy_budget_exhausted", BUDGET_TEXT).when(F.col("reason") == "contributor_dominance", DOMINANCE_TEXT)
        .otherwise(F.concat(F.when(band > 0, F.concat(band.cast("string"), F.lit(" or more"))).otherwise("Fewer than 10"), F.when(F.col("reason") == "too_few_contributors", " comparable apps are missing.").otherwise(" users are missing.")))
    )
    suppressed = decided.where("reason is not null").select(*KEYS, "request", "reason", told.alias("explanation"))

    part, keys = epsilon / 8, [*KEYS, "request"]
    passed = decided.where("reason is null").select(*keys, "population", "lo", "hi")
    rows = each.join(passed.select(*keys), KEYS)
    out = None
    for lo, hi in sorted(set(registry.values())):
        some = rows.where(F.col("metric").isin([m for m, b in registry.items() if b == (lo, hi)]))
        both = dp_quantiles(some, keys, noise, part, lo, hi).join(noisy_means(some, keys, noise, part, lo, hi), keys)
        out = both if out is None else out.unionByName(both)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.sum(F.least("subject_count", F.lit(policy.most_subjects))).alias("_s"))
    draw = lambda what, scale: laplace(F.lit(scale / part), uniform(*map(F.col, keys), F.lit(what)))
    noised = counts.join(noise, F.lit(True)).select(*keys, generalised(F.floor(F.col("_c") + draw("contributors", 1) + 0.5)).alias("contributor_count"), generalised(F.floor(F.col("_s") + draw("subjects", policy.most_subjects) + 0.5)).alias("subject_count"))
    names = [f"p{int(q * 100)}" for q in QUANTILES]
    out = passed.join(out, keys).join(noised, keys).join(noise, F.lit(True))
    out = out.select(*keys, "population", "contributor_count", "subject_count", *(F.round(F.element_at("ladder", i + 1), 6).alias(c) for i, c in enumerate(names)), F.round("mean", 6).alias("mean"), F.lit(epsilon).alias("epsilon_spent"), "lo", "hi", "prf")
    stamp = F.sha2(F.concat(F.col("prf"), F.sha2(F.concat(F.col("prf"), F.concat_ws(" ", "population", cohort_string(), "metric", number(F.col("lo")), number(F.col("hi")), F.col("contributor_count").cast("string"), F.col("subject_count").cast("string"), *(number(F.col(c)) for c in [*names, "mean", "epsilon_spent"]))), 256)), 256)
    return out.withColumn("stamp", stamp).drop("lo", "hi", "prf"), suppressed, spends


def number(c: Column) -> Column:
    """One fixed spelling of a published number, from whole millionths."""
    units = F.round(c * 1_000_000).cast("long")
    size = F.abs(units)
    return F.concat(F.when(units < 0, "-").otherwise(""), F.floor(size / 1_000_000).cast("string"), F.lit("."), F.lpad((size % 1_000_000).cast("string"), 6, "0"))


def provenance(lo: float = 0.0, hi: float = 1.0) -> Column:
    """Hash over the ledger's head, the cohort, the metric, its bounds and every published number."""
    parts = [F.col("head"), cohort_string(), F.col("metric"), F.lit(f"{lo:.6f}"), F.lit(f"{hi:.6f}"), F.col("contributor_count").cast("string"), F.col("subject_count").cast("string"), *(number(F.col(f"p{int(q * 100)}")) for q in QUANTILES), number(F.col("mean")), number(F.col("epsilon_spent"))]
    return F.sha2(F.concat_ws(" ", *parts), 256)


def unverified(releases: DataFrame, head: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Releases whose stamp doesn't match their numbers."""
    again = releases.join(F.broadcast(head), F.lit(True)).withColumn("_again", provenance(lo, hi))
    return again.where("_again <> provenance_hash").drop("_again", "head")
