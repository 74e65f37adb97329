"""The registered queries over the sample tables, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilcount.constants import DAY_US, PURPOSES
from veilcount.functions import identity, noise, periods, text_rules
from veilcount.operators import addresses, benchmark, cohorts, consent, erasure, incremental, insights, metrics, redact, release, settle, validate
from veilcount.sources import fixtures as fx
from veilcount.sources import raw, store, tables
from veilcount.streaming import ingest as stream
from veilcount.streaming import ledger

LIMITS = {"contributors": 10, "subjects": 100, "share": 0.34}
#: When the sample's workspaces ask: in June 1998.
CLOCK = 897_000_000_000_000
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def app_metrics() -> list[metrics.Metric]:
    return [metrics.activation("purchase", 1), metrics.d7_retention(), metrics.conversion("view", "purchase", 7)]


def shop_metrics() -> list[metrics.Metric]:
    return [metrics.activation("1-urgent", 90), metrics.retention(30, 180), metrics.conversion("1-urgent", "2-high")]


def app_observations(s: SparkSession, d: str) -> DataFrame:
    return metrics.rollup(fx.app_events(s, d), fx.app_config(s), app_metrics())


def shop_observations(s: SparkSession, d: str) -> DataFrame:
    return metrics.rollup(fx.shop_events(s, d), fx.shop_config(s, d), shop_metrics(), "month")


def market_metrics() -> list[metrics.Metric]:
    return [metrics.activation("r", 30, "return_rate"), metrics.activation("n", 30)]


def market_observations(s: SparkSession, d: str) -> DataFrame:
    profiles = insights.latest_profiles(fx.market_profiles(s, d))
    return metrics.rollup(fx.market_events(s, d), profiles.select("workspace_id", "vertical"), market_metrics(), "month")


def stored(s: SparkSession, observations: DataFrame) -> DataFrame:
    """Observations through the sink: rolled up once, whoever reads them."""
    path = tables.shared_folder(s)
    tables.append_observations(observations, path)
    return tables.observations_of(s, path)


def members(s: SparkSession, d: str) -> DataFrame:
    """Workspaces that take part in the co-op, by their latest profile, and aren't barred by what they are about."""
    return validate.coop_members(insights.enrolled(fx.market_profiles(s, d)))


@query
def insights_event_counts(s: SparkSession, d: str) -> DataFrame:
    return insights.event_counts(fx.app_events(s, d))


@query
def insights_subjects(s: SparkSession, d: str) -> DataFrame:
    return insights.subjects(fx.app_events(s, d))


@query
def insights_sketched(s: SparkSession, d: str) -> DataFrame:
    """Distinct subjects by week and over all days from stored daily sketches, beside the exact counts; ``near``: within three standard errors."""
    e = fx.shop_events(s, d)
    daily = tables.saved(insights.daily_sketches(e))
    week = periods.week_label(F.unix_micros(F.col("day").cast("timestamp")))
    parts = [insights.sketched_subjects(daily), insights.sketched_subjects(daily, week)]
    exact = [insights.subjects(e.withColumn("workspace_id", F.struct("workspace_id", p.alias("period")))).select("workspace_id.*", F.col("distinct_subjects").alias("exact")) for p in (F.lit("all"), periods.week_label(F.col("at")))]
    both = _union(parts).join(_union(exact), ["workspace_id", "period"])
    return both.select("workspace_id", "period", "exact", "total_events", (F.abs(F.col("distinct_subjects") - F.col("exact")) <= F.col("exact") * 0.05 + 1).alias("near"))


@query
def period_labels(s: SparkSession, d: str) -> DataFrame:
    e = fx.shop_events(s, d)
    return e.groupBy(periods.week_label(F.col("at")).alias("week"), periods.month_label(F.col("at")).alias("month")).agg(F.count("*").alias("events"))


@query
def subject_timelines(s: SparkSession, d: str) -> DataFrame:
    t = metrics.timelines(fx.app_events(s, d))
    return t.select("workspace_id", "subject_key", "first_at", "last_at", "events", F.element_at("steps", 1)["name"].alias("first_name"))


@query
def unanimous_consent(s: SparkSession, d: str) -> DataFrame:
    f = metrics.subject_facts(fx.app_events(s, d), [metrics.d7_retention()])
    return f.groupBy("workspace_id", "consented").agg(F.count("*").alias("subjects"))


def _one_metric(events: DataFrame, m: metrics.Metric, granularity: str) -> DataFrame:
    return metrics.metric_rows(metrics.subject_facts(events, [m]), [m], granularity).drop("subjects")


@query
def activation_weekly(s: SparkSession, d: str) -> DataFrame:
    return _one_metric(fx.app_events(s, d), metrics.activation("purchase", 1), "week")


@query
def retention_d7(s: SparkSession, d: str) -> DataFrame:
    return _one_metric(fx.app_events(s, d), metrics.d7_retention(), "week")


@query
def conversion_funnel(s: SparkSession, d: str) -> DataFrame:
    return _one_metric(fx.app_events(s, d), metrics.conversion("view", "purchase", 7), "week")


@query
def custom_metric_power_users(s: SparkSession, d: str) -> DataFrame:
    """Among who has clicked: ten events or more."""
    m = metrics.Metric("power_users", 0, lambda: F.count("*") >= 10, lambda: F.min(metrics.start_column("click")).isNotNull(), "click")
    return _one_metric(fx.app_events(s, d), m, "week")


@query
def dominant_builder(s: SparkSession, d: str) -> DataFrame:
    e = fx.raw_events(s, d).where("workspace_id <> ''")
    return metrics.dominant_builders(e.withColumn("builder", validate.normalised_builder(F.col("builder"))), ["workspace_id"])


@query
def rollup_observations(s: SparkSession, d: str) -> DataFrame:
    return app_observations(s, d).withColumn("cohort_key", cohorts.cohort_string())


EVENTS = "workspace_id string, event_id string, subject_key string, name string, at long, builder string, purposes array<string>"


@query
def rollup_incremental(s: SparkSession, d: str) -> DataFrame:
    """Most events first, then a fifth of the users' others, backdated ones among them, then all of these once more."""
    e = fx.app_events(s, d).select("workspace_id", "event_id", "subject_key", "name", "at", "builder", "purposes")
    folder = tables.shared_folder(s)
    kept = incremental.Rollup(s, folder, app_metrics(), store.EventStore(s, f"{folder}/events", StructType.fromDDL(EVENTS)))
    late = (F.col("subject_key").cast("long") % 5 == 2) & (F.substring("event_id", 2, 20).cast("long") % 3 == 0)
    for batch, part in enumerate((e.where(~late), e.where(late), e.where(late))):
        kept.update(batch, part)
    return kept.observations(fx.app_config(s))


@query
def rollup_shop_observations(s: SparkSession, d: str) -> DataFrame:
    return shop_observations(s, d)


@query
def rollup_counters(s: SparkSession, d: str) -> DataFrame:
    config = fx.app_config(s).where("workspace_id not in ('ws_3', 'ws_7')")
    return metrics.rollup_counters(fx.app_events(s, d), config)


@query
def cohort_ladder(s: SparkSession, d: str) -> DataFrame:
    o = shop_observations(s, d).select(*cohorts.COHORT).distinct()
    return cohorts.ladder(o)


@query
def k_anonymity(s: SparkSession, d: str) -> DataFrame:
    v = cohorts.rung_verdicts(shop_observations(s, d), **LIMITS)
    return v.withColumn("explanation", cohorts.explanation())


@query
def narrowest_cohort(s: SparkSession, d: str) -> DataFrame:
    o = stored(s, shop_observations(s, d))
    return cohorts.narrowest(o, o, **LIMITS)


@query
def narrowest_cohort_defaults(s: SparkSession, d: str) -> DataFrame:
    o = stored(s, shop_observations(s, d))
    return cohorts.narrowest(o, o)


@query
def narrowest_cohort_low(s: SparkSession, d: str) -> DataFrame:
    """With low limits some cohorts stop before the broadest rung."""
    o = stored(s, shop_observations(s, d))
    return cohorts.narrowest(o, o, contributors=4, subjects=20, share=0.5)


@query
def cohort_attempts(s: SparkSession, d: str) -> DataFrame:
    o = stored(s, shop_observations(s, d))
    a = cohorts.attempts(o, o, contributors=4, subjects=20, share=0.5)
    return a.groupBy("breadth", "ok", "reason").agg(F.count("*").alias("attempts"), F.sum("shortfall").alias("shortfall"))


@query
def generalised_counts(s: SparkSession, d: str) -> DataFrame:
    c = insights.event_counts(fx.shop_events(s, d))
    return c.select("workspace_id", "name", noise.generalised(F.col("events")).alias("events"))


def _secret(s: SparkSession) -> DataFrame:
    return noise.secret_table(s, fx.SECRET, fx.NONCE)


@query
def noisy_mean(s: SparkSession, d: str) -> DataFrame:
    m = release.noisy_means(shop_observations(s, d), ["period", "metric"], _secret(s), 0.5)
    return m.select("period", "metric", "n", F.round("mean", 6).alias("mean"))


@query
def noisy_count(s: SparkSession, d: str) -> DataFrame:
    return release.noisy_counts(insights.event_counts(fx.app_events(s, d)), ["workspace_id", "name"], "events", _secret(s), 0.1)


@query
def dp_quantiles(s: SparkSession, d: str) -> DataFrame:
    q = release.dp_quantiles(shop_observations(s, d), ["period", "metric"], _secret(s), 0.5)
    return q.select("period", "metric", *(F.round(F.element_at("ladder", i + 1), 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))


@query
def privacy_budget(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders")
    r = o.select(F.col("o_custkey").cast("string").alias("budget_key"), F.col("o_orderkey").alias("request"), ((F.col("o_orderkey") % 7 + 1) * 0.05).alias("epsilon"))
    return release.budget_decisions(r).select("budget_key", "request", "granted")


def gated(s: SparkSession, d: str, spent: DataFrame | None = None, observations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gate for all cohorts of any builder and size, by vertical and all verticals together."""
    o = stored(s, market_observations(s, d)) if observations is None else observations
    rungs = cohorts.ladder(o).where("depth >= 2").select("workspace_id", "metric", "value", "subject_count", *cohorts.COHORT)
    asked = rungs.select(*cohorts.COHORT, "metric").distinct().withColumn("request", F.lit(1))
    head = consent.ledger_head(consent.append(fx.consent_records(s, d)))
    return release.gate(rungs, members(s, d), asked, head, fx.SECRET, fx.NONCE, epsilon=0.6, spent=spent, contributors=10, subjects=15, share=0.34)


@query
def gate_releases(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d)[0].drop("provenance_hash")


@query
def gate_suppressions(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d)[1]


@query
def gate_spends(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d)[2].select("budget_key", "epsilon")


@query
def gate_second_run(s: SparkSession, d: str) -> DataFrame:
    """The same requests again, after the first run's spends: what was released is refused now."""
    o = stored(s, market_observations(s, d))
    again = gated(s, d, gated(s, d, None, o)[2], o)
    return again[1].select(*cohorts.COHORT, "metric", "reason").unionByName(again[0].select(*cohorts.COHORT, "metric", F.lit("released").alias("reason")))


def hardened(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gate by workspaces: all verticals' cohorts first, then all verticals together, then a metric that nobody registered."""
    o = stored(s, market_observations(s, d))
    rungs = cohorts.ladder(o).where("depth >= 2").select("workspace_id", "metric", "value", "subject_count", *cohorts.COHORT)
    asked = rungs.select(*cohorts.COHORT, "metric").distinct().unionByName(rungs.select(*cohorts.COHORT, F.lit("return_rate ").alias("metric")).where("vertical = 'any'").distinct())
    # a number by cohort, narrow ones first; periods are apart from one another
    order = F.rank().over(Window.partitionBy("period").orderBy(F.col("vertical") == "any", "metric", "vertical"))
    asked = asked.withColumn("request", F.replace("period", F.lit("-")).cast("long") * 1000 + order)
    policy = release.Policy(contributors=10, subjects=15, share=0.34, most_subjects=100)
    return release.hardened_gate(rungs, members(s, d), asked, {m.name: (m.lo, m.hi) for m in market_metrics()}, fx.SECRET, fx.NONCE, policy, epsilon=0.4)


@query
def hardened_releases(s: SparkSession, d: str) -> DataFrame:
    return hardened(s, d)[0].select(*cohorts.COHORT, "metric", "request", "contributor_count", "p10", "p50", "p90", "mean")


@query
def hardened_suppressions(s: SparkSession, d: str) -> DataFrame:
    return hardened(s, d)[1]


@query
def hardened_spends(s: SparkSession, d: str) -> DataFrame:
    return hardened(s, d)[2].select("workspace_id", "period", F.round("epsilon", 6).alias("epsilon"))


@query
def release_provenance(s: SparkSession, d: str) -> DataFrame:
    return gated(s, d)[0].select(*cohorts.COHORT, "metric", "provenance_hash")


@query
def provenance_check(s: SparkSession, d: str) -> DataFrame:
    """Releases of which every other metric's median was changed afterwards."""
    out = gated(s, d)[0]
    changed = out.withColumn("p50", F.when(F.col("metric") == "return_rate", F.col("p50") + 0.000001).otherwise(F.col("p50")))
    head = consent.ledger_head(consent.append(fx.consent_records(s, d)))
    return release.unverified(changed, head).select(*cohorts.COHORT, "metric")


@query
def release_sink(s: SparkSession, d: str) -> DataFrame:
    """Both results of the gate, written and read again."""
    releases, suppressions, _ = gated(s, d)
    path = tables.shared_folder(s)
    tables.append_gated(releases, suppressions, path)
    kinds = [s.read.schema(df.schema).parquet(f"{path}/{k}").select("metric", F.lit(k).alias("kind")) for k, df in (("releases", releases), ("suppressions", suppressions))]
    return kinds[0].unionByName(kinds[1]).groupBy("kind", "metric").agg(F.count("*").alias("cohorts"))


@query
def exact_quantiles(s: SparkSession, d: str) -> DataFrame:
    o = shop_observations(s, d)
    return o.groupBy("period", "metric").agg(*(F.round(F.percentile("value", q), 6).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)))


def _exact_ladders(o: DataFrame) -> DataFrame:
    """Unnoised ladders for the comparison's own tests."""
    points = [F.round(F.percentile("value", q), 6).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return o.groupBy("period", "metric").agg(*points, F.count_distinct("workspace_id").alias("contributor_count"))


@query
def benchmark_rank(s: SparkSession, d: str) -> DataFrame:
    o = shop_observations(s, d).withColumn("value", F.round("value", 6))
    return o.join(_exact_ladders(o), ["period", "metric"]).select("workspace_id", "period", "metric", F.round(benchmark.rank(F.col("value")), 6).alias("rank"))


@query
def benchmark_compare(s: SparkSession, d: str) -> DataFrame:
    """Every workspace with the released cohort of its vertical."""
    o = stored(s, market_observations(s, d))
    own = cohorts.ladder(o).where("depth = 2").select("workspace_id", "metric", F.round("value", 6).alias("value"), *cohorts.COHORT)
    c = benchmark.compare(gated(s, d, None, o)[0], own, "rate", volume=12_345)
    return c.select("workspace_id", "period", "metric", "cohort_median", "rank", "delta", "direction", "narrative")


@query
def benchmark_request(s: SparkSession, d: str) -> DataFrame:
    """Every workspace, and one without a profile, asks about a month of its own or, without one, about that of the clock: the comparison, or why there is none."""
    o = stored(s, market_observations(s, d))
    releases, suppressions, _ = gated(s, d, None, o)
    no = F.substring("workspace_id", 3, 9).cast("int")
    who = fx.market_profiles(s, d).select("workspace_id").distinct().unionByName(s.createDataFrame([("m_9999",)], "workspace_id string"))
    period = F.when(no % 2 == 1, F.format_string("%d-%02d", 1996 + no % 4, 1 + no % 12))
    asks = who.select("workspace_id", F.explode(F.array(*(F.lit(m.name) for m in market_metrics()))).alias("metric"), period.alias("period"))
    asked = benchmark.requests(asks, fx.market_profiles(s, d), F.lit(CLOCK), depth=2)
    values = insights.latest_values(o).withColumn("value", F.round("value", 6))
    out = benchmark.answers(asked, values, releases, suppressions, "rate")
    return out.select("workspace_id", "period", "metric", "available", "cohort_median", "rank", "direction", "reason", "explanation")


@query
def observation_sink(s: SparkSession, d: str) -> DataFrame:
    """Observations written by period and metric; one metric is read again."""
    path = tables.shared_folder(s)
    tables.append_observations(shop_observations(s, d), path)
    return tables.observations_of(s, path, metrics=["activation_rate"]).groupBy("period").agg(F.count("*").alias("observations"), F.sum("subject_count").alias("subjects"))


@query
def latest_values(s: SparkSession, d: str) -> DataFrame:
    return insights.latest_values(shop_observations(s, d))


@query
def coop_contributions(s: SparkSession, d: str) -> DataFrame:
    return settle.contributions(shop_observations(s, d), "activation_rate")


def _settled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = stored(s, shop_observations(s, d))
    return settle.settle(fx.deals(s, d, o), settle.contributions(o, "activation_rate"))


@query
def coop_payouts(s: SparkSession, d: str) -> DataFrame:
    return _settled(s, d)[0]


@query
def coop_settlements(s: SparkSession, d: str) -> DataFrame:
    return _settled(s, d)[1]


@query
def validate_events(s: SparkSession, d: str) -> DataFrame:
    v = validate.validate(fx.raw_events(s, d)).where("reject_reason is null")
    return v.select("event_id", F.col("clean_name").alias("name"), F.col("clean_at").alias("at"), F.col("clean_jurisdiction").alias("jurisdiction"), F.col("clean_builder").alias("builder"))


@query
def reject_tally(s: SparkSession, d: str) -> DataFrame:
    v = validate.validate(fx.raw_events(s, d))
    return v.groupBy("workspace_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("events"))


@query
def builder_from_host(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "pages")
    host = F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), fx.pick(fx.HOSTS, F.col("page_id")))
    return p.select("page_id", text_rules.builder_of_host(host).alias("builder"))


@query
def jurisdiction_from_tz(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    zone = fx.pick(fx.ZONES, F.col("event_id"))
    return e.groupBy(text_rules.jurisdiction_of_zone(zone).alias("jurisdiction")).agg(F.count("*").alias("events"))


@query
def ip_country(s: SparkSession, d: str) -> DataFrame:
    """Event ids come twice, in two workspaces with other addresses, and some are missing."""
    e = fx.raw_events(s, d).select("workspace_id", F.nullif("event_id", F.lit("")).alias("event_id"), "ip", "ingest_seq")
    other = e.select(F.lit("other").alias("workspace_id"), "event_id", F.concat_ws(".", F.lit("10"), ((F.col("ingest_seq") + 70) % 200).cast("string"), F.lit("0.1")).alias("ip"), "ingest_seq")
    return addresses.country_of_ip(e.unionByName(other), fx.geo(s)).select("workspace_id", "event_id", "country")


@query
def ip_ranges(s: SparkSession, d: str) -> DataFrame:
    """Events' addresses of both families among ranges that overlap."""
    i = F.col("event_id")
    number = 10 * 16_777_216 + (i * 13 % 200) * 65_536 + (i * 977 % 65_536)
    e = fx.table(s, d, "events").select("event_id", fx.as_address(number, i % 3 == 0).alias("ip"))
    return addresses.country_of_ip(e, fx.nested_ranges(s, d)).select("event_id", "country")


@query
def authorised_events(s: SparkSession, d: str) -> DataFrame:
    """Events whose payload names another workspace than their key; a third of the keys isn't known."""
    keys = fx.app_config(s).where("vertical <> 'marketplace'").select(F.concat(F.lit("key-"), "workspace_id").alias("api_key"), "workspace_id")
    e = fx.app_events(s, d).select("event_id", F.lit("forged").alias("workspace_id"), F.concat(F.lit("key-"), "workspace_id").alias("api_key"))
    out = validate.attach_workspace(e, keys)
    return out.groupBy(F.coalesce("workspace_id", F.lit("unauthorized")).alias("outcome")).agg(F.count("*").alias("events"))


@query
def ingest_outcomes(s: SparkSession, d: str) -> DataFrame:
    """The whole chain of ingest in one batch: what was accepted, and why the rest wasn't."""
    out = stream.judged(fx.raw_events(s, d), stream.sample_knowledge(s, d))
    return out.groupBy("workspace_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("events"))


@query
def raw_requests(s: SparkSession, d: str) -> DataFrame:
    """Request lines read in a batch and from a stream: events by user, and what went to quarantine, by reason."""
    folder = tables.shared_folder(s)
    fx.request_lines(s, d).write.text(f"{folder}/lines")

    read = lambda lines: raw.outcomes(raw.requests(lines))
    batch, streamed = read(raw.lines(s, f"{folder}/lines")), read(raw.line_stream(s, f"{folder}/lines"))
    streamed.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    tallies = []
    for way, found in (("batch", batch), ("stream", s.read.schema(streamed.schema).parquet(f"{folder}/out"))):
        good = F.col("part") == "events"
        what, signal = F.when(good, F.col("identifier")).otherwise(F.col("reason")).alias("what"), F.when(good, F.col("opt_out")).alias("opt_out")
        total = F.sum(F.when(good, F.get_json_object("properties", "$.n").cast("long"))).alias("total")
        tallies.append(found.groupBy(F.lit(way).alias("way"), good.alias("good"), what, signal).agg(F.count("*").alias("n"), total).drop("good").select("way", "what", "opt_out", "n", "total"))
    return _union(tallies)


@query
def raw_consent(s: SparkSession, d: str) -> DataFrame:
    """Consent lines, read from files: recorded decisions by workspace, purpose and state, and what was refused."""
    folder = tables.shared_folder(s)
    lines = fx.consent_lines(s, d)
    lines.select("value").write.text(f"{folder}/lines")
    # the text's own files have no time of arrival
    asked = raw.decisions_of(raw.lines(s, f"{folder}/lines").withColumns({"at": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")}), fx.api_keys(s))
    records = consent.from_decisions(asked.where("reason is null"), fx.ROOT)
    used = records.groupBy("workspace_id", "purpose", "state").agg(F.count("*").alias("n"))
    gone = asked.where("reason is not null").groupBy(F.lit(None).cast("string").alias("workspace_id"), F.lit(None).cast("string").alias("purpose"), F.col("reason").alias("state")).agg(F.count("*").alias("n"))
    return used.unionByName(gone)


@query
def raw_erasures(s: SparkSession, d: str) -> DataFrame:
    """The same lines as requests for erasure: subjects and keys to sweep by workspace, and what was refused."""
    asked = raw.erasures_of(fx.consent_lines(s, d), fx.api_keys(s))
    wanted = asked.where("reason is null").groupBy("workspace_id", "identifier").agg(F.max("at").alias("now"))
    keys = identity.retention_keys(wanted, fx.ROOT).groupBy("workspace_id").agg(F.count_distinct("identifier").alias("subjects"), F.count("*").alias("n"))
    gone = asked.where("reason is not null").groupBy(F.col("reason").alias("workspace_id")).agg(F.lit(None).cast("long").alias("subjects"), F.count("*").alias("n"))
    return keys.unionByName(gone)


@query
def raw_deals(s: SparkSession, d: str) -> DataFrame:
    """Licences as lines, settled; refused lines with their reason."""
    o = stored(s, market_observations(s, d))
    asked = tables.saved(raw.deals_of(fx.deal_lines(s, o)))
    done = settle.settle(asked.where("reason is null"), settle.contributions(o, "return_rate"))[1]
    return done.select("deal_id", "pool_cents", F.lit(None).cast("string").alias("reason")).unionByName(asked.where("reason is not null").select("deal_id", F.lit(None).cast("long").alias("pool_cents"), "reason"))


@query
def findings_report(s: SparkSession, d: str) -> DataFrame:
    c = fx.table(s, d, "conversations")
    bag = F.to_json(F.struct(F.col("text").alias("note"), F.col("role").alias("user_email"), F.array("turn", "turn").alias("items")))
    return redact.findings_report(redact.redact_properties(c.select(F.lit("ws_0").alias("workspace_id"), bag.alias("properties"))))


@query
def insights_long(s: SparkSession, d: str) -> DataFrame:
    return insights.long_form(fx.app_events(s, d))


@query
def consent_decisions(s: SparkSession, d: str) -> DataFrame:
    return consent.from_decisions(fx.decisions(s, d), fx.ROOT).select("workspace_id", "seq", "subject_key", "purpose", "state", "jurisdiction", "notice_version")


@query
def erasure_withdrawals(s: SparkSession, d: str) -> DataFrame:
    """After erasure and withdrawal on the anchor nothing that was granted before is permitted."""
    records = consent.from_decisions(fx.decisions(s, d), fx.ROOT)
    more = erasure.withdrawn(fx.requests(s, d), fx.ROOT, F.lit(1 << 40).cast("long")).withColumn("at", F.lit(1 << 60).cast("long"))
    anchors = records.select("workspace_id", "subject_key").distinct().withColumn("jurisdiction", F.lit("US"))
    p = consent.permitted(anchors, records.unionByName(more))
    return p.groupBy("workspace_id", F.array_join("purposes", ",").alias("purposes")).agg(F.count("*").alias("subjects"))


@query
def optout_restrict(s: SparkSession, d: str) -> DataFrame:
    e = fx.app_events(s, d).withColumn("seq", F.substring("event_id", 2, 20).cast("long"))
    p = validate.restrict_opt_out(F.col("purposes"), F.col("seq") % 11 == 0)
    return e.select("event_id", F.array_join(p, ",").alias("purposes"))


@query
def redact_documents(s: SparkSession, d: str) -> DataFrame:
    t = fx.table(s, d, "documents")
    return t.select("doc_id", text_rules.redacted(F.col("text")).alias("text"))


@query
def redact_properties(s: SparkSession, d: str) -> DataFrame:
    """Conversation turns as property bags: text, a blocked key, a list and a nested object."""
    c = fx.table(s, d, "conversations")
    bag = F.to_json(F.struct(F.col("text").alias("note"), F.col("role").alias("user_email"), F.array("turn", "turn").alias("items"), F.struct(F.col("turn").alias("n"), F.col("role").alias("token")).alias("cart")))
    r = redact.redact_properties(c.select("conv_id", "turn", bag.alias("properties")))
    return r.select("conv_id", "turn", F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"), F.try_element_at("properties", F.lit("note")).alias("note"), F.try_element_at("properties", F.lit("items_count")).alias("items_count"), F.try_element_at("properties", F.lit("cart_n")).alias("cart_n"))


@query
def redaction_findings(s: SparkSession, d: str) -> DataFrame:
    parts = [("documents", "doc_id", "text"), ("conversations", "conv_id", "text"), ("pages", "page_id", "html")]
    return _union([redact.text_findings(fx.table(s, d, t), k, c).select(F.lit(t).alias("source"), "rule", "n") for t, k, c in parts])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


NAMES = ("hiv_refill_tapped", "health_check", "voted_on_poll", "therapeutic_ui_theme", "kids_mode", "race_started", "racetrack_view", "/therapy/session-notes", "page_view", "mental_health_log")


@query
def screen_events(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    named = e.select(F.col("event_id").cast("string").alias("event_id"), fx.pick(NAMES, F.col("event_id")).alias("name"), F.col("props").alias("properties"))
    return validate.screened_events(named).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query
def screen_workspaces(s: SparkSession, d: str) -> DataFrame:
    c = fx.table(s, d, "customer")
    w = c.select(F.col("c_custkey").cast("string").alias("workspace_id"), F.col("c_name").alias("app_name"), fx.pick(("an app for kids", "invoices", "prayer times", "a racetrack game"), F.col("c_custkey")).alias("description"), F.lower("c_mktsegment").alias("vertical"), fx.pick(("a.app", "dating-preference.app", "b.app"), F.col("c_custkey")).alias("hostname"))
    found = validate.screened_workspaces(w).groupBy("workspace_id").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return found.select("workspace_id", text_rules.screen_text(F.col("c")).alias("explanation"))


def _identified(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    return e.select("event_id", F.concat(F.lit("ws_"), (F.col("user_id") % 12).cast("string")).alias("workspace_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identifier"), periods.micros(e, "ts").alias("at"))


@query
def epochs(s: SparkSession, d: str) -> DataFrame:
    return fx.shop_events(s, d).groupBy(periods.epoch_of(F.col("at")).alias("epoch")).agg(F.count("*").alias("events"))


@query
def subject_keys(s: SparkSession, d: str) -> DataFrame:
    return identity.with_keys(_identified(s, d), fx.ROOT).select("workspace_id", "identifier", "epoch", "subject_key").distinct()


@query
def consent_anchors(s: SparkSession, d: str) -> DataFrame:
    return identity.with_keys(_identified(s, d), fx.ROOT).select("workspace_id", "identifier", "anchor").distinct()


@query
def retention_keys(s: SparkSession, d: str) -> DataFrame:
    return identity.retention_keys(fx.requests(s, d), fx.ROOT)


@query
def consent_chain(s: SparkSession, d: str) -> DataFrame:
    return consent.append(fx.consent_records(s, d)).select("workspace_id", "place", "seq", "hash")


@query
def consent_head(s: SparkSession, d: str) -> DataFrame:
    return consent.ledger_head(consent.append(fx.consent_records(s, d)))


@query
def consent_proofs(s: SparkSession, d: str) -> DataFrame:
    """Every lane's way to the root, and whether it leads there; one lane's head was changed afterwards."""
    lanes = consent.heads(consent.append(fx.consent_records(s, d)))
    nodes = tables.saved(consent.commitments(lanes))
    proofs = consent.inclusion_proofs(lanes, nodes)
    shown = lanes.withColumn("head", F.when(F.col("workspace_id") == "ws_5", F.lit("0" * 64)).otherwise(F.col("head")))
    ok = consent.verified_inclusion(proofs, shown, nodes.where("level = 0").select(F.col("hash").alias("head")))
    return proofs.join(ok, "workspace_id").select("workspace_id", "level", "prefix", F.array_join("children", "|").alias("children"), "included")


@query
def consent_differences(s: SparkSession, d: str) -> DataFrame:
    """Lanes that differ between two ledgers of which one was changed, from their trees alone."""
    trees = []
    for state in ("granted ", None):
        r = fx.consent_records(s, d)
        r = r if state is None else r.withColumn("state", F.when(F.col("workspace_id") == "ws_1", state).otherwise(F.col("state")))
        trees.append(tables.saved(consent.commitments(consent.heads(consent.append(r)))))
    return consent.differing_lanes(*trees).select(F.substring_index("child", ":", 1).alias("workspace_id")).distinct()


@query
def stream_ledger(s: SparkSession, d: str) -> DataFrame:
    """Two runs of one stream with a restart between them: the chain of the batch."""
    folder, r = tables.shared_folder(s), fx.consent_records(s, d)
    for part in (r.where(F.col("at") < stream.HALF), r.where(F.col("at") >= stream.HALF)):
        part.write.mode("append").parquet(f"{folder}/in")
        ledger.run_ledger(s, s.readStream.schema(r.schema).parquet(f"{folder}/in"), folder)
    return s.read.parquet(f"{folder}/chain").select("workspace_id", "place", "seq", "hash")


@query
def consent_verify(s: SparkSession, d: str) -> DataFrame:
    """A ledger in which some entries were changed afterwards."""
    chain = consent.append(fx.consent_records(s, d))
    changed = chain.withColumn("state", F.when((F.col("workspace_id") == "ws_1") & (F.col("place") == 3), "granted ").otherwise(F.col("state")))
    return consent.first_broken(changed)


@query
def consent_resolve(s: SparkSession, d: str) -> DataFrame:
    r = fx.consent_records(s, d)
    asked = fx.app_events(s, d).select("workspace_id", "subject_key", "jurisdiction").distinct().withColumn("purpose", F.explode(F.array(*map(F.lit, PURPOSES))))
    return consent.resolve(asked, r)


@query
def permitted_purposes(s: SparkSession, d: str) -> DataFrame:
    subjects = fx.app_events(s, d).select("workspace_id", "subject_key", "jurisdiction").distinct()
    p = consent.permitted(subjects, fx.consent_records(s, d))
    return p.select("workspace_id", "subject_key", F.array_join("purposes", ",").alias("purposes"))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return identity.with_keys(_identified(s, d), fx.ROOT)


@query
def erasure_remaining(s: SparkSession, d: str) -> DataFrame:
    keys = identity.retention_keys(fx.requests(s, d), fx.ROOT)
    return erasure.erase(_keyed(s, d), keys).groupBy("workspace_id").agg(F.count("*").alias("events"))


@query
def erasure_stored(s: SparkSession, d: str) -> DataFrame:
    """Events stored by day; requests of 15 January are met in the store. A day is rewritten if none of its files is as before."""
    e = _keyed(s, d).select("workspace_id", F.col("event_id").cast("string").alias("event_id"), "subject_key", "at")
    kept = store.EventStore(s, tables.shared_folder(s), e.schema)
    kept.append(e)
    files = lambda: kept.events().select("day", F.input_file_name().alias("file")).distinct()
    before = tables.saved(files())
    asked = fx.requests(s, d).withColumn("now", F.lit(1_705_276_800_000_000))
    kept.erase(identity.retention_keys(asked, fx.ROOT))
    same = before.join(files(), ["day", "file"]).select("day").distinct().withColumn("same", F.lit(True))
    return kept.events().groupBy("day").agg(F.count("*").alias("events")).join(same, "day", "left").select("day", "events", F.col("same").isNull().alias("rewritten"))


@query
def erasure_report(s: SparkSession, d: str) -> DataFrame:
    keys = identity.retention_keys(fx.requests(s, d), fx.ROOT)
    return erasure.erasure_report(_keyed(s, d).select("workspace_id", "subject_key"), keys)


@query
def withdraw_all(s: SparkSession, d: str) -> DataFrame:
    """After a withdrawal by every request nothing is permitted any more."""
    subjects = fx.app_events(s, d).where("cast(subject_key as long) % 20 = 3").groupBy("workspace_id", "subject_key", "jurisdiction").agg(F.max("at").alias("at"))
    records = fx.consent_records(s, d)
    more = consent.withdrawals(subjects, F.lit(1 << 40).cast("long"))
    p = consent.permitted(subjects.select("workspace_id", "subject_key", "jurisdiction"), records.unionByName(more))
    return p.groupBy(F.size("purposes").alias("purposes")).agg(F.count("*").alias("subjects"))


@query
def ttl_expire(s: SparkSession, d: str) -> DataFrame:
    e = fx.app_events(s, d)
    tiers = fx.app_config(s).select("workspace_id", F.when(F.col("vertical") == "b2b_saas", 5 * DAY_US).otherwise(20 * DAY_US).alias("ttl_us"))
    return erasure.expire(e, tiers, F.lit(1_706_659_200_000_000)).groupBy("workspace_id").agg(F.count("*").alias("events"))


@query
def dataset_export(s: SparkSession, d: str) -> DataFrame:
    """What the gate released, written for each deal and read again."""
    releases = gated(s, d)[0]
    path = tables.shared_folder(s)
    out = settle.delivered(releases, fx.market_deals(s, releases))
    tables.write_delivery(out, path)
    return s.read.schema(out.schema).parquet(path).select("deal_id", *cohorts.COHORT, "metric", "p50", "epsilon_spent")


@query
def dedupe_events(s: SparkSession, d: str) -> DataFrame:
    e = fx.raw_events(s, d)
    again = e.unionByName(e.where("ingest_seq % 4 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000).withColumn("name", F.lit("late_copy")))
    return validate.first_writes(again.where("event_id <> ''")).groupBy("name").agg(F.count("*").alias("events"))


@query
def latest_profiles(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders")
    p = o.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tier"))
    return insights.latest_profiles(p)


@query
def wide_timelines(s: SparkSession, d: str) -> DataFrame:
    """The scale test: every order's lines as a subject's events."""
    l = fx.table(s, d, "lineitem")
    e = l.select(F.concat(F.lit("s_"), (F.col("l_suppkey") % 50).cast("string")).alias("workspace_id"), F.col("l_orderkey").cast("string").alias("subject_key"), F.col("l_returnflag").alias("name"), periods.micros(l, "l_shipdate").alias("at"), fx.purposes(F.lit(True)).alias("purposes"))
    return _one_metric(e, metrics.activation("R", 30), "month")


@query
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    return stream.ingest_once(s, d)


@query
def stream_findings(s: SparkSession, d: str) -> DataFrame:
    return stream.findings_once(s, d)


@query
def stream_store(s: SparkSession, d: str) -> DataFrame:
    """Ingest in three batches with a withdrawal between them and late repeats, into the store."""
    e = stream.stored_once(s, d).events()
    return e.select("workspace_id", "event_id", "subject_key", "name", F.array_join("purposes", ",").alias("purposes"), "day")


@query
def consent_as_of(s: SparkSession, d: str) -> DataFrame:
    """Events by what the subject had permitted at their time."""
    records = consent.from_decisions(fx.decisions(s, d), fx.ROOT)
    e = identity.with_keys(_identified(s, d), fx.ROOT).select("event_id", "workspace_id", F.col("anchor").alias("subject_key"), F.lit("US").alias("jurisdiction"), "at")
    out = consent.permitted_at(e, records)
    return out.select("event_id", F.array_join("purposes", ",").alias("purposes"))
