"""Subject metrics and their rollup into observations.

All workspaces, periods and metrics come out of one shuffle by (workspace,
subject), dealt to as many tasks as the number of events asks for: one
aggregate turns a subject's events into flags, and a second, pre-aggregated one
counts flags by workspace and period. Only where a metric asks for it, window
minima over the same keys give each event its subject's first one and the
starts of funnels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.constants import DAY_US, PURPOSES
from veilcount.functions.periods import period_label, size_bucket
from veilcount.sources.tables import dealt, saved

SUBJECT = ["workspace_id", "subject_key"]


@dataclass(frozen=True)
class Metric:
    """``starts``: event whose first time opens a funnel, if any. ``flags(d)`` gives two aggregates over a subject's
    events, whether it qualifies and whether it succeeded; ``d`` has columns name, at, first_at and start_at. ``by_first``:
    whether they use first_at; those that don't, and start nothing, need no sort."""

    name: str
    maturity_days: int
    succeeded: Callable[[], Column]
    qualifies: Callable[[], Column] = lambda: F.lit(True)
    starts: str | None = None
    lo: float = 0.0
    hi: float = 1.0
    by_first: bool = True


def first_of(event: str, after: Column | None = None) -> Column:
    hit = F.col("name") == event
    return F.min(F.when(hit if after is None else hit & (F.col("at") >= after), F.col("at")))


def activation(event: str, within_days: int = 7, name: str = "activation_rate") -> Metric:
    """The event within so many days of the subject's first one, the bound included."""
    return Metric(name, within_days, lambda: F.coalesce(first_of(event) - F.min("at") <= within_days * DAY_US, F.lit(False)), by_first=False)


def retention(from_day: int, to_day: int, name: str | None = None) -> Metric:
    """Any event on a day of the range, counted from the subject's first."""
    day = F.floor((F.col("at") - F.col("first_at")) / F.lit(DAY_US))
    return Metric(name or f"d{to_day}_retention", to_day + 1, lambda: F.bool_or(day.between(from_day, to_day)))


def d7_retention() -> Metric:
    return retention(5, 9, "d7_retention")


def conversion(start: str, to: str, within_days: int | None = None, name: str | None = None) -> Metric:
    """From the first ``start`` to a later (or simultaneous) ``to``; who never started is not counted."""
    begin = F.col(start_column(start))

    def done() -> Column:
        end = first_of(to, begin)
        return F.coalesce(end.isNotNull() if within_days is None else end - F.min(begin) <= within_days * DAY_US, F.lit(False))

    return Metric(name or f"{start}_to_{to}_conversion", within_days or 0, done, lambda: F.min(begin).isNotNull(), start)


def start_column(name: str) -> str:
    """The column of the first time of the event that opens a funnel; another one for every name."""
    return f"start_{name.encode().hex()}"


def subject_facts(events: DataFrame, metrics: list[Metric], purpose: str = PURPOSES[1], now: int | None = None) -> DataFrame:
    """One row for each subject: first_at, last_at, events, consented, now_at, and qualifies_/succeeded_ of each metric.

    ``events``: workspace_id, subject_key, name, at (microseconds) and purposes.
    A subject is consented only if every event carries the purpose. The clock
    is ``now``, or the workspace's latest event.
    """
    mine = Window.partitionBy(*SUBJECT)
    given = dealt(events.select(*SUBJECT, "name", "at", F.array_contains("purposes", purpose).alias("_agreed")), *SUBJECT)
    if any(m.by_first for m in metrics):
        given = given.withColumn("first_at", F.min("at").over(mine))
    for start in sorted({m.starts for m in metrics if m.starts}):
        given = given.withColumn(start_column(start), F.min(F.when(F.col("name") == start, F.col("at"))).over(mine))
    flags = [c for i, m in enumerate(metrics) for c in (m.qualifies().alias(f"q{i}") if m.starts else F.lit(True).alias(f"q{i}"), m.succeeded().alias(f"s{i}"))]
    aggregates = [c for c in flags]
    facts = given.groupBy(*SUBJECT).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"),
        F.bool_and("_agreed").alias("consented"), *aggregates,
    )
    if now is not None:
        return facts.withColumn("now_at", F.lit(now))
    facts = saved(facts)
    # the clock comes from all events, before consent is looked at
    clock = saved(facts.groupBy("workspace_id").agg(F.max("last_at").alias("now_at")))
    return facts.join(clock, "workspace_id")


def metric_rows(facts: DataFrame, metrics: list[Metric], granularity: str = "week") -> DataFrame:
    """(workspace_id, period, subjects, metric, value, subject_count) over consented subjects; metrics without subjects have no row."""
    own = facts.where("consented").withColumn("period", period_label(F.col("first_at"), granularity))
    counts = []
    for i, m in enumerate(metrics):
        in_it = (F.col("now_at") - F.col("first_at") >= m.maturity_days * DAY_US) & F.col(f"q{i}")
        counts += [F.count_if(in_it).alias(f"n{i}"), F.count_if(in_it & F.col(f"s{i}")).alias(f"k{i}")]
    wide = own.groupBy("workspace_id", "period").agg(F.count("*").alias("subjects"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(f"k{i}").alias("k"), F.col(f"n{i}").alias("n")) for i, m in enumerate(metrics))))
    long = wide.select("workspace_id", "period", "subjects", each.alias("m")).where("m.n > 0")
    return long.select("workspace_id", "period", "subjects", F.col("m.metric").alias("metric"), (F.col("m.k").cast("double") / F.col("m.n")).alias("value"), F.col("m.n").alias("subject_count"))


def dominant_builders(events: DataFrame, keys: list[str]) -> DataFrame:
    """The builder of most events, unknown ones aside; equal counts go to the first in the alphabet; else ``unknown``."""
    n = events.groupBy(*keys, "builder").agg(F.count("*").alias("n"))
    best = F.min_by(F.when(F.col("builder") != "unknown", F.col("builder")), F.when(F.col("builder") != "unknown", F.struct(-F.col("n"), "builder")))
    return n.groupBy(*keys).agg(F.coalesce(best, F.lit("unknown")).alias("builder"))


def rollup(events: DataFrame, config: DataFrame, metrics: list[Metric], granularity: str = "week", purpose: str = PURPOSES[1], now: int | None = None) -> DataFrame:
    """Observations (workspace_id, builder, vertical, size_bucket, period, metric, value, subject_count).

    ``config``: workspace_id, vertical and an optional builder that overrides
    the dominant one; events of other workspaces are dropped. A subject belongs
    to the period of its first event; size counts consented subjects only.
    """
    # its own size is known once it is written: few workspaces are broadcast, and events stay where they are, however large a table they were found in
    config = saved(config)
    own = events.join(config.select("workspace_id"), "workspace_id", "left_semi")
    facts = subject_facts(own, metrics, purpose, now)
    rows = metric_rows(facts, metrics, granularity)
    home = facts.where("consented").select(*SUBJECT, period_label(F.col("first_at"), granularity).alias("period"))
    built = dealt(own.select(*SUBJECT, "builder"), *SUBJECT).join(home, SUBJECT)
    n = built.groupBy("workspace_id", "period", "builder").agg(F.count("*").alias("n"))
    best = F.min_by(F.when(F.col("builder") != "unknown", F.col("builder")), F.when(F.col("builder") != "unknown", F.struct(-F.col("n"), "builder")))
    dominant = n.groupBy("workspace_id", "period").agg(F.coalesce(best, F.lit("unknown")).alias("derived"))
    given = config.select("workspace_id", "vertical", (F.col("builder") if "builder" in config.columns else F.lit(None).cast("string")).alias("declared"))
    out = rows.join(dominant, ["workspace_id", "period"]).join(given, "workspace_id")
    return out.select("workspace_id", F.coalesce("declared", "derived").alias("builder"), "vertical", size_bucket(F.col("subjects")).alias("size_bucket"), "period", "metric", "value", "subject_count")


def rollup_counters(events: DataFrame, config: DataFrame, purpose: str = PURPOSES[1]) -> DataFrame:
    """(workspace_id, subjects_seen, subjects_without_consent, foreign): the last one true where the workspace isn't configured."""
    facts = events.groupBy(*SUBJECT).agg(F.bool_and(F.array_contains("purposes", purpose)).alias("ok"), F.count("*").alias("n"))
    known = config.select("workspace_id", F.lit(True).alias("known"))
    by = facts.groupBy("workspace_id").agg(F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("without"), F.sum("n").alias("n")).join(known, "workspace_id", "left")
    own = F.coalesce("known", F.lit(False))
    return by.select("workspace_id", F.when(own, F.col("seen")).otherwise(0).alias("subjects_seen"), F.when(own, F.col("without")).otherwise(0).alias("subjects_without_consent"), F.when(own, 0).otherwise(F.col("n")).cast("long").alias("foreign_events_dropped"))


def timelines(events: DataFrame) -> DataFrame:
    """Subjects with their events in time order, for metrics that need the whole timeline."""
    steps = F.array_sort(F.collect_list(F.struct("at", "name")))
    return events.groupBy(*SUBJECT).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"), steps.alias("steps"))
