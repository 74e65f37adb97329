"""What a workspace sees of its own events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.functions.periods import day_of
from veilcount.sources.tables import saved

#: Registers of a sketch, as a power of two.
LOG_SIZE = 12


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("workspace_id", "name").agg(F.count("*").alias("events"))


def subjects(events: DataFrame) -> DataFrame:
    """(workspace_id, distinct_subjects, total_events): counted by subject first, so that a hot workspace is pre-aggregated."""
    each = events.groupBy("workspace_id", "subject_key").agg(F.count("*").alias("n"))
    return each.groupBy("workspace_id").agg(F.count("*").alias("distinct_subjects"), F.sum("n").alias("total_events"))


def latest_profiles(profiles: DataFrame, version: str = "version") -> DataFrame:
    """The last profile of each workspace.

    Its version is found first, and written: whole profiles of a workspace are
    compared by sorting them, so only those of its last version are.
    """
    rest = [c for c in profiles.columns if c != "workspace_id"]
    last = saved(profiles.groupBy(F.col("workspace_id").alias("_w")).agg(F.max(version).alias("_last")))
    own = profiles.join(last, F.col("workspace_id").eqNullSafe(F.col("_w")) & F.col(version).eqNullSafe(F.col("_last")), "left_semi")
    best = own.groupBy("workspace_id").agg(F.max_by(F.struct(*rest), version).alias("p"))
    return best.select("workspace_id", *(F.col(f"p.{c}").alias(c) for c in rest))


def enrolled(profiles: DataFrame, version: str = "version") -> DataFrame:
    """Workspaces whose latest profile says that they take part in the co-op; who says nothing doesn't."""
    last = latest_profiles(profiles, version)
    return last.where(F.coalesce("coop_enrolled", F.lit(False))).drop("coop_enrolled")


def latest_values(observations: DataFrame) -> DataFrame:
    """Each workspace's value of each metric in its latest period."""
    return observations.groupBy("workspace_id", "metric").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))


def long_form(events: DataFrame) -> DataFrame:
    """(workspace_id, kind, name, n): counts by event name, and the totals, which no event's name can overwrite."""
    by_name = event_counts(events).select("workspace_id", F.lit("event").alias("kind"), "name", F.col("events").alias("n"))
    totals = subjects(events).unpivot("workspace_id", ["distinct_subjects", "total_events"], "name", "n")
    return by_name.unionByName(totals.select("workspace_id", F.lit("total").alias("kind"), "name", "n"))


def daily_sketches(events: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """(workspace_id, day, sketch, total_events): a sketch of each day's distinct subjects, to be stored; one partial aggregate by task."""
    return events.groupBy("workspace_id", day_of(F.col("at")).cast("string").alias("day")).agg(F.hll_sketch_agg("subject_key", log_size).alias("sketch"), F.count("*").alias("total_events"))


def sketched_subjects(sketches: DataFrame, period: Column | None = None) -> DataFrame:
    """(workspace_id, period, distinct_subjects, total_events) of any periods (an expression over ``day``), from stored sketches alone.

    Distinct subjects don't add up over days, sketches do. The estimate's
    relative standard error is about 1.04 / sqrt(2 ** log_size), 1.6 % by
    default; ``subjects`` is the exact way.
    """
    whole = sketches.withColumn("period", F.lit("all") if period is None else period)
    out = whole.groupBy("workspace_id", "period").agg(F.hll_union_agg("sketch").alias("s"), F.sum("total_events").alias("total_events"))
    return out.select("workspace_id", "period", F.hll_sketch_estimate("s").alias("distinct_subjects"), "total_events")
