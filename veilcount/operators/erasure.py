"""Erasure on request and by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.functions import identity

from .consent import withdrawals


def erase(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events without those of the (workspace_id, subject_key) pairs in ``keys``."""
    return events.join(keys.select("workspace_id", "subject_key").distinct(), ["workspace_id", "subject_key"], "left_anti")


def erasure_report(events: DataFrame, keys: DataFrame) -> DataFrame:
    """(workspace_id, identifier, epochs_swept, events_deleted) of every request."""
    swept = keys.groupBy("workspace_id", "identifier").agg(F.count_distinct("epoch").alias("epochs_swept"))
    gone = events.join(keys, ["workspace_id", "subject_key"]).groupBy("workspace_id", "identifier").agg(F.count("*").alias("events_deleted"))
    return swept.join(gone, ["workspace_id", "identifier"], "left").fillna(0, ["events_deleted"])


def expire(events: DataFrame, tiers: DataFrame, now: Column, at: str = "at") -> DataFrame:
    """Events younger than their workspace's ``ttl_us``; workspaces without a tier keep nothing."""
    kept = events.join(tiers.select("workspace_id", "ttl_us"), "workspace_id")
    return kept.where(F.col(at) >= now - F.col("ttl_us")).drop("ttl_us")


def withdrawn(requests: DataFrame, root: str, seq: Column) -> DataFrame:
    """Withdrawals of every purpose for (workspace_id, identifier, now), on the anchor: they outlive the keys that were erased."""
    keyed = identity.with_keys(requests.withColumn("at", F.col("now")), root)
    return withdrawals(keyed.select("workspace_id", F.col("anchor").alias("subject_key"), F.lit("unknown").alias("jurisdiction"), "at"), seq)
