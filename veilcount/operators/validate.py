"""Ingest rules on raw events: who sent them, whether they are well formed, what they may be used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.constants import BUILDERS, EVENT_NAME, PURPOSES
from veilcount.functions.text_rules import categories


def attach_workspace(events: DataFrame, keys: DataFrame) -> DataFrame:
    """The workspace comes from the API key, never from the payload; events of unknown keys have none and are ``unauthorized``.

    A key that is registered twice is the workspace's that was registered last
    (``version``), without versions the first in the alphabet.
    """
    last = F.max_by("workspace_id", "version") if "version" in keys.columns else F.min("workspace_id")
    return events.drop("workspace_id").join(keys.where("api_key <> ''").groupBy("api_key").agg(last.alias("workspace_id")), "api_key", "left")


def refused_without_workspace(validated: DataFrame) -> DataFrame:
    """``unauthorized`` before any other reason, where the key told no workspace."""
    return validated.withColumn("reject_reason", F.when(F.col("workspace_id").isNull(), "unauthorized").otherwise(F.col("reject_reason")))


def parsed_time(text: Column) -> Column:
    """The time, whatever the session's zone; text without a zone is UTC."""
    zone = F.when(text.rlike(r"\A\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*\z"), F.concat(F.trim(text), F.lit("T00:00:00Z"))).when(text.rlike(r"[0-9]:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]*)?)?\s*\z") & ~text.rlike(r"[0-9][+-][0-9]{1,2}:[0-9]{1,2}\s*\z"), F.concat(F.trim(text), F.lit("Z")))
    return F.try_to_timestamp(F.coalesce(zone, text))


def reject_reason() -> Column:
    """The first rule that an event breaks; null if it is well formed."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.coalesce(
        F.when(blank("workspace_id"), "missing_workspace"),
        F.when(blank("event_id"), "missing_event_id"),
        F.when(~F.coalesce(F.col("name").rlike(EVENT_NAME), F.lit(False)), "invalid_event_name"),
        F.when(parsed_time(F.col("occurred_at")).isNull(), "invalid_timestamp"),
        F.when(blank("identifier"), "missing_identifier"),
    )


def normalised_builder(builder: Column, known: tuple[str, ...] = BUILDERS) -> Column:
    return F.when(builder.isin(*known), builder).otherwise("unknown")


def validate(events: DataFrame) -> DataFrame:
    """Adds reject_reason and the normalised name, time (microseconds), jurisdiction and builder."""
    return events.select(
        "*", reject_reason().alias("reject_reason"), F.lower("name").alias("clean_name"), F.unix_micros(parsed_time(F.col("occurred_at"))).alias("clean_at"),
        F.coalesce(F.nullif(F.col("jurisdiction"), F.lit("")), F.lit("unknown")).alias("clean_jurisdiction"),
        normalised_builder(F.col("builder")).alias("clean_builder"),
    )


def only_analytics(purposes: Column) -> Column:
    return F.array_intersect(purposes, F.array(F.lit(PURPOSES[0])))


def restrict_opt_out(purposes: Column, opt_out: Column) -> Column:
    """A browser's opt-out signal outranks a grant in the ledger."""
    return F.when(F.coalesce(opt_out, F.lit(False)), only_analytics(purposes)).otherwise(purposes)


def restrict_sensitive(purposes: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, only_analytics(purposes)).otherwise(purposes)


def rejected_without_analytics(events: DataFrame) -> DataFrame:
    """``reject_reason`` also for events that are well formed, but whose ``purposes`` don't permit analytics."""
    own = F.array_contains(F.coalesce("purposes", F.array().cast("array<string>")), PURPOSES[0])
    return events.withColumn("reject_reason", F.coalesce("reject_reason", F.when(~own, "no_analytics_consent")))


def first_writes(events: DataFrame, order: str = "ingest_seq", stored: DataFrame | None = None) -> DataFrame:
    """The first event of each (workspace, event id); none of those that are ``stored`` already."""
    keys = ["workspace_id", "event_id"]
    if stored is not None:
        events = events.join(stored.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def screened_events(events: DataFrame) -> DataFrame:
    """(event_id, field, category, value) for every match of a name, a property key or a text property."""
    kinds = F.expr("map_entries(coalesce(try_cast(try_parse_json(properties) as map<string, variant>), map()))")
    entries = F.transform(kinds, lambda e: F.struct(F.concat(F.lit("properties."), e["key"]).alias("field"), e["key"].alias("a"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("b")))
    pairs = F.concat(
        F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("value"))),
        F.transform(entries, lambda e: F.struct(e["field"].alias("field"), e["a"].alias("value"))),
        F.transform(F.filter(entries, lambda e: e["b"].isNotNull()), lambda e: F.struct(e["field"].alias("field"), e["b"].alias("value"))),
    )
    flat = events.select("event_id", F.explode(pairs).alias("p")).select("event_id", "p.field", "p.value")
    return flat.select("event_id", "field", "value", F.explode(categories(F.col("value"))).alias("category"))


def screened_workspaces(workspaces: DataFrame, fields: tuple[str, ...] = ("app_name", "description", "vertical", "hostname")) -> DataFrame:
    """(workspace_id, field, category) for every match; any match bars the workspace from the co-op."""
    long = workspaces.select("workspace_id", *(F.col(c).cast("string").alias(c) for c in fields)).unpivot("workspace_id", list(fields), "field", "value")
    return long.select("workspace_id", "field", F.explode(categories(F.col("value"))).alias("category"))


def coop_members(enrolled: DataFrame) -> DataFrame:
    """(workspace_id) of those who take part and whose own description reveals no special category."""
    barred = screened_workspaces(enrolled).select("workspace_id").distinct()
    return enrolled.select("workspace_id").distinct().join(barred, "workspace_id", "left_anti")
