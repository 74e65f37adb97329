"""Raw events as clients post them: a line of JSON for each request, read the same way in batches and from streams.

A request is an object with ``api_key`` and ``events``, a list of at most 500.
What can't be used is kept with the reason: a quarantine of lines and of single
events, which can be counted and looked at, and read again when it is mended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.constants import PURPOSES
from veilcount.operators.validate import attach_workspace

#: Most events of one request.
MOST_EVENTS = 500
FIELDS = ("event_id", "name", "occurred_at", "identifier", "jurisdiction", "builder", "ip")
LINE = "value string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE).text(path)


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LINE).text(path)


def _is_object(value: Column) -> Column:
    """Without a look at what is inside, of which ``schema_of_variant`` would make one type."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text_of(value: Column, path: str) -> Column:
    """A field as text: texts as they are, numbers and booleans as JSON writes them, null if it is absent, null or nested."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    nested = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    return F.when(~nested, F.try_variant_get(value, path, "string"))


def requests(raw: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """``raw`` (value, ...) with ``body`` (a variant), ``events`` (variants) and ``reason``, why a line can't be used; null if it can.

    Blank lines are no requests and go.
    """
    parsed = raw.where(F.trim("value") != "").withColumn("body", F.try_parse_json("value"))
    events = F.col("events")
    reason = (
        F.when(F.col("body").isNull(), "malformed_json").when(~_is_object(F.col("body")), "not_an_object")
        .when(events.isNull(), "no_events").when(F.size(events) > most, "batch_too_large")
    )
    return parsed.withColumn("events", F.try_variant_get("body", "$.events", "array<variant>")).withColumn("reason", reason)


def events_of(asked: DataFrame) -> DataFrame:
    """One row for each event of usable requests: what ``validate`` takes, ``event`` as a variant, and ``reason`` for what is no object.

    The workspace is left to the key. ``opt_out`` is the request's signal;
    ``properties`` is the event's bag as JSON text. All columns of ``asked`` but
    the line go on, and nothing is shuffled.
    """
    each = _exploded(asked.where("reason is null"), F.posexplode("events"))
    return each.select(*_rest(asked), "api_key", "opt_out", "position", "event", *_fields(), _event_reason().alias("reason"))


def outcomes(asked: DataFrame) -> DataFrame:
    """All that ``events_of``, ``refused_lines`` and ``refused_events`` tell, in one pass over the lines.

    ``part`` is ``events``, ``lines_refused`` or ``events_refused``; what is
    refused has ``reason`` and ``text``, and usable events have the columns of
    ``events_of`` but ``event``. Nothing is filtered before the events are
    spread, so a line is parsed once.
    """
    each = _exploded(asked, F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("events"))), "value", F.col("reason").alias("_line"))
    # usable requests without events say nothing
    told = each.where("_line is not null or position is not null").withColumn("_event", F.when(F.col("position").isNotNull(), _event_reason()))
    part = F.when(F.col("_line").isNotNull(), "lines_refused").when(F.col("_event").isNotNull(), "events_refused").otherwise("events")
    text = F.when(F.col("_line").isNotNull(), F.col("value")).when(F.col("_event").isNotNull(), F.to_json("event"))
    return told.select(part.alias("part"), F.coalesce("_line", "_event").alias("reason"), text.alias("text"), *_rest(asked), "api_key", "opt_out", "position", *_fields())


def _rest(asked: DataFrame) -> list[str]:
    return [c for c in asked.columns if c not in ("value", "body", "events", "reason")]


def _exploded(asked: DataFrame, events: Column, *more: Column | str) -> DataFrame:
    key, signal = text_of(F.col("body"), "$.api_key").alias("api_key"), F.coalesce(F.try_variant_get("body", "$.opt_out", "boolean"), F.lit(False)).alias("opt_out")
    return asked.select(*_rest(asked), *more, key, signal, events.alias("position", "event"))


def _fields() -> list[Column]:
    return [*(text_of(F.col("event"), f"$.{f}").alias(f) for f in FIELDS), F.to_json(F.try_variant_get("event", "$.properties", "variant")).alias("properties")]


def _event_reason() -> Column:
    return F.when(~_is_object(F.col("event")), "event_not_an_object")


def refused_lines(asked: DataFrame) -> DataFrame:
    """(reason, text) of lines that can't be used, as they came."""
    return asked.where("reason is not null").select("reason", F.col("value").alias("text"))


def refused_events(events: DataFrame) -> DataFrame:
    """(reason, text) of events that can't be used."""
    return events.where("reason is not null").select("reason", F.to_json("event").alias("text"))


def _objects(raw: DataFrame, key: str = "$.api_key") -> DataFrame:
    parsed = raw.where(F.trim("value") != "").withColumn("body", F.try_parse_json("value"))
    reason = F.when(F.col("body").isNull(), "malformed_json").when(~_is_object(F.col("body")), "not_an_object")
    return parsed.withColumns({"api_key": text_of(F.col("body"), key), "reason": reason})


def decisions_of(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """Consent lines as what ``consent.from_decisions`` takes, with ``reason`` for those that can't be used.

    A line has api_key, identifier, purposes (an object of booleans),
    jurisdiction and noticeVersion. Purposes that aren't known, and values that
    aren't booleans, decide nothing; a line that decides nothing is refused.
    The workspace is that of the key.
    """
    body = F.col("body")
    given = F.map_entries(F.coalesce(F.try_variant_get("body", "$.purposes", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    held = F.filter(given, lambda e: e["key"].isin(*PURPOSES) & (F.schema_of_variant(e["value"]) == "BOOLEAN"))
    asked = _objects(raw).select("*", text_of(body, "$.identifier").alias("identifier"), F.map_from_entries(F.transform(held, lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "boolean")))).alias("purposes"), text_of(body, "$.jurisdiction").alias("jurisdiction"), text_of(body, "$.noticeVersion").alias("notice_version"))
    own = attach_workspace(asked, keys)
    reason = F.coalesce("reason", F.when(F.col("workspace_id").isNull(), "unauthorized"), F.when(F.coalesce("identifier", F.lit("")) == "", "missing_identifier"), F.when(F.size("purposes") == 0, "no_purposes"))
    return own.withColumn("reason", reason).drop("body", "api_key")


def erasures_of(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """Erasure lines (api_key, identifier, jurisdiction) with workspace_id, and ``reason`` for those that can't be used."""
    body = F.col("body")
    asked = _objects(raw).select("*", text_of(body, "$.identifier").alias("identifier"), F.coalesce(F.nullif(text_of(body, "$.jurisdiction"), F.lit("")), F.lit("unknown")).alias("jurisdiction"))
    own = attach_workspace(asked, keys)
    reason = F.coalesce("reason", F.when(F.col("workspace_id").isNull(), "unauthorized"), F.when(F.coalesce("identifier", F.lit("")) == "", "missing_identifier"))
    return own.withColumn("reason", reason).drop("body", "api_key")


def deals_of(raw: DataFrame) -> DataFrame:
    """Licence lines (deal_id, gross_cents, direct_cost_cents, cohort_keys) as what ``settle`` takes, with ``reason`` for those that can't be used.

    Amounts are whole cents from 0 on; costs may be left out.
    """
    body = F.col("body")
    cents = lambda name: F.when(_is(F.try_variant_get("body", f"$.{name}", "variant"), "BIGINT"), F.try_variant_get("body", f"$.{name}", "bigint"))
    absent = F.try_variant_get("body", "$.direct_cost_cents", "variant").isNull()
    asked = _objects(raw).select("*", text_of(body, "$.deal_id").alias("deal_id"), cents("gross_cents").alias("gross_cents"), F.when(absent, F.lit(0).cast("long")).otherwise(cents("direct_cost_cents")).alias("direct_cost_cents"), F.try_variant_get("body", "$.cohort_keys", "array<string>").alias("cohort_keys"))
    bad = F.coalesce((F.col("gross_cents") < 0) | (F.col("direct_cost_cents") < 0), F.lit(True))
    reason = F.coalesce("reason", F.when(F.coalesce("deal_id", F.lit("")) == "", "missing_deal_id"), F.when(bad, "bad_amount"), F.when(F.coalesce(F.size("cohort_keys"), F.lit(0)) <= 0, "no_cohorts"))
    return asked.withColumn("reason", reason).drop("body", "api_key")
