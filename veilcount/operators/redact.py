"""Redaction of property bags and reports of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.constants import BLOCKED_KEY, REDACTIONS
from veilcount.functions.text_rules import redaction_steps, rules_fired


def _entries(json: Column, path: str = "$") -> Column:
    return F.map_entries(F.coalesce(F.try_variant_get(json, path, "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def _visit(key: Column, value: Column) -> Column:
    """One property as an entry: dropped ones have a null kind and a rule."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = redaction_steps(F.try_variant_get(value, "$", "string"))
    plain = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(None).cast("string"))
    items = F.size(F.try_variant_get(value, "$", "array<variant>"))
    none = F.array().cast("array<string>")
    entry = lambda k, v, t, r: F.struct(k.alias("key"), v.cast("string").alias("value"), t.cast("string").alias("kind"), r.alias("rules"))
    empty = F.lit(None).cast("string")
    return (
        F.when(key.rlike(BLOCKED_KEY), entry(key, empty, empty, F.array(F.lit("blocked_key"))))
        .when(kind == "VOID", entry(key, empty, F.lit("null"), none))
        .when(kind == "STRING", entry(key, text["text"], F.lit("string"), text["rules"]))
        .when(kind.startswith("ARRAY"), entry(F.concat(key, F.lit("_count")), items.cast("string"), F.lit("number"), F.array(F.lit("array_collapsed"))))
        .when(kind.startswith("OBJECT"), entry(key, empty, empty, F.array(F.lit("unsupported_type"))))
        .otherwise(entry(key, plain, F.when(kind == "BOOLEAN", "boolean").otherwise("number"), none))
    )


def redact_properties(events: DataFrame, column: str = "properties") -> DataFrame:
    """Replaces a JSON text by ``properties`` and ``property_types`` (maps) and ``findings``.

    Blocked keys go; null, boolean and number stay; texts are redacted; arrays
    become counts; one level of objects is flattened with ``_``; what lies
    deeper goes. Text that isn't a JSON object gives empty maps. Works on
    streams: nothing is shuffled.
    """
    parsed = F.try_parse_json(F.col(column))
    top = _entries(parsed)

    def spread(e: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))
        inner = F.transform(_entries(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("_"), x["key"]).alias("key"), x["value"].alias("value")))
        whole = F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))
        return F.when(kind.startswith("OBJECT") & ~e["key"].rlike(BLOCKED_KEY), inner).otherwise(whole)

    flat = F.flatten(F.transform(top, spread))
    done = events.withColumn("_e", F.transform(flat, lambda e: _visit(e["key"], e["value"])))
    kept = F.filter("_e", lambda e: e["kind"].isNotNull())
    findings = F.flatten(F.transform("_e", lambda e: F.transform(e["rules"], lambda r: F.struct(F.regexp_replace(e["key"], F.when(r == "array_collapsed", F.lit("_count$")).otherwise(F.lit("\\A\\z")), F.lit("")).alias("key"), r.alias("rule")))))
    pairs = lambda field: F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e[field])))
    return done.withColumn("property_types", pairs("kind")).withColumn("findings", findings).withColumn("properties", pairs("value")).drop("_e")


def text_findings(table: DataFrame, key: str, text: str) -> DataFrame:
    """(rule, n): how many rows of a text table each redaction rule fires on."""
    names = [*(name for name, _ in REDACTIONS), "truncated"]
    counts = rules_fired(table.select(F.col(text).alias("_text")), "_text").agg(*(F.count_if(n).alias(n) for n in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names))).alias("r")).select("r.*").where("n > 0")


def findings_report(redacted: DataFrame) -> DataFrame:
    """(workspace_id, key, rule, n) of the findings of redacted properties."""
    each = redacted.select("workspace_id", F.explode("findings").alias("f"))
    return each.groupBy("workspace_id", "f.key", "f.rule").agg(F.count("*").alias("n"))
