"""Redaction of personal data and screening for special categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.constants import BUILDER_HOSTS, CATEGORIES, MAX_TEXT, REDACTION_NEEDS, REDACTIONS


def redacted(text: Column) -> Column:
    """All rules in order, each on the output before it, then cut to 256 characters."""
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[redacted:{name}]")
    return F.substring(text, 1, MAX_TEXT)


def redaction_steps(text: Column) -> Column:
    """Struct of the redacted text and the rules that fired."""
    rules, out = [], text
    for name, pattern in REDACTIONS:
        rules.append(F.when(out.rlike(pattern), F.lit(name)))
        out = F.regexp_replace(out, pattern, f"[redacted:{name}]")
    rules.append(F.when(F.length(out) > MAX_TEXT, F.lit("truncated")))
    return F.struct(F.substring(out, 1, MAX_TEXT).alias("text"), F.array_compact(F.array(*rules)).alias("rules"))


def rules_fired(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a boolean column for each rule of ``redaction_steps``; ``text`` is left redacted, but whole.

    Each rule is a step of its own, so that none is computed again for the
    rules after it, and only texts that it fires on are written anew.
    """
    for name, pattern in REDACTIONS:
        need = REDACTION_NEEDS[name]
        may = F.col(text).contains(need) if need.isalnum() or need == "@" else F.col(text).rlike(need)
        rows = rows.withColumn(name, may & F.col(text).rlike(pattern))
        rows = rows.withColumn(text, F.when(F.col(name), F.regexp_replace(text, pattern, f"[redacted:{name}]")).otherwise(F.col(text)))
    return rows.withColumn("truncated", F.length(text) > MAX_TEXT)


def categories(text: Column) -> Column:
    """Names of the special categories that a text reveals; only letters and digits are inside a word."""
    found = [F.when(text.rlike(f"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"), F.lit(name)) for name, words in CATEGORIES]
    return F.array_compact(F.array(*found))


def reveals(text: Column) -> Column:
    """Whether ``categories`` names any, by one search."""
    return text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(words for _, words in CATEGORIES) + ")(?![a-z0-9])")


def screen_text(found: Column) -> Column:
    text = F.concat(F.lit("Possibly sensitive ("), F.array_join(found, ", "), F.lit("): kept in your own figures, left out of shared ones. Another name clears a false alarm."))
    return F.when(F.size(found) > 0, text)


def builder_of_host(host: Column) -> Column:
    out = F.lit("unknown")
    for suffix, builder in reversed(BUILDER_HOSTS):
        out = F.when(host.endswith(suffix), builder).otherwise(out)
    return out


def jurisdiction_of_zone(zone: Column) -> Column:
    return (
        F.when(zone.startswith("Europe/London"), "UK").when(zone.startswith("Europe/"), "EU")
        .when(zone == "America/Los_Angeles", "US-CA").when(zone.startswith("America/"), "US").otherwise("unknown")
    )
