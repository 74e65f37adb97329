"""Keyed pseudonyms: HMAC-SHA-256 from built-in functions.

Secrets never stand in a plan as literals: the root's two padded blocks enter
as a one-row table that is joined by broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.constants import DAY_US, EPOCH_DAYS, KEY_CHARS, LEAST_SECRET, RETENTION_DAYS

from .periods import epoch_of


def padded(key: bytes, byte: int) -> bytes:
    """A key's 64-byte block; longer keys are hashed first."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(x ^ byte for x in block)


def hmac_hex(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC of a string, with the key as its two padded blocks."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pads_of(key_hex: Column, byte: int) -> Column:
    """Padded block of a 32-byte key given in hex."""
    pairs = F.sequence(F.lit(1), F.lit(63), F.lit(2))
    flipped = F.transform(pairs, lambda i: F.lpad(F.hex(F.conv(F.substring(key_hex, i, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0"))
    return F.unhex(F.concat(F.array_join(flipped, ""), F.lit(f"{byte:02X}" * 32)))


def root_table(spark: SparkSession, root: str) -> DataFrame:
    if len(root) < LEAST_SECRET:
        raise ValueError(f"the root secret needs {LEAST_SECRET} characters or more")
    key = root.encode()
    return spark.createDataFrame([(bytearray(padded(key, 0x36)), bytearray(padded(key, 0x5C)))], "root_in binary, root_out binary")


def workspace_keys(workspaces: DataFrame, root: str) -> DataFrame:
    """(workspace_id, subject_in, subject_out, anchor_in, anchor_out) of each distinct workspace."""
    spark = workspaces.sparkSession
    scoped = workspaces.select("workspace_id").where("workspace_id is not null").distinct().join(F.broadcast(root_table(spark, root)), F.lit(True))
    key = lambda prefix: hmac_hex(F.col("root_in"), F.col("root_out"), F.concat(F.lit(prefix), F.col("workspace_id")))
    both = scoped.select("workspace_id", key("workspace:").alias("s"), key("consent-anchor:").alias("a"))
    return both.select("workspace_id", *(pads_of(F.col(c), b).alias(n) for c, b, n in (("s", 0x36, "subject_in"), ("s", 0x5C, "subject_out"), ("a", 0x36, "anchor_in"), ("a", 0x5C, "anchor_out"))))


def subject_key(identifier: Column, epoch: Column) -> Column:
    """Rotates with every epoch; needs the columns of ``workspace_keys``."""
    message = F.concat(identifier, F.lit("|epoch:"), epoch.cast("string"))
    return F.substring(hmac_hex(F.col("subject_in"), F.col("subject_out"), message), 1, KEY_CHARS)


def consent_anchor(identifier: Column) -> Column:
    return F.substring(hmac_hex(F.col("anchor_in"), F.col("anchor_out"), identifier), 1, KEY_CHARS)


def with_keys(events: DataFrame, root: str, at: str = "at", days: int = EPOCH_DAYS, workspaces: DataFrame | None = None) -> DataFrame:
    """Adds epoch, subject_key and anchor; both keys are null without workspace or identifier.

    Streams need the ``workspaces`` from a table, as they can't be read off the events.
    """
    known = F.when(F.length("identifier") > 0, F.col("identifier"))
    joined = events.join(workspace_keys(events if workspaces is None else workspaces, root), "workspace_id", "left")
    out = joined.withColumn("epoch", epoch_of(F.col(at), days)).withColumn("subject_key", subject_key(known, F.col("epoch"))).withColumn("anchor", consent_anchor(known))
    return out.drop("subject_in", "subject_out", "anchor_in", "anchor_out")


def retention_keys(requests: DataFrame, root: str, now: str = "now", days: int = EPOCH_DAYS, retention: int = RETENTION_DAYS) -> DataFrame:
    """One row for every key that (workspace_id, identifier) had in the retention window before ``now``."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(-(-retention // days))))
    each = requests.select("workspace_id", "identifier", F.col(now).alias("now"), steps.alias("i"))
    each = each.withColumn("epoch", epoch_of(F.col("now") - F.col("i") * F.lit(days * DAY_US), days))
    keyed = each.join(workspace_keys(requests, root), "workspace_id")
    return keyed.select("workspace_id", "identifier", "epoch", subject_key(F.col("identifier"), F.col("epoch")).alias("subject_key")).distinct()
