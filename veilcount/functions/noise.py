"""Differentially private noise from a keyed pseudo-random function.

``rand()`` would draw anew when a task is retried; a hash of secret, nonce and
what the draw is for gives one draw a release. Secret and nonce come as columns
of a one-row table, so that they are not in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def secret_table(spark: SparkSession, secret: str, nonce: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(f"{secret}|{nonce}|",)], "prf string"))


def uniform(*what: Column) -> Column:
    """In (0, 1), from 48 bits; needs the column of ``secret_table``."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.col("prf"), F.concat_ws("|", *what)), 256), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def laplace(scale: Column, u: Column) -> Column:
    centred = u - 0.5
    return -scale * F.signum(centred) * F.log(1 - 2 * F.abs(centred))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def generalised(n: Column) -> Column:
    """A count snapped down to the public ladder, 0 under its first step."""
    from veilcount.constants import COUNT_LADDER

    steps = F.array(*(F.lit(x).cast("long") for x in COUNT_LADDER))
    return F.coalesce(F.array_max(F.filter(steps, lambda s: s <= n)), F.lit(0).cast("long"))
