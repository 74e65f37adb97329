"""Splitting licence revenue among contributors, to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.constants import CASH_CENTS, CONTRIBUTOR_SHARE
from veilcount.functions.ranks import ranked

from .cohorts import cohort_string


def contributions(observations: DataFrame, metric: str) -> DataFrame:
    """(workspace_id, cohort_key, subject_count), by one metric, so that subjects count once."""
    return observations.where(F.col("metric") == metric).groupBy("workspace_id", cohort_string().alias("cohort_key")).agg(F.sum("subject_count").alias("subject_count"))


def settle(deals: DataFrame, given: DataFrame, share: float = CONTRIBUTOR_SHARE, cash: int = CASH_CENTS) -> tuple[DataFrame, DataFrame]:
    """(payouts, settlements) of all deals.

    The pool is split by largest remainders in whole numbers: floors first,
    then a cent each to the greatest remainders, ties to the workspace first in
    binary order. Payouts of nothing are left out. Remainders are ranked by
    ranges, so a deal with all workspaces is many tasks' work.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be within 0 and 1")
    net = F.greatest(F.lit(0), F.col("gross_cents") - F.col("direct_cost_cents"))
    money = deals.select("deal_id", "cohort_keys", net.cast("long").alias("net_cents"), F.floor(net * F.lit(share)).cast("long").alias("pool"))
    keys = money.select("deal_id", "pool", F.explode(F.array_distinct("cohort_keys")).alias("cohort_key"))
    own = given.where("subject_count > 0").join(keys, "cohort_key").groupBy("deal_id", "pool", "workspace_id").agg(F.sum("subject_count").alias("subjects"))
    total = own.groupBy("deal_id").agg(F.sum("subjects").alias("total"))
    whole = "decimal(38,0)"
    part = own.join(total, "deal_id").where("pool > 0").withColumn("p", F.col("pool").cast("decimal(19,0)") * F.col("subjects").cast("decimal(19,0)"))
    part = part.withColumn("base", F.expr("p div total").cast("long")).withColumn("left", F.expr(f"cast(p % cast(total as {whole}) as {whole})"))
    extra = part.groupBy("deal_id").agg((F.first("pool") - F.sum("base")).alias("extra"))
    part = ranked(part, ["deal_id"], [F.desc("left"), F.col("workspace_id")], "k")
    paid = part.join(extra, "deal_id").withColumn("amount_cents", F.col("base") + (F.col("k") <= F.col("extra")).cast("int"))
    payouts = paid.where("amount_cents > 0").select("deal_id", "workspace_id", "amount_cents", F.when(F.col("amount_cents") >= cash, "cash").otherwise("credit").alias("method"), (F.col("subjects").cast("double") / F.col("total")).alias("share"), F.col("subjects").alias("subject_count"))
    sums = payouts.groupBy("deal_id").agg(F.sum("amount_cents").alias("paid"))
    done = money.join(sums, "deal_id", "left").withColumn("paid", F.coalesce("paid", F.lit(0).cast("long")))
    pool = F.when(F.col("paid") > 0, F.col("pool")).otherwise(F.lit(0).cast("long"))
    return payouts, done.select("deal_id", "net_cents", pool.alias("pool_cents"), (F.col("net_cents") - F.col("paid")).alias("platform_cents"), (pool - F.col("paid")).alias("rounding_remainder_cents"))


def delivered(releases: DataFrame, deals: DataFrame) -> DataFrame:
    """The released aggregates that a licence covers, by deal."""
    keys = deals.select("deal_id", F.explode(F.array_distinct("cohort_keys")).alias("cohort_key"))
    return releases.withColumn("cohort_key", cohort_string()).join(keys, "cohort_key").drop("cohort_key")
