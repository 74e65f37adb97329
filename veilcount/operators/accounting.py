"""Privacy accounted by workspace: what each may lose over all releases that it is in, however they are named.

A budget by cohort and metric names is a fresh one under every new name, and
the rungs of a ladder, which hold one another, have one each. Here a request
is granted only if every workspace in it still has as much left for the
period, and a cohort is known by the set of its workspaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.constants import BUDGET
from veilcount.sources.tables import saved

LIMBS = 8


def one_value_each(observations: DataFrame, keys: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(keys, workspace_id, value, subject_count): a workspace's rows as one, the mean of their clamped values by subjects.

    However many rows a workspace sends, it is one element of what noise is
    scaled for. Rows without subjects say nothing; a missing value counts as ``lo``.
    """
    value = F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), F.coalesce("value", F.lit(float(lo))))).cast("decimal(20,12)")
    rows = observations.where("subject_count > 0")
    sums = rows.groupBy(*keys, "workspace_id").agg(F.sum(value * F.col("subject_count").cast("decimal(18,0)")).alias("_v"), F.sum("subject_count").alias("subject_count"))
    return sums.select(*keys, "workspace_id", (F.col("_v").cast("double") / F.col("subject_count")).alias("value"), "subject_count")


def set_hash(member: str = "workspace_id") -> Column:
    """An aggregate: one name for a set of distinct members, in any order and without a list of them; the limbs of their hashes are summed."""
    digest = F.sha2(F.col(member), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")).cast("string") for i in range(LIMBS)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)


def decisions(members: DataFrame, requests: DataFrame, spent: DataFrame | None = None, cap: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(request, population, granted) of every request, and (workspace_id, period, epsilon) of what the granted ones spend.

    ``members`` (request, workspace_id), ``requests`` (request, period,
    epsilon); ``spent`` (workspace_id, period, epsilon) counts before them. The
    outcome is that of one request after the other, in the order of
    ``request``. It takes rounds: a request is decided as soon as every
    earlier one that shares a workspace with it is, or is about the same set
    and is decided with it. Nested rungs take as many rounds as rungs, and
    many requests of one population a single one.
    """
    from .release import budget_decisions

    unit = 1_000_000_000
    key = ["workspace_id", "period"]
    pairs = members.select("request", "workspace_id").distinct()
    sets = pairs.groupBy("request").agg(set_hash().alias("population"))
    asked = requests.select("request", "period", F.round(F.col("epsilon").cast("decimal(18,9)") * unit).cast("long").alias("cost"))
    open_ = saved(pairs.join(asked.join(sets, "request"), "request"))
    spark = open_.sparkSession
    if spent is None:
        used = spark.createDataFrame([], "workspace_id string, period string, used long")
    else:
        used = saved(spent.groupBy(*key).agg(F.sum(F.round(F.col("epsilon").cast("decimal(18,9)") * unit).cast("long")).alias("used")))
    out = spends = None
    while True:
        mine = Window.partitionBy(*key)
        first = open_.join(used, key, "left").withColumn("lead", F.first("population").over(mine.orderBy("request").rowsBetween(Window.unboundedPreceding, 0)))
        stop = F.min(F.when(F.col("population") != F.col("lead"), F.col("request"))).over(mine)
        free = first.withColumn("stop", stop).withColumn("free", (F.col("population") == F.col("lead")) & F.coalesce(F.col("request") < F.col("stop"), F.lit(True)))
        ready = saved(free.groupBy("request", "period", "population", "cost").agg(F.bool_and("free").alias("free"), F.coalesce(F.max("used"), F.lit(0).cast("long")).alias("before")).where("free"))
        if ready.isEmpty():
            break
        same = F.concat_ws("|", "population", "period").alias("budget_key")
        amount = lambda c: (F.col(c).cast("decimal(18,0)") / unit).cast("decimal(18,9)").alias("epsilon")
        judged = budget_decisions(ready.select(same, "request", amount("cost")), ready.groupBy(same).agg(F.max("before").alias("before")).select("budget_key", amount("before")), cap)
        done = saved(judged.select("request", "granted").join(ready.select("request", "population"), "request"))
        new = saved(open_.join(done.where("granted").select("request"), "request").select(*key, "cost"))
        out = done if out is None else out.unionByName(done)
        spends = new if spends is None else spends.unionByName(new)
        used = saved(used.unionByName(new.withColumnRenamed("cost", "used")).groupBy(*key).agg(F.sum("used").alias("used")))
        open_ = saved(open_.join(done, "request", "left_anti"))
    if out is None:
        out, spends = spark.createDataFrame([], "request long, population string, granted boolean"), spark.createDataFrame([], "workspace_id string, period string, cost long")
    total = spends.groupBy(*key).agg((F.sum("cost").cast("decimal(18,0)") / unit).cast("double").alias("epsilon"))
    return out.select("request", "population", "granted"), total
