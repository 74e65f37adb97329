"""Ranks within groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.sources.tables import saved


def ranked(rows: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in the order within their group; rows that are equal in it take places side by side.

    Rows are dealt by ranges of group and order together, so a large group
    takes many tasks. They are written once with the number of their range:
    a place is the one within the range after the group's counts in all ranges
    before it, of which there are as many as tasks.
    """
    placed = saved(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()))
    own = [F.col(g) for g in groups]
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    within = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *own).orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = within.join(offsets, same)
    return out.select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))
