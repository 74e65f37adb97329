"""Tables that the engine writes, laid out so that later reads prune."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task sorts or aggregates by their keys.
TASK_ROWS = 500_000
#: So many times as many, before rows are dealt to more tasks than a map task can write for without holding its split's rows.
STRETCH = 3


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one only where none is set and all tasks run on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="veilcount-")
    return f"{base}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once and read from there: lineage ends here, and what reads them more than once doesn't compute them again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the same keys in one task, and about ``TASK_ROWS`` in each: a task's memory doesn't grow with the table, as it does with a fixed number of tasks.

    Few rows are left to the session's settings. Rows are counted first. Up to
    ``spark.shuffle.sort.bypassMergeThreshold`` tasks, a map task writes rows
    as they come; for more, it holds those of its split, and spills. So that
    many tasks take up to ``STRETCH`` times their rows before there are more.
    """
    spark = rows.sparkSession
    tasks, direct = -(-rows.count() // TASK_ROWS), int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if direct < tasks <= STRETCH * direct:
        tasks = direct
    return rows if tasks < 2 else rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_folder(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of one folder together, so that it gets a few files and not one from every task; a large folder's rows are split again."""
    return rows.hint("rebalance", *columns)


def append_observations(observations: DataFrame, path: str) -> None:
    by_folder(observations, "period", "metric").write.mode("append").partitionBy("period", "metric").parquet(path)


def observations_of(spark: SparkSession, path: str, periods: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Stored observations of some periods and metrics; folders of others aren't read."""
    # names of weeks and months stay texts
    out = spark.read.schema("workspace_id string, builder string, vertical string, size_bucket string, value double, subject_count long, period string, metric string").parquet(path)
    for column, wanted in (("period", periods), ("metric", metrics)):
        if wanted is not None:
            out = out.where(F.col(column).isin(*wanted))
    return out


def append_gated(releases: DataFrame, suppressions: DataFrame, path: str) -> None:
    """Both results of the gate: what is published and what is held back, with the reason."""
    for name, rows in (("releases", releases), ("suppressions", suppressions)):
        by_folder(rows, "period", "metric").write.mode("append").partitionBy("period", "metric").parquet(f"{path}/{name}")


def write_delivery(delivered: DataFrame, path: str) -> None:
    """One folder for each deal, to hand over as it is."""
    by_folder(delivered, "deal_id").write.mode("overwrite").partitionBy("deal_id").parquet(path)
