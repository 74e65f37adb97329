"""The rollup kept up to date: a batch of events costs what its subjects cost, not what the workspaces do.

Kept are the events, one row of facts for each subject, both in stores that
find a subject's days by Bloom filters, and counts by workspace and day of
first sight. A batch recomputes the facts of the subjects it touches, also
where a backdated event moves the first one, and adds to the counts what the
new facts have more than the old ones.

A metric counts subjects that are old enough, and the clock moves on for those
too that no event touches. Counts by day settle this for all days but one for
each workspace and metric, the day on which the limit falls; of that day the
facts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilcount.constants import DAY_US, PURPOSES
from veilcount.functions.periods import period_label, size_bucket
from veilcount.sources.store import SUBJECT, EventStore
from veilcount.sources.tables import saved

from .metrics import Metric, subject_facts

CELL = "workspace_id string, first_day long, what string, n long, k long"
CLOCK = "workspace_id string, last_at long, anew boolean, batch int"


@dataclass
class Rollup:
    """``path``: a folder of its own. ``metrics`` and ``purpose`` must stay the same over all batches."""

    spark: SparkSession
    path: str
    metrics: list[Metric]
    events: EventStore
    purpose: str = PURPOSES[1]

    @property
    def facts(self) -> EventStore:
        flags = ", ".join(f"q{i} boolean, s{i} boolean" for i in range(len(self.metrics)))
        return EventStore(self.spark, f"{self.path}/facts", StructType.fromDDL(f"workspace_id string, subject_key string, first_at long, last_at long, consented boolean, {flags}, builders map<string, bigint>"), "first_at")

    def _facts_of(self, events: DataFrame) -> DataFrame:
        # found in the store once, and read three times
        events = saved(events)
        counted = events.groupBy(*SUBJECT, F.coalesce("builder", F.lit("unknown")).alias("builder")).agg(F.count("*").alias("c")).groupBy(*SUBJECT).agg(F.map_from_entries(F.collect_list(F.struct("builder", "c"))).alias("builders"))
        # the clock is added when counts are read
        found = subject_facts(events, self.metrics, self.purpose, now=0).join(counted, SUBJECT)
        return found.select(*self.facts.schema.fieldNames())

    def _cells(self, facts: DataFrame, sign: int) -> DataFrame:
        """What consented subjects count: themselves, each metric that they qualify for, and their events by builder."""
        one = F.lit(sign).cast("long")
        cell = lambda what, n, k: F.struct(what.alias("what"), n.cast("long").alias("n"), k.cast("long").alias("k"))
        flags = [cell(F.lit(f"metric {i}"), F.when(F.col(f"q{i}"), one).otherwise(F.lit(0)), F.when(F.col(f"q{i}") & F.col(f"s{i}"), one).otherwise(F.lit(0))) for i in range(len(self.metrics))]
        built = F.transform(F.map_entries("builders"), lambda e: cell(F.concat(F.lit("builder "), e["key"]), e["value"] * one, F.lit(0)))
        each = facts.where("consented").select("workspace_id", F.floor(F.col("first_at") / F.lit(DAY_US)).alias("first_day"), F.explode(F.concat(F.array(cell(F.lit("subjects"), one, F.lit(0)), *flags), built)).alias("c"))
        return each.select("workspace_id", "first_day", "c.*")

    def _staged(self, batch: int, name: str) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def update(self, batch: int, events: DataFrame) -> None:
        """Takes in a batch of events (workspace_id, event_id, subject_key, name, at, builder, purposes), numbered in order; one that is run again goes on where it died.

        New facts and the change of the counts are staged before the old facts
        go, so a second run never takes the new facts for the old ones.
        """
        self.events.append_once(events)
        staged, cells, clock = (self._staged(batch, n) for n in ("staged", "cells", "clock"))
        if not self._done(staged):
            touched = events.select(*SUBJECT).distinct()
            self._facts_of(self.events.of_subjects(touched)).write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(self.facts.schema).parquet(staged)
        if not self._done(cells):
            both = self._cells(new, 1).unionByName(self._cells(self.facts.of_subjects(new), -1))
            change = both.groupBy("workspace_id", "first_day", "what").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n <> 0 or k <> 0")
            new.groupBy("workspace_id").agg(F.max("last_at").alias("last_at")).withColumn("anew", F.lit(False)).write.mode("overwrite").parquet(clock)
            change.write.mode("overwrite").parquet(cells)
        self.facts.erase(new)
        self.facts.append(new)

    def erase(self, batch: int, keys: DataFrame) -> None:
        """Takes the (workspace_id, subject_key) pairs out of events, facts and counts; ``batch`` is a number of its own, and one that is run again goes on where it died.

        Only where an erased subject had its workspace's last event, the clock
        is taken anew from the workspace's other facts.
        """
        staged, cells, clock = (self._staged(batch, n) for n in ("erased", "cells", "clock"))
        if not self._done(staged):
            self.facts.of_subjects(keys).drop("day").write.mode("overwrite").parquet(staged)
        gone = self.spark.read.schema(self.facts.schema).parquet(staged)
        if not self._done(cells):
            late = gone.groupBy("workspace_id").agg(F.max("last_at").alias("now_at")).join(self._clock(), ["workspace_id", "now_at"], "left_semi").select("workspace_id")
            rest = self.facts.events().select(*SUBJECT, "last_at").join(late, "workspace_id", "left_semi").join(gone.select(*SUBJECT), SUBJECT, "left_anti")
            rest.groupBy("workspace_id").agg(F.max("last_at").alias("last_at")).withColumn("anew", F.lit(True)).write.mode("overwrite").parquet(clock)
            self._cells(gone, -1).groupBy("workspace_id", "first_day", "what").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).write.mode("overwrite").parquet(cells)
        self.facts.erase(gone)
        self.events.erase(keys)

    def _clock(self) -> DataFrame:
        """(workspace_id, now_at): the last event since the clock was taken anew."""
        rows = self.spark.read.schema(CLOCK).parquet(f"{self.path}/clock")
        anew = rows.groupBy("workspace_id").agg(F.coalesce(F.max(F.when(F.col("anew"), F.col("batch"))), F.lit(-1)).alias("since"))
        return rows.join(anew, "workspace_id").where("batch >= since").groupBy("workspace_id").agg(F.max("last_at").alias("now_at"))

    def observations(self, config: DataFrame, granularity: str = "week") -> DataFrame:
        """The same as ``metrics.rollup`` over all events so far."""
        known = config.select("workspace_id")
        cells = self.spark.read.schema(CELL).parquet(f"{self.path}/cells").join(known, "workspace_id", "left_semi")
        cells = cells.groupBy("workspace_id", "first_day", "what").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        clock = self._clock().join(known, "workspace_id", "left_semi")
        ages = F.explode(F.array(*(F.struct(F.lit(f"metric {i}").alias("what"), F.lit(m.name).alias("metric"), (F.col("now_at") - m.maturity_days * DAY_US).alias("limit")) for i, m in enumerate(self.metrics)))).alias("a")
        limits = clock.select("workspace_id", ages).select("workspace_id", "a.*").withColumn("edge", F.floor((F.col("limit") + 1) / F.lit(DAY_US)))
        period: Column = period_label(F.col("first_day") * F.lit(DAY_US), granularity).alias("period")

        whole = cells.join(limits, ["workspace_id", "what"]).where("first_day < edge").select("workspace_id", "first_day", "metric", "n", "k")
        # a day for each workspace and metric at most
        edges = [r["day"] for r in limits.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("edge").cast("int")).cast("string").alias("day")).distinct().collect()]
        some = self.facts.events(edges).where("consented").withColumn("first_day", F.floor(F.col("first_at") / F.lit(DAY_US)))
        flags = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(f"q{i}").alias("q"), F.col(f"s{i}").alias("s")) for i, m in enumerate(self.metrics)))).alias("f")
        some = some.select("workspace_id", "first_day", "first_at", flags).select("workspace_id", "first_day", "first_at", "f.*").join(limits, ["workspace_id", "metric"])
        part = some.where("first_day = edge and first_at <= limit and q").select("workspace_id", "first_day", "metric", F.lit(1).cast("long").alias("n"), F.col("s").cast("long").alias("k"))

        counts = whole.unionByName(part).groupBy("workspace_id", period, "metric").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0")
        of = cells.groupBy("workspace_id", period, "what").agg(F.sum("n").alias("n"))
        subjects = of.where("what = 'subjects'").select("workspace_id", "period", F.col("n").alias("subjects"))
        name = F.substring("what", 9, 1000)
        built = of.where("what like 'builder %' and n > 0").where(name != "unknown").groupBy("workspace_id", "period").agg(F.min_by(name, F.struct(-F.col("n"), name)).alias("derived"))
        given = config.select("workspace_id", "vertical", (F.col("builder") if "builder" in config.columns else F.lit(None).cast("string")).alias("declared"))
        out = counts.join(subjects, ["workspace_id", "period"]).join(built, ["workspace_id", "period"], "left").join(given, "workspace_id")
        return out.select("workspace_id", F.coalesce("declared", "derived", F.lit("unknown")).alias("builder"), "vertical", size_bucket(F.col("subjects")).alias("size_bucket"), "period", "metric", (F.col("k").cast("double") / F.col("n")).alias("value"), F.col("n").alias("subject_count"))
