"""Stored events by day of arrival: first writes win, and erasure rewrites only days that hold the subject.

Beside the events lie Bloom filters for each day, of subjects and of event ids
(rows without an event id have only the first). One writer at a time: the sink of a stream, or an erasure between its
batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilcount.functions.periods import day_of

from . import filters
from .tables import by_folder, saved

#: One key of so many is looked for first.
SHARE = 64
SUBJECT, EVENT = ["workspace_id", "subject_key"], ["workspace_id", "event_id"]


@dataclass
class EventStore:
    """``schema``: the events' columns, workspace_id, subject_key and ``at`` (a long, microseconds) among them.

    A day is a folder named by ``day``; ``at`` should be the time of arrival, as
    clients may give any.
    """

    spark: SparkSession
    path: str
    schema: StructType
    at: str = "at"

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _read(self, name: str, schema: StructType | str) -> DataFrame:
        files, path = self._folder(name)
        files.mkdirs(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def events(self, days: list[str] | None = None) -> DataFrame:
        """The stored events with ``day``; other days' folders aren't read."""
        found = self._read("events", StructType([*self.schema.fields, StructField("day", StringType())]))
        return found if days is None else found.where(F.col("day").isin(days))

    @property
    def kinds(self) -> dict[str, list[str]]:
        return {n: k for n, k in (("subjects", SUBJECT), ("ids", EVENT)) if set(k) <= set(self.schema.fieldNames())}

    def _filter(self, name: str) -> DataFrame:
        return self._read(name, "word long, bitmap binary, day string")

    def days_with(self, keys: DataFrame, kind: list[str]) -> list[str]:
        """Days whose filter may hold any of the keys; as many as there are folders at most."""
        name = "subjects" if kind == SUBJECT else "ids"
        every = self._filter(name)
        named: list[str] = []
        # a small share of many keys names most days that will be named, and the others look among the rest only
        for some in (keys.where(F.pmod(F.xxhash64(*kind), F.lit(SHARE)) == 0), keys):
            rest = every.where(~F.col("day").isin(named)) if named else every
            named += [r["day"] for r in filters.may_hold_any(rest, some, "day", kind).collect()]
        return sorted(named)

    def append(self, events: DataFrame) -> None:
        """Adds events as they are. Filters are written first: should the job die in between, they name a day too many and never one too few."""
        self.recover()
        rows = events.select(*self.schema.fieldNames(), day_of(F.col(self.at)).cast("string").alias("day"))
        for name, keys in self.kinds.items():
            by_folder(filters.summary(rows, "day", keys), "day").write.mode("append").partitionBy("day").parquet(f"{self.path}/{name}")
        by_folder(rows, "day").write.mode("append").partitionBy("day").parquet(f"{self.path}/events")

    def unstored(self, events: DataFrame) -> DataFrame:
        """The rows whose (workspace_id, event_id) isn't stored; others of their columns don't matter. Only days whose filter may hold one of the ids are read, and of them only the ids."""
        days = self.days_with(events, EVENT)
        return events.join(self.events(days).select(*EVENT), EVENT, "left_anti") if days else events

    def firsts(self, events: DataFrame) -> DataFrame:
        """The first of each (workspace_id, event_id) by ``at``."""
        least = events.groupBy(*EVENT).agg(F.min_by(F.struct(*(F.col(c) for c in self.schema.fieldNames())), F.struct(self.at, F.xxhash64(*(F.col(c) for c in self.schema.fieldNames() if not self.schema[c].dataType.typeName().startswith("map"))))).alias("e"))
        return least.select("e.*")

    def append_once(self, events: DataFrame) -> None:
        """Adds the events that aren't stored yet, however often and however late they come again; a batch that is run twice adds nothing the second time."""
        self.append_first(self.unstored(saved(events)))

    def append_first(self, unstored: DataFrame) -> None:
        """Adds the first of each event; none may be stored already."""
        self.append(saved(self.firsts(unstored)))

    def of_subjects(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the (workspace_id, subject_key) pairs, from the days that may hold one."""
        return self.events(self.days_with(keys, SUBJECT)).join(keys.select(*SUBJECT).distinct(), SUBJECT, "left_semi")

    def erase(self, keys: DataFrame) -> DataFrame:
        """Deletes all events of the (workspace_id, subject_key) pairs; (day, events_deleted) of the days that were rewritten.

        Of the days that the filter names only the keys are read, and only days
        that hold one are rewritten: what stays is staged in a folder, and then
        takes the place of the day's own. Files of other days stay as they are.
        If a run dies, the next one, or the next batch, ends what it began.
        """
        self.recover()
        keys = saved(keys.select(*SUBJECT).distinct())
        maybe = self.events(self.days_with(keys, SUBJECT))
        gone = saved(maybe.select("day", *SUBJECT).join(keys, SUBJECT, "left_semi").groupBy("day").agg(F.count("*").alias("events_deleted")))
        days = sorted(r["day"] for r in gone.select("day").collect())
        if days:
            self.events(days).join(keys, SUBJECT, "left_anti").write.mode("overwrite").parquet(f"{self.path}/pending/rows")
            # from here on the days can be put right from what is staged
            gone.select("day").write.mode("overwrite").parquet(f"{self.path}/pending/days")
            self.recover()
        return gone

    def recover(self) -> None:
        """Ends what an erasure that died has begun: days that it staged take their place."""
        files, begun = self._folder("pending/days/_SUCCESS")
        if files.exists(begun):
            stays = self.spark.read.schema(StructType([*self.schema.fields, StructField("day", StringType())])).parquet(f"{self.path}/pending/rows")
            days = {r["day"] for r in self.spark.read.schema("day string").parquet(f"{self.path}/pending/days").collect()}
            self._replace(stays, "events")
            for name, kind in self.kinds.items():
                self._replace(filters.summary(stays, "day", kind), name)
            for day in days - {r["day"] for r in stays.select("day").distinct().collect()}:
                for name in ("events", *self.kinds):
                    self._delete(f"{name}/day={day}")
            self._delete("pending")

    def _delete(self, name: str) -> None:
        files, path = self._folder(name)
        files.delete(path, True)

    def _replace(self, rows: DataFrame, name: str) -> None:
        by_folder(rows, "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{name}")
