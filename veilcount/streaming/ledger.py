"""The consent ledger as a stream: each lane's head is state, so that a batch goes on where the one before it ended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilcount.operators.consent import GENESIS, canonical

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("at", "seq", "subject_key", "purpose", "state", "source", "jurisdiction", "notice_version")


class Lane(StatefulProcessor):
    """Chains one workspace's records of a batch, in the order of the batch ledger, to what its state holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "length long, head string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place, head = self.last.get() if self.last.exists() else (0, GENESIS)
        # what one batch holds of one lane
        for r in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in FIELDS)):
            before, head = head, hashlib.sha256(f"{head}|{r['text']}".encode()).hexdigest()
            yield Row(workspace_id=key[0], place=place, **{c: r[c] for c in FIELDS}, prev_hash=before, hash=head)
            place += 1
        self.last.update((place, head))

    def close(self) -> None:
        pass


def chained(records: DataFrame) -> DataFrame:
    """A stream of consent records as chain entries, like ``consent.append``: entry by entry the same if records arrive in order, in however many batches.

    A record that arrives in a later batch than one with a later time comes
    behind it: the chain is the order in which the ledger learned of things.
    Batches should be bounded, as a lane's part of a batch is sorted in memory.
    """
    given = records.select("workspace_id", *FIELDS).withColumn("text", canonical(F.struct(*FIELDS)))
    schema = records.select("workspace_id", F.lit(0).cast("long").alias("place"), *FIELDS, F.lit("").alias("prev_hash"), F.lit("").alias("hash")).schema
    return given.groupBy("workspace_id").transformWithState(Lane(), schema, "Append", "None")


def run_ledger(spark: SparkSession, records: DataFrame, folder: str) -> None:
    """Chains what has arrived in ``records``, a stream, into ``folder``/chain, and ends; the next call goes on from there."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = chained(records).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/chain")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
