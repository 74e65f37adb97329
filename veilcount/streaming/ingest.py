"""Continuous ingest: the batch rules over a stream of raw events.

Validation, redaction, screening and pseudonyms are local to a row and run
unchanged on streams; keys of workspaces, the consent ledger and the address
ranges are tables that the stream is joined with. Repeated deliveries of an
event go by ``dropDuplicatesWithinWatermark``. The watermark is on the time of
arrival: the time that a client gives may lie anywhere in the past and must not
drop events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from veilcount.constants import DAY_US
from veilcount.functions import identity
from veilcount.functions.text_rules import reveals
from veilcount.operators import addresses, consent, redact, validate
from veilcount.sources.store import EventStore
from veilcount.sources.tables import saved, shared_folder


#: Middle of the sample, 2024-01-16.
HALF = 1_705_363_200_000_000


@dataclass(frozen=True)
class Known:
    """What ingest looks up: keys (api_key, workspace_id), the consent records on anchors, address ranges or their nodes, and the root secret."""

    keys: DataFrame
    records: DataFrame
    ranges: DataFrame
    root: str


def judged(raw: DataFrame, known: Known, asof: str | None = None) -> DataFrame:
    """Raw events with pseudonyms in place of the identifier, country in place of the address, purposes and ``reject_reason``.

    The purposes are those that the ledger permits the subject's anchor,
    narrowed by an opt-out signal and by names or properties that reveal a
    special category; without analytics among them the event is rejected. The
    workspace is that of the ``api_key``, whatever the payload says; events of
    keys that nobody has are ``unauthorized``, and so no subject is without key.
    With ``asof``, a column of microseconds, consent is that of the time it
    names; such a join sorts, and so it is for batches.
    """
    own = validate.refused_without_workspace(validate.validate(validate.attach_workspace(raw, known.keys)))
    valid = own.withColumn("at", F.col("clean_at")).drop("jurisdiction", "api_key")
    keyed = identity.with_keys(valid, known.root, workspaces=known.keys).drop("identifier")
    subjects = keyed.withColumnsRenamed({"subject_key": "rotating", "anchor": "subject_key", "clean_jurisdiction": "jurisdiction"})
    permitted = consent.permitted(subjects, known.records) if asof is None else consent.permitted_at(subjects, known.records, asof)
    # narrowing leaves analytics where it is; so the refused are known, and may be left out, before texts are searched
    allowed = validate.rejected_without_analytics(permitted.withColumnsRenamed({"subject_key": "anchor", "rotating": "subject_key"}))
    bag = F.coalesce(F.expr("map_entries(try_cast(try_parse_json(properties) as map<string, variant>))"), F.array().cast("array<struct<key: string, value: variant>>"))
    texts = F.concat(F.array("name"), F.transform(bag, lambda e: e["key"]), F.transform(bag, lambda e: F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit(""))))
    found = F.filter(texts, reveals)
    narrow = validate.restrict_sensitive(validate.restrict_opt_out(F.col("purposes"), F.col("opt_out")), found)
    return addresses.country_of_ip(allowed.withColumn("purposes", narrow), known.ranges)


def clean_stream(raw: DataFrame, known: Known, arrival: str = "arrival", delay: str = "1 hour") -> DataFrame:
    """Accepted events of a stream, each once, with redacted properties; neither identifier nor address is kept."""
    valid = judged(raw, known).where("reject_reason is null")
    return cleaned(valid.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["workspace_id", "event_id"]), arrival)


def cleaned(accepted: DataFrame, arrival: str) -> DataFrame:
    """Judged events as they are stored."""
    kept = accepted.select("workspace_id", "event_id", "subject_key", "epoch", "anchor", F.col("clean_name").alias("name"), "at", "jurisdiction", F.col("clean_builder").alias("builder"), "country", "purposes", "properties", arrival)
    return redact.redact_properties(kept)


CLEAN = "workspace_id string, event_id string, subject_key string, epoch long, anchor string, name string, at long, jurisdiction string, builder string, country string, purposes array<string>, properties map<string, string>, property_types map<string, string>, findings array<struct<key: string, rule: string>>, arrival_us long"


def store_batches(raw: DataFrame, known: Callable[[], Known], store: EventStore, checkpoint: str, arrival_us: str = "arrival_us") -> StreamingQuery:
    """Starts ingest into a store, batch by batch.

    ``known`` is called for every batch, so that a batch sees the ledger as it
    is by then, and of it what was recorded up to each event's arrival. An
    event that is stored already is not stored again, however late it comes
    back and whichever batch is run twice: the store looks among the days
    whose filter may hold the id.
    """

    def batch(rows: DataFrame, _: int) -> None:
        now = known()
        # what is stored isn't judged again
        new = saved(store.unstored(validate.attach_workspace(rows, now.keys)))
        accepted = judged(new, now, arrival_us).where("reject_reason is null")
        store.append_first(cleaned(accepted, arrival_us))

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_by_hour(clean: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(window, workspace_id, key, rule, n) for every hour of arrival."""
    each = clean.select(arrival, "workspace_id", F.explode("findings").alias("f"))
    return each.groupBy(F.window(arrival, "1 hour"), "workspace_id", "f.key", "f.rule").agg(F.count("*").alias("n"))


def raw_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _run(spark: SparkSession, sf_dir: str, build, close: bool = False) -> DataFrame:
    """Feeds the sample's raw events (every fourth twice) through a stream, once, and reads what it wrote.

    With ``close`` one more event arrives a day after the last: the watermark
    then closes all windows but its own, which is never written.
    """
    from veilcount.sources import fixtures as fx

    folder = shared_folder(spark)
    raw = fx.raw_events(spark, sf_dir)
    twice = raw.unionByName(raw.where("ingest_seq % 4 = 0")).withColumn("arrival", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("ingest_seq") * 1_000_000))
    if close:
        # a rejected event wouldn't move the watermark
        last = raw.join(judged(raw, sample_knowledge(spark, sf_dir)).where("reject_reason is null").select("event_id"), "event_id", "left_semi").agg(F.max_by(F.struct(*raw.columns), "ingest_seq").alias("r")).where("r is not null").select("r.*")
        at = raw.agg((F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.max("ingest_seq") * 1_000_000) + F.expr("interval 1 day")).alias("arrival"))
        twice = twice.unionByName(last.withColumn("event_id", F.concat(F.lit("closing-"), "event_id")).join(at, F.lit(True)))
    twice.write.parquet(f"{folder}/in")
    out = build(raw_stream(spark, f"{folder}/in", twice.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def sample_knowledge(spark: SparkSession, sf_dir: str) -> Known:
    from veilcount.sources import fixtures as fx

    return Known(fx.api_keys(spark), consent.from_decisions(fx.decisions(spark, sf_dir), fx.ROOT), addresses.address_nodes(fx.geo(spark)), fx.ROOT)


def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sample_knowledge(spark, sf_dir)
    out = _run(spark, sf_dir, lambda raw: clean_stream(raw, known))
    return out.select("workspace_id", "event_id", "subject_key", "name", "at", "jurisdiction", "builder", "country", F.array_join("purposes", ",").alias("purposes"), F.size("findings").alias("findings"))


def stored_once(spark: SparkSession, sf_dir: str) -> EventStore:
    """The sample's raw events in three runs of one stream: half of them, the other half after withdrawals, and a third of all once more, a month late."""
    from veilcount.operators import erasure
    from veilcount.sources import fixtures as fx

    folder = shared_folder(spark)
    raw = fx.raw_events(spark, sf_dir).withColumn("arrival_us", F.unix_micros(F.coalesce(validate.parsed_time(F.col("occurred_at")), F.timestamp_micros(F.lit(HALF)))))
    schema = raw.schema
    consent.from_decisions(fx.decisions(spark, sf_dir), fx.ROOT).write.parquet(f"{folder}/ledger")
    ledger = spark.read.parquet(f"{folder}/ledger").schema
    store = EventStore(spark, f"{folder}/store", StructType.fromDDL(CLEAN), "arrival_us")

    def known() -> Known:
        return Known(fx.api_keys(spark), spark.read.schema(ledger).parquet(f"{folder}/ledger"), ranges, fx.ROOT)

    ranges = addresses.address_nodes(fx.geo(spark))
    late = raw.where("ingest_seq % 3 = 0").withColumns({"arrival_us": F.col("arrival_us") + 30 * DAY_US, "name": F.lit("late_copy")})
    for i, part in enumerate((raw.where(F.col("arrival_us") < HALF), raw.where(F.col("arrival_us") >= HALF), late)):
        if i == 1:
            gone = erasure.withdrawn(fx.requests(spark, sf_dir), fx.ROOT, F.lit(1 << 40).cast("long")).withColumn("at", F.lit(HALF).cast("long"))
            gone.select(ledger.fieldNames()).write.mode("append").parquet(f"{folder}/ledger")
        part.write.mode("append").parquet(f"{folder}/in")
        store_batches(spark.readStream.schema(schema).parquet(f"{folder}/in"), known, store, f"{folder}/state").awaitTermination()
    return store


def noted(raw: DataFrame) -> DataFrame:
    return raw.withColumn("properties", F.to_json(F.struct(F.concat(F.lit("mail user"), F.col("ingest_seq").cast("string"), F.lit("@example.com")).alias("note"), F.col("identifier").alias("user_email"))))


def findings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the sample's events, each with a made-up mail note, in windows that are all closed."""

    known = sample_knowledge(spark, sf_dir)
    out = _run(spark, sf_dir, lambda raw: findings_by_hour(clean_stream(noted(raw), known)), close=True)
    return out.select(F.col("window.start").alias("hour"), "workspace_id", "key", "rule", "n")
