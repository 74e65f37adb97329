"""Views over the sample tables, in the shape of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.constants import PURPOSES
from veilcount.functions.periods import micros

ROOT = "a fixed secret for tests only, 32 characters and more"
SECRET, NONCE = "test secret", "test nonce"
VERTICALS = ("b2b_saas", "marketplace", "consumer_social")
BUILDER_CYCLE = ("lovable", "bolt", "v0", "unknown")
JURISDICTIONS = ("US", "EU", "US-CA", "UK", "ZZ")
HOSTS = (".lovable.app", ".bolt.host", ".vercel.app", ".replit.app", ".base44.app", "")
ZONES = ("Europe/London", "Europe/Paris", "America/Los_Angeles", "America/New_York", "Asia/Tokyo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def purposes(shares: Column) -> Column:
    return F.when(shares, F.array(*map(F.lit, PURPOSES))).otherwise(F.array(F.lit(PURPOSES[0])))


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of 12 workspaces; a tenth of the users shares nothing, a fifteenth stops on 2024-01-11."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("at", micros(e, "ts"))
    shares = (F.col("user_id") % 10 != 0) & ~((F.col("user_id") % 15 == 0) & (F.col("at") >= 1_704_931_200_000_000))
    no = F.col("user_id") % 12
    return e.select(
        F.concat(F.lit("ws_"), no.cast("string")).alias("workspace_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("user_id").cast("string").alias("subject_key"), F.col("event_type").alias("name"), "at",
        pick(BUILDER_CYCLE, no).alias("builder"), purposes(shares).alias("purposes"), pick(JURISDICTIONS, F.col("user_id")).alias("jurisdiction"), F.col("props").alias("properties"),
    )


def app_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"ws_{i}", VERTICALS[i % 3]) for i in range(12)], "workspace_id string, vertical string")


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of one workspace for each nation; sharing lapses from 1998 on for a fifteenth of the customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = o.withColumn("at", micros(o, "o_orderdate"))
    both = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    shares = (F.col("o_custkey") % 10 != 0) & ~((F.col("o_custkey") % 15 == 0) & (F.col("at") >= 883_612_800_000_000))
    return both.select(
        F.concat(F.lit("n_"), F.col("c_nationkey").cast("string")).alias("workspace_id"), F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_custkey").cast("string").alias("subject_key"), F.lower("o_orderpriority").alias("name"), "at",
        pick(BUILDER_CYCLE, F.col("c_nationkey")).alias("builder"), purposes(shares).alias("purposes"),
    )


def shop_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return both.select(F.concat(F.lit("n_"), F.col("n_nationkey").cast("string")).alias("workspace_id"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("vertical"))


#: Workspaces of the market sample.
MARKETS = 60


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events of 60 workspaces: enough in each month for cohorts at the usual number of contributors."""
    l = table(spark, sf_dir, "lineitem")
    no = F.col("l_partkey") % MARKETS
    return l.select(
        F.concat(F.lit("m_"), no.cast("string")).alias("workspace_id"), F.col("l_orderkey").cast("string").alias("subject_key"), F.lower("l_returnflag").alias("name"),
        micros(l, "l_shipdate").alias("at"), pick(BUILDER_CYCLE, no).alias("builder"), purposes(F.col("l_orderkey") % 10 != 0).alias("purposes"),
    )


def market_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in versions, as workspaces upsert them: some never say whether they take part, some have an app for children."""
    p = table(spark, sf_dir, "part")
    no = F.col("p_partkey") % MARKETS
    return p.select(
        F.concat(F.lit("m_"), no.cast("string")).alias("workspace_id"), F.col("p_partkey").alias("version"), pick(BUILDER_CYCLE, no).alias("builder"), pick(VERTICALS, no).alias("vertical"), F.lit("1-100").alias("size_bucket"),
        F.when(F.col("p_partkey") % 11 != 0, no % 6 != 5).alias("coop_enrolled"), F.concat(F.lit("app "), no.cast("string")).alias("app_name"), F.when(no % 20 == 7, "an app for kids").otherwise("invoices").alias("description"), F.lit("a.app").alias("hostname"),
    )


def api_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"key-{i}", f"ws_{i}") for i in range(12)], "api_key string, workspace_id string")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clients send them, some of them broken, some with a key that nobody has."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    return e.select(
        F.when(i % 101 == 0, "").otherwise(F.concat(F.lit("ws_"), (F.col("user_id") % 12).cast("string"))).alias("workspace_id"),
        F.when(i % 103 == 0, "").otherwise(F.concat(F.lit("e"), i.cast("string"))).alias("event_id"),
        F.when(i % 107 == 0, "has spaces").when(i % 109 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"),
        F.when(i % 113 == 0, "not-a-date").otherwise(text).alias("occurred_at"),
        F.when(i % 127 == 0, "").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("identifier"),
        F.when(i % 3 == 0, "").otherwise(pick(JURISDICTIONS, F.col("user_id"))).alias("jurisdiction"),
        F.when(i % 5 == 0, "evil-injected").otherwise(pick(BUILDER_CYCLE, F.col("user_id"))).alias("builder"),
        F.concat_ws(".", F.lit("10"), (i % 200).cast("string"), (i % 7).cast("string"), F.lit("9")).alias("ip"),
        (i % 11 == 0).alias("opt_out"), F.col("props").alias("properties"), i.alias("ingest_seq"),
        F.when(i % 131 == 0, "key-of-nobody").when(i % 137 != 0, F.concat(F.lit("key-"), (F.col("user_id") % 12).cast("string"))).alias("api_key"),
    )


def geo(spark: SparkSession) -> DataFrame:
    """Address ranges as numbers: 10.0 to 10.63 US, to 10.127 DE, to 10.149 FR; the rest is unknown."""
    base = 10 * 16_777_216
    cuts = ((0, 64, "US"), (64, 128, "DE"), (128, 150, "FR"))
    return spark.createDataFrame([(base + a * 65_536, base + b * 65_536 - 1, c) for a, b, c in cuts], "first long, last long, country string")


def as_address(number: Column, six: Column) -> Column:
    """A number of 32 bits as a text of IPv4, or in the last bytes of one of IPv6."""
    part = lambda shift: F.shiftrightunsigned(number, shift).bitwiseAND(F.lit(255)).cast("string")
    words = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.shiftrightunsigned(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(F.lit(65_535)))))
    return F.when(six, words).otherwise(F.concat_ws(".", part(24), part(16), part(8), part(0)))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, by user and day; some lines are cut off, some hold no list or no object, and one for each third user has too many events."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    event = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identifier"), F.struct(F.col("event_id").alias("n")).alias("properties"))
    body = e.groupBy("user_id", day.alias("day")).agg(F.sort_array(F.collect_list(event)).alias("events"))
    key = F.concat(F.lit("key-"), (F.col("user_id") % 12).cast("string")).alias("api_key")
    good = F.to_json(F.struct(key, (F.col("user_id") % 11 == 0).alias("opt_out"), "events"))
    n = F.col("user_id") + F.col("day")
    line = F.when(n % 17 == 0, F.expr("left(line, length(line) - 2)")).when(n % 19 == 0, F.lit('["no", "object"]')).when(n % 23 == 0, F.lit('{"api_key": "key-1", "events": 7}')).when(n % 29 == 0, F.replace("line", F.lit('"events":['), F.lit('"events":[null,"text",'))).otherwise(F.col("line"))
    few = body.withColumn("line", good).select(line.alias("value"))
    large = body.where("day = 1 and user_id % 3 = 0").select(F.to_json(F.struct(key, F.array_repeat(F.element_at("events", 1), 501).alias("events"))).alias("value"))
    return few.unionByName(large)


def consent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as consent lines; some are cut off, name no known purpose or nobody, or come with a key that nobody has."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    q = F.col("event_id")
    answers = F.struct((q % 7 != 0).alias(PURPOSES[0]), F.when(q % 3 != 0, q % 5 != 0).alias(PURPOSES[1]), F.lit(True).alias("something_else"))
    body = F.struct(F.when(q % 31 == 0, "key-of-nobody").otherwise(F.concat(F.lit("key-"), (F.col("user_id") % 12).cast("string"))).alias("api_key"), F.when(q % 29 != 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("identifier"), F.when(q % 23 != 0, answers).alias("purposes"), F.lit("v3").alias("noticeVersion"))
    return e.withColumn("line", F.to_json(body)).select(F.when(q % 37 == 0, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")).alias("value"), micros(e, "ts").alias("at"), q.alias("seq"))


def deal_lines(spark: SparkSession, observations: DataFrame) -> DataFrame:
    """The verticals' licences as lines, and three that can't be used."""
    keys = observations.groupBy("vertical").agg(F.sort_array(F.collect_set(F.concat_ws("|", "builder", "vertical", "size_bucket", "period"))).alias("cohort_keys"))
    good = keys.select(F.to_json(F.struct(F.concat(F.lit("deal_"), "vertical").alias("deal_id"), F.lit(1_000_001).alias("gross_cents"), "cohort_keys")).alias("value"))
    bad = spark.createDataFrame([('{"deal_id": "x", "gross_cents": -1, "cohort_keys": ["a"]}',), ('{"deal_id": "x", "gross_cents": 1.5, "cohort_keys": ["a"]}',), ('{"deal_id": "x", "gross_cents": 1, "cohort_keys": []}',)], "value string")
    return good.unionByName(bad)


def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for each customer, of one address to a million, within and across one another; every second of IPv6."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    first = (10 * 16_777_216 + (k * 7919 % 200) * 65_536 + (k * 31 % 65_536)).alias("first")
    size = F.pow(F.lit(2), k % 21).cast("long")
    return c.select(as_address(first, k % 2 == 1).alias("first"), as_address(first + size - 1, k % 2 == 1).alias("last"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country"))


def consent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as decisions, in the order of time: every seventh withdraws."""
    e = app_events(spark, sf_dir).where("name = 'signup'").withColumn("seq", F.substring("event_id", 2, 20).cast("long"))
    q = F.col("seq")
    state = F.when(q % 7 == 0, "withdrawn").when(q % 5 == 0, "denied").otherwise("granted")
    source = F.when(q % 11 == 0, "workspace_default").when(q % 13 == 0, "gpc").otherwise("explicit_ui")
    return e.select("workspace_id", "seq", "subject_key", pick(PURPOSES, q).alias("purpose"), state.alias("state"), source.alias("source"), "at", "jurisdiction", F.lit("v1").alias("notice_version"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as answers to a consent dialog: a map of two purposes, blank jurisdictions and notices among them."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("at", micros(e, "ts")).where("event_type = 'signup'")
    q = F.col("event_id")
    answers = F.create_map(F.lit(PURPOSES[0]), q % 7 != 0, F.lit(PURPOSES[1]), q % 5 != 0)
    return e.select(
        F.concat(F.lit("ws_"), (F.col("user_id") % 12).cast("string")).alias("workspace_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identifier"), answers.alias("purposes"),
        F.when(q % 3 == 0, "").otherwise(pick(JURISDICTIONS, F.col("user_id"))).alias("jurisdiction"), F.when(q % 4 == 0, "").otherwise("v2").alias("notice_version"), "at", q.alias("seq"),
    )


def deals(spark: SparkSession, sf_dir: str, observations: DataFrame) -> DataFrame:
    """One deal for each region, over all cohorts of its shops."""
    r = table(spark, sf_dir, "region").select(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("vertical"), "r_regionkey")
    k = F.col("r_regionkey").cast("long")
    keys = observations.groupBy("vertical").agg(F.array_sort(F.collect_set(F.concat_ws("|", "builder", "vertical", "size_bucket", "period"))).alias("cohort_keys"))
    out = r.join(keys, "vertical", "left")
    return out.select(F.concat(F.lit("deal_"), k.cast("string")).alias("deal_id"), (1_000_001 + 7_919 * k).alias("gross_cents"), (k * 100_000).alias("direct_cost_cents"), F.coalesce("cohort_keys", F.array().cast("array<string>")).alias("cohort_keys"))


def market_deals(spark: SparkSession, observations: DataFrame) -> DataFrame:
    """One deal for each vertical but the first, over all its cohorts."""
    keys = observations.groupBy("vertical").agg(F.collect_set(F.concat_ws("|", "builder", "vertical", "size_bucket", "period")).alias("cohort_keys"))
    sold = spark.createDataFrame([(f"deal_{v}", v) for v in VERTICALS[1:]], "deal_id string, vertical string")
    return sold.join(keys, "vertical", "left").select("deal_id", F.coalesce("cohort_keys", F.array().cast("array<string>")).alias("cohort_keys"))


def requests(spark: SparkSession, sf_dir: str, each: int = 20) -> DataFrame:
    """Raw rows that ask for erasure: every twentieth user of the sample."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("at", micros(e, "ts")).where(F.col("user_id") % each == 3)
    return e.groupBy(F.concat(F.lit("ws_"), (F.col("user_id") % 12).cast("string")).alias("workspace_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identifier")).agg(F.max("at").alias("now"))
