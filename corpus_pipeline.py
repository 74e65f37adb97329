"""A training-data pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to a table of the shared folder
and reads them as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilcount.llm.decontaminate import contamination
from veilcount.llm.language_id import UNKNOWN, identify
from veilcount.llm.near_dedup import near_duplicates
from veilcount.llm.pieces import encode
from veilcount.llm.shared import pack, saved, unpack
from veilcount.llm.suffix_dedup import suffix_dedup

#: Cosine under which a text is like no known language: three times the spread of unlike texts, 1 / sqrt(DIMS).
DIMS, LEAST_COSINE = 2048, 0.07
#: Text of a task of the suffix stage: half of what the operator takes, since workers of the stages before it are still there.
CHUNK = 1 << 20
#: No stage of these five can be written as SQL; the tests compare with brute force.
ORACLE_SQL = None


def others(docs: DataFrame, *without: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in without)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose letters are like none of the languages in ``lang``."""
    out = identify(docs.select("doc_id", "text", "lang", pack(docs.columns)), F.lit(True), carry=("text", "carried"), dims=DIMS)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_COSINE)).select(*unpack(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays; rows without doc_id stay too.

    Rows that repeat a doc_id are one document (all that is near to either is in
    its class): of equal ones a single row stays, and rows of one doc_id with
    other texts stay beside one another.
    """
    stay = saved(near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias("stays")).distinct())
    packed = docs.select("doc_id", "text", pack(docs.columns))
    named = packed.where("doc_id is not null").join(stay, F.col("doc_id") == F.col("stays"), "left_semi")
    one = named.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("doc_id"))).where("copy = 1").drop("copy")
    return one.unionByName(packed.where("doc_id is null")).select(*unpack(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that stand earlier in the corpus, in whole characters; null stays null."""
    packed = docs.select("doc_id", "text", pack(docs.columns), F.col("text").isNull().alias("gone"))
    out = suffix_dedup(packed, carry=("carried", "gone"), characters=True, chunk_bytes=CHUNK)
    out = out.select("doc_id", F.when(~F.col("gone"), F.decode("kept", "UTF-8")).alias("text"), "carried").select(*unpack(docs.columns))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.select(F.col("doc_id").alias("leak")).distinct()
    packed = docs.select("doc_id", "text", pack(docs.columns))
    return packed.join(leaks, F.col("doc_id") == F.col("leak"), "left_anti").select(*unpack(docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and scores of each document's N best segmentations; a column of ``docs`` with an output's name gets ``_given`` behind it."""
    return encode(docs, carry=others(docs, "doc_id", "text"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
