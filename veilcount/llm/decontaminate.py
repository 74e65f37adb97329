"""Operator 8: benchmark decontamination by spaced seeds, in DataFrame functions only.

A spaced seed is a fixed mask over consecutive tokens; the positions where it
has a 0 are ignored, so a substituted word there does no harm. Hashes of the
masked tokens of the benchmark and of the documents are joined. Each hit names
a document, an item and a diagonal (how far the two are shifted); along the
diagonal, tokens are compared one by one, and the document is contaminated if
enough of some run of them agree.

The masks are lossless: wherever the substitutions that the share allows stand
in a run, one mask at one position avoids them all. Runs of each length have
masks of their own, and a document is hashed with those that the benchmark's
items need.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 1: the token counts, 0: any token will do. Masks by length of the run and number of substitutions; they serve longer runs too.
LOSSLESS = {
    (13, 2): ("11101011", "110100111"),
    (10, 2): ("111011", "1101011", "1110011"),
    (7, 1): ("11111", "111101", "110111"),
    (5, 1): ("1111", "11101", "11011", "10111"),
}
#: Tokens of the run that is judged (or the whole item, if shorter), and the share of them that must agree.
RUN = 13
SHARE = 0.8
#: Hashes of the benchmark up to this number are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def token_hashes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, h): the hash of every token; null texts have none."""
    return df.select(key, F.transform(F.coalesce(tokens(F.col(text)), F.array()), lambda t: F.xxhash64(t)).alias("h"))


def allowed(width: int, share: float) -> int:
    """How many of so many tokens may differ."""
    return width - math.ceil(width * share - 1e-9)


def masks_for(width: int, misses: int) -> tuple[str, ...]:
    """Masks of which one fits into a run of ``width`` tokens beside any ``misses`` substitutions."""
    known = [w for w, m in LOSSLESS if m == misses and w <= width]
    # substitutions leave one of misses + 1 equal parts alone
    return LOSSLESS[max(known), misses] if known else ("1" * (width // (misses + 1)),)


def seeds(hashed: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """(key, at, seed): every mask at every position, the mask being part of the hash."""

    def masked(mask: str) -> Column:
        at = [i for i, x in enumerate(mask) if x == "1"]
        return F.when(F.col("at") + len(mask) <= F.size("h"), F.xxhash64(F.lit(int(mask, 2)), *(F.get("h", F.col("at") + o) for o in at)))

    # outer: Spark would filter by size first, and tokenise every text twice
    places = hashed.select(key, "h", F.posexplode_outer("h").alias("at", "_token"))
    return places.select(key, "at", F.explode(F.array(*map(masked, masks))).alias("seed")).where("seed is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, offset, agreeing, run) for every document and benchmark item that it holds.

    A document holds an item if along some diagonal, among ``run`` consecutive
    tokens of the item (all of them, if it has fewer), a share of at least
    ``share`` (above 0) equals the document's. ``offset`` is the diagonal with
    the most agreement (the smallest, if several): the item's first token
    stands at that token of the document; it is negative where the item's start
    is cut off. An item of four tokens or fewer is held by every document that
    has them in a row. Whole texts are compared, also very long ones, whose
    tokens are one array. Texts without tokens, as null ones, match nothing. Rows
    without doc_id or item_id take no part; rows that repeat one count
    together. Empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = token_hashes(benchmark.select("item_id", "text").where("item_id is not null"), "item_id")
    width = F.least(F.lit(run), F.size("h"))
    # a row for each length of run, of which there are at most ``run``
    widths = [w["w"] for w in items.select(width.alias("w")).where("w > 0").distinct().collect()]
    masks = {w: masks_for(w, allowed(w, share)) for w in sorted(widths)}
    if not masks:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.add("item_id", items.schema["item_id"].dataType).add("offset", "long").add("agreeing", "long").add("run", "long"))
    wanted = reduce(DataFrame.unionByName, (seeds(items.where(width == w), "item_id", m) for w, m in masks.items())).distinct()
    # a benchmark is small; if it isn't, the join shuffles
    small = wanted.count() <= BROADCAST_SEEDS
    send = F.broadcast if small else (lambda df: df)
    found = seeds(token_hashes(docs, "doc_id"), "doc_id", tuple(dict.fromkeys(m for own in masks.values() for m in own))).withColumnRenamed("at", "doc_at")
    hits = found.join(send(wanted), "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("offset")).distinct()

    pairs = hits.join(token_hashes(docs, "doc_id").withColumnRenamed("h", "d"), "doc_id").join(send(items.withColumnRenamed("h", "b")), "item_id")
    # get() of a place before or after the text is null
    agree = F.transform("b", lambda x, j: F.coalesce((F.get("d", j + F.col("offset")) == x).cast("int"), F.lit(0)))
    width = F.least(F.lit(run), F.size("b"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x))
    scored = pairs.select("doc_id", "item_id", "offset", agree.alias("same"), width.alias("width"))
    scored = scored.select("doc_id", "item_id", "offset", "width", F.array_max(sums).alias("agreeing"))
    held = scored.where(F.col("agreeing") >= F.ceil(F.col("width") * share - 1e-9))
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("agreeing", (-F.col("offset")).alias("o"), "width")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.o")).cast("long").alias("offset"), F.col("x.agreeing").cast("long").alias("agreeing"), F.col("x.width").cast("long").alias("run"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)


_TOKENS = r"list_filter(regexp_split_to_array(lower({t}.text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


#: The rule itself: where so many of a run's tokens agree, the substitutions leave at least one stretch of g equal tokens
#: between them, g being the agreeing tokens dealt over the stretches; all diagonals with such a stretch are compared.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format(t="documents")} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, t, need, ceil(need / (least({RUN}, len(t)) - need + 1))::INT AS g FROM (SELECT *, ceil(least({RUN}, len(t)) * {SHARE} - 1e-9)::INT AS need FROM (SELECT item_id, {_TOKENS.format(t="benchmark")} AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(t) > 0)),
x AS (SELECT doc_id, g, i AS at, array_to_string(t[i + 1 : i + g], ' ') AS gram FROM (SELECT doc_id, g, t, unnest(range(0, len(t) - g + 1)) AS i FROM d, (SELECT DISTINCT g FROM b))),
y AS (SELECT item_id, g, i AS at, array_to_string(t[i + 1 : i + g], ' ') AS gram FROM (SELECT item_id, g, t, unnest(range(0, len(t) - g + 1)) AS i FROM b)),
hits AS (
  SELECT DISTINCT doc_id, item_id, x.at - y.at AS shift FROM x JOIN y USING (g, gram)
), same AS (
  SELECT doc_id, item_id, shift, least({RUN}, len(b.t)) AS run,
    list_transform(range(0, len(b.t)), lambda j: CASE WHEN j + shift >= 0 AND j + shift < len(d.t) AND d.t[j + shift + 1] = b.t[j + 1] THEN 1 ELSE 0 END) AS e
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), scored AS (
  SELECT doc_id, item_id, shift, run, list_max(list_transform(range(0, len(e) - run + 1), lambda i: list_sum(e[i + 1 : i + run]))) AS agreeing FROM same
), held AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, shift) AS k FROM scored WHERE agreeing >= ceil(run * {SHARE} - 1e-9)
)
SELECT doc_id, item_id, shift::BIGINT AS "offset", agreeing::BIGINT AS agreeing, run::BIGINT AS run FROM held WHERE k = 1
"""
