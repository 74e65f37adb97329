"""Bloom filters of a table's partitions, as rows: which partitions may hold a key, without reading them.

A filter has ``BITS`` bits in words as long as those of Spark's bitmap
functions, and only words with a bit set have a row. All bits of a key lie in
one word, so a probe is one row for each key and partition, decided by itself.
Summaries of later writes are simply added: the filter of a partition is the
union of its rows. A key that was stored is always found; a partition without
it is named with a probability of about
(1 - exp(-HASHES * keys / BITS)) ** HASHES, and is then read in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES = 1 << 22, 4
#: Bits of a word.
WORD = 1 << 15


def word_of(keys: list[str], bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(-1)), F.lit(max(1, bits // WORD))).alias("word")


def bits_of(keys: list[str], hashes: int = HASHES) -> list[Column]:
    """The bits of a key in its word, from 0; two of them may be the same."""
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(WORD)).alias(f"_b{i}") for i in range(hashes)]


def summary(rows: DataFrame, partition: str, keys: list[str], bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(partition, word, bitmap) of the keys of each partition; one shuffle, pre-aggregated by task."""
    each = rows.select(partition, word_of(keys, bits), *bits_of(keys, hashes))
    own = each.groupBy(partition, "word").agg(*(F.bitmap_construct_agg(f"_b{i}").alias(f"_b{i}") for i in range(hashes)))
    return _union(own.select(partition, "word", F.explode(F.array(*(f"_b{i}" for i in range(hashes)))).alias("bitmap")), partition)


def _union(filters: DataFrame, partition: str) -> DataFrame:
    return filters.groupBy(partition, "word").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def _hits(filters: DataFrame, probes: DataFrame, partition: str, hashes: int) -> DataFrame:
    """The probes (word, bits) with every partition in which all their bits are set."""
    hits = probes.join(_union(filters, partition), "word")
    for i in range(hashes):
        hits = hits.where(is_set(F.col("bitmap"), F.col(f"_b{i}")))
    return hits


def may_hold(filters: DataFrame, asked: DataFrame, partition: str, keys: list[str], bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(partition, keys) that may be together: every key that is stored there, and few others.

    The work is that of a probe for each key and partition; words without a
    bit set are no rows.
    """
    probes = asked.select(*keys).distinct().select(*keys, word_of(keys, bits), *bits_of(keys, hashes))
    return _hits(filters, probes, partition, hashes).select(partition, *keys)


def may_hold_any(filters: DataFrame, asked: DataFrame, partition: str, keys: list[str], bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(partition) of those that may hold any of the keys; of a key only its word and bits are shuffled."""
    probes = asked.select(word_of(keys, bits), *(b.cast("short") for b in bits_of(keys, hashes)))
    return _hits(filters, probes, partition, hashes).select(partition).distinct()
