"""Countries of addresses, of both families, over ranges that may lie within one another.

A range is cut into cells: all addresses that begin with the same bytes. Cells
with the same beginning but for their last byte make a node, an array of 256,
so an address finds the cell at each depth by a join on its first bytes and
the place of the next one. No event is multiplied and no list is searched,
however many ranges there are, and it works on streams. Within a node a range
is a few blocks of a power of two of cells, which keep the place of their best
range only, so that nodes cost a few numbers for each range.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.functions.ranks import ranked
from veilcount.sources.tables import saved


def cells(first: int, last: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(depth, first bytes, least and greatest next byte) of the cells of a range of addresses of ``size`` bytes."""
    while first <= last:
        depth = size - 1
        # the largest cell that begins here and ends within
        while depth and first % (1 << 8 * (size - depth)) == 0 and first + (1 << 8 * (size - depth)) - 1 <= last:
            depth -= 1
        unit = 1 << 8 * (size - depth - 1)
        low = first // unit % 256
        high = min(255, low + (last - first + 1) // unit - 1)
        yield depth, first // unit // 256, low, high
        first += (high - low + 1) * unit


@cache
def blocks(low: int, high: int) -> list[int]:
    """The cells from low to high as aligned blocks; block b of 256 >> k cells has the number (1 << k) + b, and halves into twice that and one more."""
    found, low, high = [], low + 256, high + 257
    while low < high:
        if low % 2:
            found.append(low)
            low += 1
        if high % 2:
            high -= 1
            found.append(high)
        low, high = low // 2, high // 2
    return found


def address_nodes(ranges: DataFrame) -> DataFrame:
    """(size, depth, prefix, cells): ``ranges`` (first, last, country) as nodes, in a table; a cell has its range's place and country.

    Addresses are texts of either family, or numbers of IPv4. Where ranges
    overlap, the one that starts last counts, then the one that ends first,
    then the country first in the alphabet: that is the one of greatest place.
    Ranges that end before they begin, or of two families, or that aren't
    addresses, cover nothing.
    """

    def number(text: str) -> tuple[int, int] | None:
        try:
            own = ipaddress.ip_address(int(text) if text.isdigit() else text)
        except ValueError:
            return None
        own = getattr(own, "ipv4_mapped", None) or own
        return len(own.packed), int(own)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins, ends, names = [], [], []
            for first, last, country in zip(*(b[c].to_pylist() for c in ("first", "last", "country")), strict=True):
                own = [number(x) if x else None for x in (first, last)]
                if None in own or own[0][0] != own[1][0] or country is None or own[0] > own[1]:
                    continue
                digits = 2 * own[0][0]
                begins.append(f"{own[0][1]:0{digits}x}")
                ends.append(f"{own[1][1]:0{digits}x}")
                names.append(country)
            yield pa.record_batch({"begins": pa.array(begins, pa.string()), "ends": pa.array(ends, pa.string()), "country": pa.array(names, pa.string())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for place, first, last in zip(*(b[c].to_pylist() for c in ("place", "begins", "ends")), strict=True):
                size = len(first) // 2
                for depth, prefix, low, high in cells(int(first, 16), int(last, 16), size):
                    for column, value in zip(out, (size, depth, f"{prefix:0{2 * depth}x}" if depth else "", blocks(low, high), place), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64())
            yield pa.record_batch({c: pa.array(v, t) for c, v, t in zip(("size", "depth", "prefix", "blocks", "place"), out, kinds, strict=True)})

    text = ranges.select(*(F.col(c).cast("string").alias(c) for c in ("first", "last", "country")))
    known = text.mapInArrow(read, "begins string, ends string, country string").distinct()
    placed = saved(ranked(known, [], [F.col("begins"), F.desc("ends"), F.desc("country")], "place"))
    parts = placed.select("place", "begins", "ends").mapInArrow(cut, "size int, depth int, prefix string, blocks array<int>, place long")
    each = parts.select("size", "depth", "prefix", F.explode("blocks").alias("block"), "place")
    best = each.groupBy("size", "depth", "prefix", "block").agg(F.max("place").alias("place"))
    best = best.join(placed.select("place", "country"), "place").select("size", "depth", "prefix", "block", F.struct("place", "country").alias("c"))
    # 511 at most
    held = best.groupBy("size", "depth", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("block", "c"))).alias("m"))
    cell = lambda i: F.array_max(F.array(*(F.try_element_at("m", F.shiftright(i, k)) for k in range(9))))
    return saved(held.select("size", "depth", "prefix", F.transform(F.sequence(F.lit(256), F.lit(511)), cell).alias("cells")))


def address_hex(ip: Column) -> Column:
    """An address's bytes in hex, 8 digits or 32; null if it is none. Mapped IPv4 addresses are IPv4's."""
    text = F.lower(F.trim(ip))
    tail = F.regexp_extract(text, r"\A(?:::ffff:|(?:0{1,4}:){5}ffff:)?([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    octets = F.transform(F.split(tail, r"\."), lambda o: o.try_cast("int"))
    four = F.when((tail != "") & F.forall(octets, lambda o: o < 256), F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), ""))
    sides = F.split(text, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(F.get(sides, F.lit(side)), F.lit("")), ":"), lambda g: g != "")
    left, right = groups(0), groups(1)
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    shaped = text.rlike(r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z")
    full = F.when(F.size(sides) == 1, gap == 0).otherwise((F.size(sides) == 2) & (gap >= 1))
    six = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    six = F.when(shaped & full & text.contains(":"), six)
    return F.coalesce(four, F.when(six.startswith("00000000000000000000ffff"), F.substring(six, 25, 8)).otherwise(six))


def country_of_ip(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds country (null if unknown) and drops the address ``ip``.

    ``ranges`` (first, last, country), or the table that ``address_nodes`` made
    of them; a join for each number of last bytes that its nodes leave, which
    serves both families, so four at most for IPv4.
    """
    nodes = ranges if "cells" in ranges.columns else address_nodes(ranges)
    out, found = events.withColumn("_ip", address_hex(F.col("ip"))), []
    size = F.length("_ip") / 2
    # what has no node's address meets none, and isn't one task's as it would be without a key
    spread = F.concat(F.lit("-"), F.xxhash64(*(c for c, t in events.dtypes if not any(x in t for x in ("map<", "variant")))).cast("string"))
    # sixteen at most
    for left in sorted(r["left"] for r in nodes.select((F.col("size") - F.col("depth")).alias("left")).distinct().collect()):
        name = f"_c{left}"
        own = nodes.where(F.col("size") - F.col("depth") == left).select(F.concat(F.col("size").cast("string"), F.lit(":"), "prefix").alias("_p"), F.col("cells").alias("_cells"))
        depth = (size - left).cast("int")
        key = F.when(depth >= 0, F.concat(size.cast("int").cast("string"), F.lit(":"), F.substring("_ip", F.lit(1), 2 * depth)))
        at = F.conv(F.substring("_ip", 2 * depth + 1, F.lit(2)), 16, 10).cast("int")
        out = out.withColumn("_k", F.coalesce(key, spread)).join(own, F.col("_k") == F.col("_p"), "left").withColumn(name, F.when(F.col("_p").isNotNull(), F.get("_cells", at))).drop("_k", "_p", "_cells")
        found.append(name)
    country = F.array_max(F.array(*map(F.col, found)))["country"] if found else F.lit(None).cast("string")
    return out.withColumn("country", country).drop("ip", "_ip", *found)
