"""Repeated fixed-length windows of a corpus, found exactly in three shuffles.

A window is ``length`` consecutive symbols (bytes or words) of one document. A
window is *late* if an equal window starts earlier: in a document of smaller
id, or in the same document further left. ``late_windows`` hands every
document's late windows to a callback; the operators for repeated substrings
(words) and for repeated byte strings build on it.

How the work is spread
    Documents are dealt by ranges of doc_id into chunks of about
    ``chunk_bytes``, so that the order of chunks is the order of documents and
    nothing but a chunk number has to travel with a hash.

    1. Each chunk winnows its windows: every window selects one seed (the
       k-gram of least hash), and the windows that share a seed form a stretch
       of text around it, the *unit*. A chunk sends each seed at most once:
       with the unit's hash if all of its units around that seed are equal,
       else with a mark. A seed that millions of documents share therefore
       costs one record a chunk.
    2. Seeds seen by two chunks or more are joined. Where an earlier chunk has
       the same unit, the later one is *covered*: all its windows are late.
       Where units differ, the seed is *open*.
    3. Chunks send the hashes of their windows at open seeds, each once; every
       chunk but the first that has a window hears that it is late.

    What repeats inside a chunk is settled there. Chunks hold bounded text, a
    bucket of hashes gets at most one record a chunk and key, so no task grows
    with a group of copies.

Equality is that of 64-bit hashes of whole windows (seed and window hash for
units). Rows that repeat a doc_id count as one document laid over itself: equal
windows at equal offsets of such rows do not make each other late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .rolling import Roller, U, mix, select_seeds, window_starts
from .shared import give_back, saved

#: Window starts handled at once: their temporaries stay in a core's cache.
BLOCK = 1 << 17
#: Partitions and buckets at most, so that a chunk sends a bounded number of records.
MOST_TASKS = 1 << 16
#: Cuts between ranges of doc_id that travel with the plan.
RANGES = 4096
NO_ID = np.iinfo(np.int64).max
MARK = U(0)


@dataclass(frozen=True)
class Windows:
    """What repeats: ``length`` symbols, winnowed by seeds of ``seed`` symbols."""

    length: int
    seed: int
    symbols: Callable[[np.ndarray], np.ndarray]
    chunk_bytes: int = 2 << 20


@dataclass
class Chunk:
    """One chunk's documents, in order, and the units around their seeds."""

    ids: np.ndarray
    texts: list[np.ndarray]
    sizes: list[int] = field(default_factory=list)
    seeds: np.ndarray | None = None
    units: np.ndarray | None = None
    begin: np.ndarray | None = None
    count: np.ndarray | None = None
    doc: np.ndarray | None = None


def text_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each text's UTF-8 bytes without a copy; nulls are empty."""
    out = []
    for part in column.chunks:
        _, offsets, data = part.buffers()
        wide = np.int64 if pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type) else np.int32
        at = np.frombuffer(offsets, wide)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        null = np.asarray(part.is_null())
        out += [raw[:0] if gone else raw[i:j] for i, j, gone in zip(at[:-1].tolist(), at[1:].tolist(), null.tolist(), strict=True)]
    return out


def pieces(chunk: Chunk, spec: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (symbols, bounds, document of each part, its offset): short documents together, long ones in overlapping parts."""
    held, where, offset, n = [], [], [], 0
    chunk.sizes = [0] * len(chunk.texts)

    def block():
        return np.concatenate(held), np.cumsum([0, *map(len, held)]), np.array(where), np.array(offset)

    for d, text in enumerate(chunk.texts):
        symbols = spec.symbols(text)
        chunk.sizes[d] = len(symbols)
        for at in range(0, max(1, len(symbols) - spec.length + 1), BLOCK):
            part = symbols[at : at + BLOCK + spec.length - 1]
            if len(part) < spec.length:
                continue
            if held and n + len(part) > BLOCK:
                yield block()
                held, where, offset, n = [], [], [], 0
            held.append(part)
            where.append(d)
            offset.append(at)
            n += len(part)
    if held:
        yield block()


def read_chunk(table: pa.Table) -> tuple[Chunk, pa.Table]:
    """The chunk's documents by doc_id; a missing id comes last."""
    ids = table["doc_id"].combine_chunks()
    keys = np.asarray(ids.fill_null(NO_ID)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    return Chunk(keys[order], text_views(table["text"])), table


def find_units(chunk: Chunk, spec: Windows, hold: bool = False) -> list[tuple[Roller, int, np.ndarray]]:
    """Fills in seeds, unit hashes, first windows and window counts.

    With ``hold``, returns for every block its hashes, the number of its first
    unit and where in the block each unit begins.
    """
    seeds, units, begin, count, doc, held, total = [], [], [], [], [], [], 0
    for symbols, bounds, where, offset in pieces(chunk, spec):
        roller = Roller(symbols)
        grams = roller.grams(spec.seed)
        starts, chosen = select_seeds(grams, window_starts(bounds, spec.length), spec.length, spec.seed)
        head = np.ones(len(starts), bool)
        head[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(starts)) - 1
        at, begins = chosen[first], starts[first]
        # the least hashes of their windows: mixed again, or the first buckets would get most of them
        seeds.append(mix(grams[at]))
        units.append(roller.span(begins, starts[last] + spec.length) ^ mix((at - begins).astype(U)) | U(1))
        part = np.searchsorted(bounds, begins, side="right") - 1
        doc.append(where[part])
        begin.append(begins - bounds[part] + offset[part])
        count.append(last - first + 1)
        if hold:
            held.append((roller, total, begins))
        total += len(first)
    chunk.seeds, chunk.units = joined(seeds, U), joined(units, U)
    chunk.begin, chunk.count, chunk.doc = joined(begin, np.int64), joined(count, np.int64), joined(doc, np.int64)
    give_back()
    return held


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def seed_classes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of units by seed, starts of seed groups, group of each ordered unit, True where a group has one class)."""
    order = np.argsort(chunk.seeds, kind="stable")
    s, u = chunk.seeds[order], chunk.units[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    same = np.ones(len(first), bool)
    same[group[u != u[first][group]]] = False
    return order, first, group, same


def dealt(keys: np.ndarray, values: np.ndarray | None, chunk: int, buckets: int) -> pa.Table:
    """Sorted keys (with values) as one binary row for each bucket of the key's range."""
    width = -(-(1 << 64) // buckets)
    edges = np.array([min(b * width, (1 << 64) - 1) for b in range(1, buckets)], U)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    rows = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    blob = lambda i, j: keys[i:j].tobytes() + (values[i:j].tobytes() if values is not None else b"")
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "data": pa.array([blob(i, j) for _, i, j in rows], pa.binary())})


def answer(chunks: np.ndarray, kind: np.ndarray, keys: np.ndarray) -> pa.Table:
    """One binary row of keys for each (chunk, kind)."""
    order = np.lexsort((keys, kind, chunks))
    chunks, kind, keys = chunks[order], kind[order], keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = (chunks[1:] != chunks[:-1]) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(head)
    stop = np.append(first[1:], len(keys)) if len(keys) else first
    return pa.table({"chunk": pa.array(chunks[first], pa.int64()), "kind": pa.array(kind[first], pa.int64()), "data": pa.array([keys[i:j].tobytes() for i, j in zip(first, stop, strict=True)], pa.binary())})


def spread(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A bucket's records: the chunk of each and its ``width`` columns."""
    blobs = [np.frombuffer(x, U).reshape(width, -1) for x in table["data"].to_pylist()]
    chunks = np.repeat(np.asarray(table["chunk"]).astype(np.int64), [b.shape[1] for b in blobs])
    return chunks, list(np.concatenate(blobs, axis=1)) if blobs else [np.zeros(0, U)] * width


def join_seeds(table: pa.Table) -> pa.Table:
    """Of seeds that several chunks have: kind 0 where an earlier chunk has the same unit, else 1 where units differ."""
    chunks, (seeds, units) = spread(table, 2)
    order = np.lexsort((chunks, units, seeds))
    c, s, u = chunks[order], seeds[order], units[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    fresh = np.ones(len(s), bool)
    fresh[1:] = head[1:] | (u[1:] != u[:-1])
    marked = u == MARK
    classes = np.bincount(group, weights=fresh | marked)
    covered = ~fresh & ~marked
    opened = ~covered & (classes[group] > 1) & (size[group] > 1)
    take = covered | opened
    return answer(c[take], opened[take].astype(np.int64), s[take])


def join_windows(table: pa.Table) -> pa.Table:
    """Of windows that several chunks have: kind 2 for every chunk but the first."""
    chunks, (keys,) = spread(table, 1)
    order = np.lexsort((chunks, keys))
    c, w = chunks[order], keys[order]
    late = np.zeros(len(w), bool)
    late[1:] = w[1:] == w[:-1]
    return answer(c[late], np.full(int(late.sum()), 2), w[late])


def heard(table: pa.Table | None, kind: int) -> np.ndarray:
    """The sorted keys of one kind that a chunk was told."""
    if table is None or not table.num_rows:
        return np.zeros(0, U)
    data = [np.frombuffer(x, U) for x, k in zip(table["data"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == kind]
    return np.sort(np.concatenate(data)) if data else np.zeros(0, U)


def among(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def order_keys(chunk: Chunk, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places comparable across the chunk: (rank of doc_id, offset)."""
    rank = np.cumsum(np.append(True, chunk.ids[1:] != chunk.ids[:-1])) - 1
    return (rank[doc] << 40) + at


def late_in_chunk(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for each item whose key also stands at a smaller place."""
    order = np.lexsort((place, keys))
    k, p = keys[order], place[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(head)
    late = np.zeros(len(k), bool)
    late[order] = p > p[first][np.cumsum(head) - 1]
    return late


def send_seeds(spec: Windows, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def job(table: pa.Table) -> pa.Table:
        number = table["chunk"][0].as_py()
        chunk, _ = read_chunk(table)
        find_units(chunk, spec)
        order, first, _, same = seed_classes(chunk)
        units = chunk.units[order][first] if len(first) else chunk.units
        return dealt(chunk.seeds[order][first] if len(first) else chunk.seeds, np.where(same, units, MARK), number, buckets)

    return job


class Resolver:
    """A chunk's late windows, as far as it can tell from what it heard."""

    def __init__(self, chunk: Chunk, spec: Windows, told: pa.Table | None):
        self.chunk = chunk
        held = find_units(chunk, spec, hold=True)
        covered = among(chunk.seeds, heard(told, 0))
        self.opened = among(chunk.seeds, heard(told, 1))
        order, _, group, same = seed_classes(chunk)
        alone = np.zeros(len(order), bool)
        alone[order] = same[group]
        #: Units all of whose windows are late.
        self.whole = covered | (alone & late_in_chunk(chunk.seeds, order_keys(chunk, chunk.doc, chunk.begin)))
        #: The windows of units that differ around one seed, here or elsewhere.
        look = (~alone | self.opened) & ~covered
        unit, skip, key = [], [], []
        for roller, base, begins in held:
            own = np.flatnonzero(look[base : base + len(begins)])
            size = chunk.count[base + own]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            key.append(roller.windows(spec.length, np.repeat(begins[own], size) + step))
            unit.append(np.repeat(base + own, size))
            skip.append(step)
        self.key, self.unit = joined(key, U), joined(unit, np.int64)
        self.doc, self.at = chunk.doc[self.unit], chunk.begin[self.unit] + joined(skip, np.int64)

    def late(self, told: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first late window, number of late windows in a row)."""
        chunk, gone = self.chunk, heard(told, 2)
        lost = late_in_chunk(self.key, order_keys(chunk, self.doc, self.at)) | among(self.key, gone)
        lost &= ~self.whole[self.unit]
        whole = self.whole
        return np.concatenate([chunk.doc[whole], self.doc[lost]]), np.concatenate([chunk.begin[whole], self.at[lost]]), np.concatenate([chunk.count[whole], np.ones(int(lost.sum()), np.int64)])


def send_windows(spec: Windows, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def job(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not len(heard(told, 1)):
            return dealt(np.zeros(0, U), None, 0, 1)
        number = table["chunk"][0].as_py()
        found = Resolver(read_chunk(table)[0], spec, told)
        return dealt(distinct(found.key[found.opened[found.unit]]), None, number, buckets)

    return job


def chunk_numbers(docs: DataFrame, chunk_bytes: int) -> tuple[Column, int]:
    """The number of a document's chunk, in the order of doc_id, and how many there are.

    Cuts are made where so many bytes of text lie before, so that short and
    long documents may stand in any order: a chunk has ``chunk_bytes`` and one
    document more at most. Beyond ``RANGES`` chunks the ranges between cuts are
    split evenly by doc_id. Rows of one doc_id, and those without, stay together.
    """
    place = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    sizes = docs.groupBy(place.alias("place")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    sizes = saved(sizes.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    # a row for each task
    sums = dict(sorted((r["part"], r["b"]) for r in sizes.groupBy("part").agg(F.sum("size").alias("b")).collect()))
    total = max(1, sum(sums.values()))
    n = -(-total // chunk_bytes)
    ranges = min(n, RANGES)
    parts = -(-n // ranges)
    before = np.cumsum([0, *sums.values()])[:-1].tolist()
    offsets = docs.sparkSession.createDataFrame(list(zip(sums, before, strict=True)), "part int, before long")
    so_far = F.sum("size").over(Window.partitionBy("part").orderBy("place"))
    slot = F.floor((F.col("before") + so_far - F.col("size")).cast("double") / F.lit(float(total)) * F.lit(float(ranges)))
    # RANGES rows at most
    starts = [r["p"] for r in sizes.join(F.broadcast(offsets), "part").select("place", slot.alias("slot")).groupBy("slot").agg(F.min("place").alias("p")).collect()]
    last_id = sizes.agg(F.max("place")).first()[0]
    edges = np.array(sorted({*starts, *([last_id] if parts > 1 and starts else [])}) or [0], np.float64)

    # no Python here, so that the stage that deals the documents has no worker beside the chunks' own
    x, last = place.cast("double"), max(0, len(edges) - (2 if parts > 1 else 1))
    at = F.least(F.greatest(F.size(F.filter(F.lit(edges), lambda e: e <= x)) - 1, F.lit(0)), F.lit(last))
    low, high = F.get(F.lit(edges), at), F.get(F.lit(edges), F.least(at + 1, F.lit(len(edges) - 1)))
    within = F.least(F.greatest((x - low) / F.greatest(high - low, F.lit(1.0)) * parts, F.lit(0.0)), F.lit(parts - 1.0))
    return at.cast("long") * parts + F.floor(within), (last + 1) * parts


def late_windows(docs: DataFrame, spec: Windows, report: Callable[[Chunk, pa.Table, list[np.ndarray]], pa.Table], schema: StructType) -> DataFrame:
    """``report(chunk, rows, covered)`` for every chunk, where ``covered[d]`` marks the symbols of document d that a late window covers.

    ``docs`` has doc_id (any whole number, or null: last), text (null: empty)
    and further columns for the report, but none named chunk.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    chunk_of, n = chunk_numbers(docs, spec.chunk_bytes)

    # beyond so many, a task has several chunks, and a bucket more keys; a bucket has the keys of four chunks
    tasks = min(int(n), MOST_TASKS)
    by_chunk = docs.withColumn("chunk", chunk_of).repartition(tasks, "chunk").groupBy("chunk")
    buckets = -(-tasks // 4)
    record, reply = "bucket long, chunk long, data binary", "chunk long, kind long, data binary"
    seeds = by_chunk.applyInArrow(send_seeds(spec, buckets), record)
    # as many tasks as buckets, whatever the session's number of shuffle partitions
    by_bucket = lambda records: records.repartition(tasks, "bucket").groupBy("bucket")
    told = by_bucket(seeds).applyInArrow(join_seeds, reply)
    told = told.repartition(tasks, "chunk")
    windows = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(send_windows(spec, buckets), record)
    later = by_bucket(windows).applyInArrow(join_windows, reply).repartition(tasks, "chunk")
    both = told.unionByName(later)

    def finish(table: pa.Table, heard_all: pa.Table) -> pa.Table:
        chunk, rows = read_chunk(table)
        found = Resolver(chunk, spec, heard_all)
        doc, at, count = found.late(heard_all)
        order = np.argsort(doc, kind="stable")
        doc, at, count = doc[order], at[order], count[order]
        cut = np.searchsorted(doc, np.arange(len(chunk.texts) + 1))
        sizes = chunk.sizes
        covered = []
        for d, size in enumerate(sizes):
            i, j = cut[d], cut[d + 1]
            if i == j:
                covered.append(np.zeros(size, bool))
                continue
            edge = np.zeros(size + 1, np.int32)
            np.add.at(edge, at[i:j], 1)
            np.subtract.at(edge, at[i:j] + count[i:j] - 1 + spec.length, 1)
            covered.append(np.cumsum(edge[:-1]) > 0)
        return report(chunk, rows, covered)

    def guarded(table: pa.Table, heard_all: pa.Table) -> pa.Table:
        return finish(table, heard_all) if table.num_rows else pa.Table.from_batches([], empty)

    empty = to_arrow_schema(schema)
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(guarded, schema)
