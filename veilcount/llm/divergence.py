"""Operator 12: how the sources of a language differ in what words they use.

The kept terms of each language, sorted, become minimal acyclic transducers: a
term's path adds up to its ordinal, its place among all terms of the language
in the order of UTF-8 bytes. Texts are streamed through them to recount the
terms, from then on a term is its ordinal, and ties go by ordinals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import text_views
from .shared import Tables

LEAST_DOCUMENTS, UNIT, MOST_TERMS = 3, 1_000_000_000, 200
#: A transducer is built of so many bytes of sorted terms at most (or of one longer term).
BLOCK_BYTES = 2 << 20
#: So many bytes of transducers are broadcast for one pass over the texts; more vocabulary takes more passes.
PASS_BYTES = 64 << 20
#: Text that is streamed at a time, and entries of a task's table of counts before it is handed on.
SLICE, HELD = 1 << 20, 1 << 18
#: Terms and sources of a tile whose divergences one task adds up.
TERMS, SOURCES = 4096, 64
#: Cells of the transition tables that a task lays out in full; further transducers are searched.
CELLS = 1 << 24
#: Tables of groups up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 65_536

#: Letters of either case and all bytes of longer characters are inside a term; A-Z becomes a-z.
_fold = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def parts(text: np.ndarray) -> Iterator[bytes]:
    """The folded text in slices that end where a term does."""
    whole = bytes(text).translate(_fold)
    at = 0
    while at < len(whole):
        end = min(len(whole), at + SLICE)
        if end < len(whole):
            cut = whole.rfind(b" ", at, end)
            end = cut if cut > at else whole.find(b" ", end)
            end = len(whole) if end < 0 else end
        yield whole[at:end]
        at = end


@dataclass
class Transducer:
    """States are numbered, 0 is the start. ``edges``: state * 256 + byte, ascending; each leads ``to`` a state and adds ``out``."""

    edges: np.ndarray
    to: np.ndarray
    out: np.ndarray
    final: np.ndarray

    @staticmethod
    def build(terms: list[bytes]) -> Transducer:
        """Of ascending, distinct terms: a state is shared with its like as soon as no later term can extend it."""
        register: dict[tuple, int] = {}
        below: list[int] = []  # terms that a finished state leads to
        kept: list[tuple] = []
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                like = (final, tuple(edges))
                state = register.get(like)
                if state is None:
                    state = register[like] = len(kept)
                    kept.append(like)
                    below.append(final + sum(below[s] for _, s in edges))
                path[-1][1].append((last[len(path) - 1], state))

        for term in terms:
            same = 0
            while same < min(len(term), len(last)) and term[same] == last[same]:
                same += 1
            close(same)
            path += [(False, []) for _ in term[same:]]
            path[-1] = (True, path[-1][1])
            last = term
        close(0)
        edges, to, out, final = [], [], [], []
        # the start first, finished states one behind their number
        for number, (ends, own) in enumerate([path[0], *kept]):
            final.append(ends)
            before = int(ends)
            for byte, state in own:
                edges.append(number * 256 + byte)
                to.append(state + 1)
                out.append(before)
                before += below[state]
        return Transducer(np.array(edges, np.int64), np.array(to, np.int32), np.array(out, np.int32), np.array(final, bool))

    def pack(self) -> bytes:
        sizes = np.array([len(self.edges), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.edges, self.to, self.out, self.final))

    @staticmethod
    def unpack(data: bytes) -> Transducer:
        n, states = np.frombuffer(data, np.int64, 2)
        at, found = 16, []
        for kind, size in ((np.int64, n), (np.int32, n), (np.int32, n), (bool, states)):
            found.append(np.frombuffer(data, kind, size, at))
            at += found[-1].nbytes
        return Transducer(*found)

    def laid_out(self, cells: int) -> Transducer:
        """Ready for ``ordinals``: with the transitions as a table, if it has no more than so many cells."""
        used = np.unique(self.edges % 256)
        self.kinds = np.full(256, len(used), np.int64)
        self.kinds[used] = np.arange(len(used))
        self.wide, self.table = len(used) + 1, None
        if len(self.final) * self.wide <= cells:
            self.table = np.full(len(self.final) * self.wide, -1, np.int32)
            self.table[self.edges // 256 * self.wide + self.kinds[self.edges % 256]] = np.arange(len(self.edges), dtype=np.int32)
        return self

    def ordinals(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``text[start:end]``, -1 of those that aren't in the vocabulary: all are streamed side by side, a byte a step."""
        found = np.full(len(start), -1, np.int64)
        if not len(self.edges):
            return found
        place, state, total = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        step = 0
        while len(place):
            byte = text[start[place] + step]
            if self.table is not None:
                edge = self.table[state * self.wide + self.kinds[byte]]
                live = edge >= 0
            else:
                key = state * 256 + byte
                edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                live = self.edges[edge] == key
            place, edge = place[live], edge[live]
            state, total = self.to[edge].astype(np.int64), total[live] + self.out[edge]
            step += 1
            over = start[place] + step == end[place]
            done = over & self.final[state]
            found[place[done]] = total[done]
            place, state, total = place[~over], state[~over], total[~over]
        return found


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of each language that hold the term, counted within tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "term": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})
            held.clear()

        size = entries = 0
        for b in batches:
            langs = b["lang"].to_pylist()
            for lang, text in zip(langs, text_views(pa.chunked_array([b["text"]])), strict=True):
                own: set[bytes] = set()
                for part in parts(text):
                    own.update(part.split())
                found = held.setdefault(lang, Counter())
                entries -= len(found)
                found.update(own)
                entries += len(found)
                size += len(text)
                if size > 64 * SLICE or entries > HELD:
                    yield from hand_on()
                    size = entries = 0
        yield from hand_on()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def transducers(kept: DataFrame, total: int) -> DataFrame:
    """(lang, first, terms, data, words) of blocks of the sorted kept terms (lang, term), each built by one task."""
    ranged = kept.select("lang", "term").repartitionByRange(max(1, min(-(-total // BLOCK_BYTES), 65_536)), "lang", "term").sortWithinPartitions("lang", "term")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, size = None, [], 0

        def block() -> pa.RecordBatch:
            return pa.record_batch({"lang": pa.array([lang], pa.string()), "first": pa.array(terms[:1], pa.binary()), "terms": pa.array([len(terms)], pa.int64()), "data": pa.array([Transducer.build(terms).pack()], pa.binary()), "words": pa.array([terms], pa.list_(pa.binary()))})

        for b in batches:
            for own, term in zip(b["lang"].to_pylist(), b["term"].to_pylist(), strict=True):
                if terms and (own != lang or size + len(term) > BLOCK_BYTES):
                    yield block()
                    terms, size = [], 0
                lang = own
                terms.append(term)
                size += len(term)
        if terms:
            yield block()

    return ranged.mapInArrow(build, "lang string, first binary, terms long, data binary, words array<binary>")


def recounted(docs: DataFrame, blocks: dict[str, list[tuple[int, bytes]]]) -> DataFrame:
    """(lang, source, ordinal, n) of the texts' terms that are in the given blocks (by language: offset, packed transducer)."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, list[tuple[int, Transducer]]] = {}
        cells = CELLS
        for lang, own in shared.value.items():
            for offset, data in own:
                machine = Transducer.unpack(data).laid_out(cells)
                cells -= 0 if machine.table is None else len(machine.table)
                ready.setdefault(lang, []).append((offset, machine))
        held: dict[tuple[str, str], list] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                ordinal, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()), "ordinal": pa.array(ordinal), "n": pa.array(n, pa.int64())})
            held.clear()

        for b in batches:
            langs, sources = b["lang"].to_pylist(), b["source"].to_pylist()
            # texts of one group side by side, as many as make a slice
            waiting: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(langs, sources, text_views(pa.chunked_array([b["text"]])), strict=True):
                if lang in ready:
                    for part in parts(text):
                        waiting.setdefault((lang, source), []).append(part)
            for group, texts in waiting.items():
                at = 0
                while at < len(texts):
                    some, length = [], 0
                    while at < len(texts) and length < SLICE:
                        some.append(texts[at])
                        length += len(texts[at])
                        at += 1
                    text = np.frombuffer(b" ".join([b"", *some, b""]), np.uint8)
                    inner = text != 0x20
                    start, end = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1, np.flatnonzero(~inner[1:] & inner[:-1]) + 1
                    for offset, machine in ready[group[0]]:
                        found = machine.ordinals(text, start, end)
                        held.setdefault(group, []).append(found[found >= 0] + offset)
                        size += len(held[group][-1])
            if size > 8 * HELD:
                yield from hand_on()
                size = 0
        yield from hand_on()

    return docs.select("lang", "source", "text").mapInArrow(stream, "lang string, source string, ordinal long, n long")


def small(df: DataFrame) -> DataFrame:
    """For a join: broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exactly."""
    return F.expr(f"1 + cast({n} + 1 as decimal(19,0)) * {UNIT}bd div cast({total} + kept as decimal(20,0))")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for a matrix of counts and the sum of total and kept of each row."""
    kind = np.int64 if n.max(initial=0) < (1 << 63) // UNIT - 1 else object
    return 1 + (UNIT * (n.astype(kind) + 1) // total.astype(kind)[:, None]).astype(np.int64)


def tile(table: pa.Table, sources: int) -> pa.Table:
    """(lang, own, other, value): the summed divergences of pairs of sources over the terms of one tile.

    Rows without ``term`` name a source (``own``), its total and how many terms
    the tile has; the others are its counts.
    """
    lang, side = table["lang"][0].as_py(), [table[c][0].as_py() for c in ("a", "b")]
    own, n, term = (np.asarray(table[c].combine_chunks().fill_null(-1)) for c in ("own", "n", "term"))
    named = np.flatnonzero(term < 0)
    named = named[np.argsort(own[named])]
    who, width = own[named], int(table["terms"][int(named[0])].as_py())
    counts = np.zeros((len(who), width), np.int64)
    rest = np.flatnonzero(term >= 0)
    counts[np.searchsorted(who, own[rest]), term[rest]] = n[rest]
    total = np.asarray(table["total"].combine_chunks().fill_null(0))[named]
    p = shares(counts, np.maximum(total, 1))
    left, right = (np.flatnonzero((who - 1) // sources == s) for s in side)
    found = []
    for mine, others in ((left, right),) if side[0] == side[1] else ((left, right), (right, left)):
        for i in mine:
            value = ((p[i] - p[others]) ** 2 // p[others]).sum(axis=1)
            found += [(int(who[i]), int(who[j]), int(v)) for j, v in zip(others, value, strict=True) if i != j]
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), **{c: pa.array(x, pa.int64()) for c, x in zip(("own", "other", "value"), columns, strict=True)}})


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, own, other, value) of all pairs of sources of a language, by tiles of ordinals and of sources."""
    tiles = F.expr(f"transform(sequence(0, cast((sources - 1) div {SOURCES} as int)), t -> struct(least(t, mine) as a, greatest(t, mine) as b))")
    mine = F.expr(f"cast((own - 1) div {SOURCES} as int)")
    blocks = F.explode(F.expr(f"sequence(0L, greatest(kept - 1, 0L) div {TERMS})"))
    heads = groups.withColumn("mine", mine).select("*", blocks.alias("block")).select("lang", "block", F.explode(tiles).alias("t"), "own", F.expr(f"least(kept - block * {TERMS}, {TERMS})").alias("terms"), (F.col("total") + F.col("kept")).alias("total"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("long").alias("n"))
    found = counts.withColumn("mine", mine).select("lang", F.expr(f"ordinal div {TERMS}").alias("block"), F.explode(tiles).alias("t"), "own", F.lit(None).cast("long").alias("terms"), F.lit(None).cast("long").alias("total"), F.expr(f"ordinal % {TERMS}").alias("term"), "n")
    both = heads.unionByName(found).select("lang", "block", "t.a", "t.b", "own", "terms", "total", "term", "n")
    each = both.groupBy("lang", "block", "a", "b").applyInArrow(lambda table: tile(table, SOURCES), "lang string, own long, other long, value long")
    return each.groupBy("lang", "own", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source.

    Part ``pair`` has the group's divergence from each other source of the
    language, over all kept terms; part ``term`` the ``most`` terms that the
    group has more of than its language. Null text, lang and source count as
    ``''``; every row is a document, also one that repeats a doc_id; texts are
    read as a whole, in slices that end between terms. A group without terms
    diverges like one that has every kept term equally often, and a language
    without kept terms has values of 0. Equal values go by item in the order
    of UTF-8 bytes. Other columns are left out, so their names cannot clash;
    an empty table gives no row.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = tables.saved(document_terms(docs).where(F.col("n") >= least))
    total = kept.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = tables.saved(transducers(kept, total))
    # a row for each block of BLOCK_BYTES, and one for each language
    offsets, place = [], Counter()
    for r in sorted(blocks.select("lang", "first", "terms").collect()):
        offsets.append((r["lang"], r["first"], place[r["lang"]]))
        place[r["lang"]] += r["terms"]

    passes: list[DataFrame] = []
    ready: dict[str, list[tuple[int, bytes]]] = {}
    size = 0

    def run() -> None:
        passes.append(tables.saved(recounted(docs, ready).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))

    # one block after the other, and never more than one pass holds
    for (lang, _, offset), r in zip(offsets, blocks.orderBy("lang", "first").select("lang", "data").toLocalIterator(), strict=True):
        if ready and size + len(r["data"]) > PASS_BYTES:
            run()
            ready, size = {}, 0
        ready.setdefault(lang, []).append((offset, bytes(r["data"])))
        size += len(r["data"])
    run()
    counts = passes[0]
    for more in passes[1:]:
        counts = counts.unionByName(more)

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    by_lang = Window.partitionBy("lang")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").select("lang", "source", zero("total"), zero("kept"))
    groups = tables.saved(groups.select("*", F.row_number().over(by_lang.orderBy("source")).cast("long").alias("own"), F.count("*").over(by_lang).alias("sources"), F.sum("total").over(by_lang).alias("all")))
    counted = tables.saved(counts.join(small(groups), ["lang", "source"]))

    names = small(groups.select("lang", F.col("own").alias("number"), F.col("source").alias("name")))
    pairs = pair_values(counted, groups)
    pairs = pairs.join(names.withColumnRenamed("number", "own").withColumnRenamed("name", "source"), ["lang", "own"]).join(names.withColumnRenamed("number", "other").withColumnRenamed("name", "item"), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    usual = counted.groupBy("lang", "ordinal").agg(F.sum("n").alias("everywhere"))
    terms = counted.join(usual, ["lang", "ordinal"]).withColumns({"p": share("n", "total"), "q": share("everywhere", "all")}).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = terms.select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    places = spark.createDataFrame(offsets, "lang string, first binary, offset long")
    words = blocks.select("lang", "first", "words").join(F.broadcast(places), ["lang", "first"]).select("lang", "offset", F.posexplode("words").alias("i", "term"))
    words = words.select("lang", (F.col("offset") + F.col("i")).alias("ordinal"), F.decode("term", "UTF-8").alias("item"))
    terms = terms.join(words, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}
), v AS (SELECT lang, count(*) AS kept FROM k GROUP BY lang
), c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, sum(coalesce(total, 0)) OVER (PARTITION BY lang) AS everything
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + kept) AS p, everything + kept AS below
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), q AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n) + 1)) // any_value(below) AS q FROM p GROUP BY lang, term
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term QUALIFY rank <= {MOST_TERMS}
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r
"""
