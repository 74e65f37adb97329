"""Operator 11: vectors as short codes, by product quantisation in whole numbers.

A part of a vector and an entry of its codebook are padded with zeros to a
power of two P and put through the Walsh-Hadamard transform. It keeps squared
distances but for the factor P, and moves most of a difference into the few
coefficients of lowest sequency. So scaled squared differences are added up in
the order of sequency, and an entry is given up as soon as its sum exceeds the
whole distance of the entry that looked best at first. All of it is integer
arithmetic: 64 bits where no sum can exceed them, else Python's own integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Label sums up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 65_536
#: Rows that are compared with the codebooks at a time.
ROWS = 4096
#: Sums travel as signed digits of so many bits, so that they may be of any size.
DIGIT = 40


def sequency_order(size: int) -> list[int]:
    """Rows of the Hadamard matrix of a power of two, by their number of sign changes: bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    return [int(f"{(i ^ i >> 1):0{bits}b}"[::-1], 2) if bits else 0 for i in range(size)]


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows, zero-padded to a power of two, in sequency order."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size), x.dtype)
    out[:, : x.shape[1]] = x
    step = 1
    while step < size:
        pairs = out.reshape(len(x), -1, 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), size)
        step *= 2
    return out[:, sequency_order(size)]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, scaled squared distance) of the coefficients ``c`` that are nearest to each row of ``x``; ties to the lower entry."""
    first = (x[:, :1] - c[None, :, 0]) ** 2
    bound = ((x - c[first.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for s in range(1, x.shape[1]):
        total = total + (x[row, s] - c[entry, s]) ** 2
        live = total <= bound[row]
        row, entry, total = row[live], entry[live], total[live]
    out = np.repeat(bound[:, None] + 1, len(c), axis=1)
    out[row, entry] = total
    best = out.argmin(1)
    return best, out[np.arange(len(x)), best]


def floors(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component as whole numbers, short vectors filled with zeros; Python integers if 64 bits don't do."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, int)
    flat = np.asarray(vectors.flatten()).astype(float)
    x = np.zeros((len(size), width))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    if np.abs(x).max(initial=0) * scale < 2**40:
        return np.floor(x * scale).astype(np.int64)
    # a batch's sums have room in 64 bits above; here products may have more bits than a double
    ratios = [v.as_integer_ratio() for v in x.ravel().tolist()]
    return np.array([a * scale // b for a, b in ratios], dtype=object).reshape(x.shape)


@dataclass
class Codebooks:
    """``entries[j]``: whole numbers, one row for each entry of part j."""

    entries: list[np.ndarray]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.entries for v in book.ravel()).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its numbers, entry and squared distance of each row) for every part."""
        width = self.entries[0].shape[1]
        for j, book in enumerate(self.entries):
            part = x[:, j * width : (j + 1) * width]
            code, error = np.zeros(len(x), np.int64), np.zeros(len(x), object)
            own = np.abs(part).max(axis=1, initial=0)
            size = 1 << max(0, width - 1).bit_length()
            # the transform's sums of squares stay under size * width * (2 * largest)**2
            most = math.isqrt(2**62 // (4 * size * max(1, width)))
            small = ((own <= most) & bool(np.abs(book).max(initial=0) <= most)).astype(bool)
            for rows, kind in ((np.flatnonzero(small), np.int64), (np.flatnonzero(~small), object)):
                if len(rows):
                    c = walsh(book.astype(kind))
                    for at in range(0, len(rows), ROWS):
                        some = rows[at : at + ROWS]
                        code[some], error[some] = nearest(walsh(part[some].astype(kind)), c)
            yield j, part, code, error // size

    def table(self, spark: SparkSession) -> DataFrame:
        """(part, entry, components as decimal texts)."""
        rows = [(j, e, [str(int(v)) for v in row]) for j, book in enumerate(self.entries) for e, row in enumerate(book)]
        return spark.createDataFrame(rows, "part int, entry int, components array<string>")


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, signed digit) of a number."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << DIGIT) - 1))
        value, place = value >> DIGIT, place + 1


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    x = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("v"))
    return x.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def fit(kept: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[Codebooks, int]:
    """Codebooks after so many rounds, and the width of a whole vector; sums of the parts of an entry are taken by Spark."""
    width = parts * -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    # bounded: as many rows as a codebook has entries
    start = floors(kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"], width, scale).astype(object)
    own = width // parts
    books = Codebooks([start[:, j * own : (j + 1) * own] for j in range(parts)])
    if not len(start) or not own:
        return books, width
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros(b.shape, object) for b in books.entries], [np.zeros(len(b), np.int64) for b in books.entries]
            for batch in batches:
                for j, part, code, _ in books.assign(floors(batch["v"], width, scale)):
                    counts[j] += np.bincount(code, minlength=len(counts[j]))
                    for e in np.unique(code):
                        sums[j][e] += part[code == e].sum(axis=0).astype(object)
            rows = [(j, e, -1, 0, int(n)) for j, c in enumerate(counts) for e, n in enumerate(c) if n]
            rows += [(j, e, i, place, d) for j, s in enumerate(sums) for (e, i), v in np.ndenumerate(s) for place, d in digits(int(v))]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "component", "place", "value"])

        found = kept.select("v").mapInArrow(summed, "part long, entry long, component long, place long, value long")
        total = found.groupBy("part", "entry", "component", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        new, counts = [np.zeros(b.shape, object) for b in books.entries], [[0] * len(b) for b in books.entries]
        # bounded by the codebooks' own size
        for r in total.collect():
            if r["component"] < 0:
                counts[r["part"]][r["entry"]] = int(r["value"])
            else:
                new[r["part"]][r["entry"], r["component"]] += int(r["value"]) << (DIGIT * r["place"])
        books = Codebooks([np.array([[v // n for v in s] if n else list(old) for s, n, old in zip(new[j], counts[j], book, strict=True)], object).reshape(book.shape) for j, book in enumerate(books.entries)])
    return books, width


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(key, code, error, label_error, codebooks_sha256) of every vector, and the codebooks.

    Vectors that are null or hold null or non-finite components take no part.
    Vectors of unequal length are compared as if the shorter went on with zeros,
    and so is a length that isn't a multiple of ``parts``. Fewer vectors than
    entries give smaller codebooks; empty vectors alone give codes of zeros
    and no component. Rows that repeat a key are vectors each; among the first
    ones they go by their components, and rows without a key come last. Null
    labels count as one label. An error, or a label's sum, that doesn't fit
    into 64 bits is null; codes are exact at any size. Other columns are left
    out, so their names cannot clash. An empty table gives no row.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    kept = usable(rows, key, vector, label)
    books, width = fit(kept, parts, entries, rounds, scale)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, object)
            if width:
                for j, _, own, far in books.assign(floors(b["v"], width, scale)):
                    code[:, j] = own
                    error = error + far
            text = code.tobytes().hex()
            texts = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(b.num_rows)]
            yield pa.record_batch({"id": b["id"], "label": b["label"], "code": pa.array(texts, pa.string()), "error": pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())})

    kinds = dict(kept.dtypes)
    tables = Tables(rows.sparkSession)
    done = tables.saved(kept.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count_if(F.col("error").isNull()) == 0) & (total <= F.lit(2**63 - 1).cast("decimal(20,0)")), total.cast("long"))
    sums = tables.saved(done.groupBy(F.col("label").alias("same")).agg(whole.alias("label_error")))
    small = F.broadcast if sums.count() <= BROADCAST_LABELS else (lambda df: df)
    out = done.join(small(sums), F.col("label").eqNullSafe(F.col("same")), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256")), books


def decompress(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the middle of what each component's entry stands for."""
    entries = [np.array([[(int(v) + 0.5) / scale for v in row] for row in book]) for book in books.entries]
    table = F.array(*(F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in book)) for book in entries))
    part = lambda j: F.get(F.get(table, F.lit(j)), F.conv(F.substring("code", 2 * j + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("vector", F.concat(*(part(j) for j in range(len(entries)))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _round(r: int) -> str:
    return f"""
, a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min({_FAR} * 16 + c.entry) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.vec_id, p.label, p.part
), s{r} AS (
  SELECT part, entry, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS x FROM (
    SELECT part, best % 16 AS entry, i, sum(x[i]) AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL
  ) GROUP BY part, entry
), c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON c.part = s.part AND c.entry = s.entry
)"""


_FAR = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
OP11_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(part)
), f AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}
), c0 AS MATERIALIZED (SELECT part, entry::HUGEINT AS entry, x FROM p JOIN f USING (vec_id)){"".join(map(_round, range(ROUNDS)))}
, z AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, min({_FAR} * 16 + c.entry) AS best FROM p JOIN c{ROUNDS} c ON p.part = c.part GROUP BY p.vec_id, p.label, p.part
), e AS (
  SELECT vec_id, label, string_agg(printf('%02x', (best % 16)::INT), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM z GROUP BY vec_id, label
), l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e GROUP BY label),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{ROUNDS}))
SELECT e.vec_id, e.code, e.error, l.label_error, h.codebooks_sha256 FROM e JOIN l ON e.label IS NOT DISTINCT FROM l.label, h
"""
