"""Operator 6: repeated byte strings, by fingerprints of windows.

This stands in for prefix-free parsing. Rolling-hash triggers (the 50-byte
string of least hash in some 100-byte window) cut every text into phrases, as
there, and a phrase that recurs is settled once for all its windows. But
phrases aren't ranked, and no suffix array is built: where one trigger has
several phrases, their 100-byte windows are compared by fingerprints. The
result depends only on which windows are equal and which of them stands first,
and both come out exactly (as far as 64-bit fingerprints tell strings apart).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Chunk, Windows, late_windows
from .rolling import U
from .shared import pack, unpack, with_fields
from .substring_dedup import runs, span_array

CHUNK = 2 << 20
_codes = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)


def byte_symbols(text: np.ndarray) -> np.ndarray:
    return _codes[text]


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Without the bytes of characters that are removed only in part."""
    first = np.flatnonzero((text & 0xC0) != 0x80)
    if not len(first):
        return gone
    size = np.diff(np.append(first, len(text)))
    return np.repeat(np.add.reduceat(gone.astype(np.int64), first) == size, size)


def suffix_dedup(docs: DataFrame, min_bytes: int = 100, carry: tuple[str, ...] = (), characters: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """Each document with its repeated byte strings cut out.

    ``docs``: doc_id, text and the columns named in ``carry``. Returns doc_id,
    the carried columns, ``n_bytes``, ``spans`` (first byte and end of each
    removed run) and ``kept`` (binary, the bytes left). With ``characters``
    a character goes only as a whole, so ``kept`` is valid UTF-8. So many bytes
    of text, ``chunk_bytes``, are in a task's memory at once.

    Texts are taken as UTF-8 bytes; null is empty. Texts under ``min_bytes``
    lose nothing. A null doc_id comes after all others. Rows that repeat a
    doc_id are one document laid over itself: repeats at equal offsets stay in
    each. An empty table gives an empty result. Other columns are left out; a
    carried one with an output's name comes back with ``_given`` behind it.
    """
    given = docs.select("doc_id", "text", pack(carry))
    schema = with_fields(given.select("carried"), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

    def report(chunk: Chunk, rows: pa.Table, covered: list[np.ndarray]) -> pa.Table:
        if characters:
            covered = [whole_characters(t, g) if g.any() else g for t, g in zip(chunk.texts, covered, strict=True)]
        kept = [(t[~g] if g.any() else t).tobytes() for t, g in zip(chunk.texts, covered, strict=True)]
        size = pa.array([len(x) for x in covered], pa.int64())
        return pa.table({"carried": rows["carried"], "doc_id": rows["doc_id"], "n_bytes": size, "spans": span_array([runs(g) for g in covered]), "kept": pa.array(kept, pa.binary())})

    spec = Windows(length=min_bytes, seed=max(1, min_bytes // 2), symbols=byte_symbols, chunk_bytes=chunk_bytes)
    own = ("n_bytes", "spans", "kept")
    return late_windows(given, spec, report, schema).select("doc_id", *unpack(carry, own), *own)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
