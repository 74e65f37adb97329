"""Operator 3: repeated word sequences, by seed and extend.

Documents are joined on winnowed anchors (the 10-word seed of least hash in
every 20-word window). Around each shared anchor the match is extended both
ways: first over the whole stretch of windows that select the anchor, and where
two stretches differ, window by window. Runs of matching windows are the
maximal repeats; a word goes if such a run covers it and an equal window stands
earlier in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Chunk, Windows, late_windows
from .rolling import Roller, U
from .shared import pack, unpack, with_fields

_codes = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
#: Space and the control characters from tab to carriage return.
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
SLICE = 1 << 17


def word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~_space[text]
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word, slice by slice."""
    start, end = word_edges(text)
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        low = start[i]
        roller = Roller(_codes[text[low : end[j - 1]]])
        out[i:j] = roller.span(start[i:j] - low, end[i:j] - low) + (end[i:j] - start[i:j]).astype(U)
        i = j
    return start, out


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash for every word of one text."""
    return words_of(text)[1]


def substring_dedup(docs: DataFrame, min_words: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its repeated word sequences cut out.

    ``docs``: doc_id, text and the columns named in ``carry``; other columns
    are left out before anything moves. Returns doc_id, the carried columns,
    ``n_words``, ``spans`` (first word and end of each removed run) and
    ``kept`` (the words left, joined by one space).

    Words are runs of anything but space and U+0009 to U+000D, unchanged. A
    null or empty text has no words and keeps ''. Texts shorter than
    ``min_words`` words lose nothing. A null doc_id comes after all others.
    Rows that repeat a doc_id are one document laid over itself: repeats at
    equal offsets stay in each. An empty table gives an empty result. Other columns are left out; a
    carried one with an output's name comes back with ``_given`` behind it.
    """
    given = docs.select("doc_id", "text", pack(carry))
    schema = with_fields(given.select("carried"), "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string")

    def report(chunk: Chunk, rows: pa.Table, covered: list[np.ndarray]) -> pa.Table:
        kept, spans = [], []
        for text, gone in zip(chunk.texts, covered, strict=True):
            start, end = word_edges(text)
            raw = text.tobytes()
            kept.append(b" ".join(raw[start[i] : end[i]] for i in np.flatnonzero(~gone)).decode())
            spans.append(runs(gone))
        size = pa.array([len(x) for x in covered], pa.int64())
        return pa.table({"carried": rows["carried"], "doc_id": rows["doc_id"], "n_words": size, "spans": span_array(spans), "kept": pa.array(kept, pa.string())})

    spec = Windows(length=min_words, seed=max(1, min_words // 2), symbols=word_hashes)
    own = ("n_words", "spans", "kept")
    return late_windows(given, spec, report, schema).select("doc_id", *unpack(carry, own), *own)


def runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def span_array(spans: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    offsets = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
    pair = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(offsets, pair)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
