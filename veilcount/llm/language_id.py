"""Operator 5: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product
of its letters' vectors, permuted twice, once and not at all; a document is the
bundle (sum) of its trigrams, a language the bundle of its training documents,
and a document speaks the language whose bundle makes the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, pack, unpack, with_fields

DIMS = 512
#: Letters are told apart by their code point modulo this.
LETTERS = 4096
#: Letters handled at once.
BLOCK = 1 << 18
#: Documents handled at once.
ROWS = 512
UNKNOWN = "und"


@cache
def letter_vectors(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a trigram's first, second and third letter; 0 is the gap between words."""
    plain = np.random.default_rng(5).integers(0, 2, (LETTERS + 1, dims), dtype=np.int8) * 2 - 1
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


@cache
def is_letter() -> np.ndarray:
    flags = np.zeros(0x110000, bool)
    for code in range(len(flags)):
        flags[code] = unicodedata.category(chr(code))[0] == "L"
    return flags


def trigram_parts(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the letter trigrams of one text, in parts of bounded size."""
    tail = np.zeros(1, np.int64)
    step = BLOCK // 2
    text = text or ""
    for at in range(0, len(text), step):
        codes = np.frombuffer(text[at : at + step].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter()[codes]
        ids = np.concatenate([tail, np.where(letter, codes % LETTERS + 1, 0), [0] if at + step >= len(text) else []]).astype(np.int64)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
        ids = ids[keep]
        tail = ids[-2:]
        grams = (ids[:-2] << 26) | (ids[1:-1] << 13) | ids[2:]
        yield grams[ids[1:-1] != 0] if len(ids) > 2 else grams[:0]


def bundle(rows: np.ndarray, grams: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Sum of trigram vectors for each row number."""
    key = np.sort((rows << 39) | grams)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(head, len(key)))
    row, gram = key[head] >> 39, key[head] & ((1 << 39) - 1)
    known = np.sort(gram)
    known = known[np.append(True, known[1:] != known[:-1])]
    column = np.searchsorted(known, gram)
    first, second, third = letter_vectors(dims)
    out = np.zeros((n, dims), np.float32)
    for at in range(0, len(known), 4096):
        part = known[at : at + 4096]
        vectors = (first[part >> 26] * second[(part >> 13) & 8191] * third[part & 8191]).astype(np.float32)
        here = (column >= at) & (column < at + len(part))
        counts = np.zeros((n, len(part)), np.float32)
        counts[row[here], column[here] - at] = count[here]
        out += counts @ vectors
    return out


def bundles(texts: list[str | None], rows: list[int], n: int, dims: int = DIMS) -> np.ndarray:
    """Bundles of n rows; text i counts for row rows[i]."""
    out = np.zeros((n, dims))
    held, owner, size = [], [], 0

    def flush() -> None:
        own, at = np.unique(np.array(owner), return_inverse=True)
        out[own] += bundle(np.repeat(at, [len(x) for x in held]), np.concatenate(held), len(own), dims)

    for text, row in zip(texts, rows, strict=True):
        for grams in trigram_parts(text):
            if len(grams):
                held.append(grams)
                owner.append(row)
                size += len(grams)
            if size >= BLOCK:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    return out


def learn_languages(docs: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang) rows, sorted, and their bundles as unit vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b["lang"].to_pylist()
            names = sorted(set(langs))
            for name, v in zip(names, bundles(b["text"].to_pylist(), [names.index(x) for x in langs], len(names), dims), strict=True):
                total[name] = total.get(name, 0) + v
        letter_vectors.cache_clear()
        give_back()
        if total:
            yield pa.record_batch({"lang": pa.array(list(total)), "v": pa.array([v.astype(np.int64) for v in total.values()], pa.list_(pa.int64()))})

    parts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(sums, "lang string, v array<bigint>")
    whole = parts.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x")).toArrow()
    names = sorted(set(whole["lang"].to_pylist()))
    out = np.zeros((len(names), dims))
    for lang, dim, x in zip(*(whole[c].to_pylist() for c in ("lang", "dim", "x")), strict=True):
        out[names.index(lang), dim] = x
    size = np.linalg.norm(out, axis=1)
    names = [n for n, s in zip(names, size, strict=True) if s > 0]
    return names, out[size > 0] / size[size > 0][:, None]


def identify(docs: DataFrame, training: Column, carry: tuple[str, ...] = (), dims: int = DIMS) -> DataFrame:
    """doc_id, the carried columns, ``lang_pred`` and ``score`` (the cosine, 0 if negative) of every document.

    The languages are learned from the rows where ``training`` holds and
    neither text nor lang is null; predictions look at the text alone. A null
    text, one without a letter, and any text if nothing could be learned are
    ``und`` with score 0. Equal cosines go to the language first in the
    alphabet. Repeated rows are predicted each, texts of any length as a whole;
    other columns are left out. A carried ``lang_pred`` or ``score`` comes back
    as ``lang_pred_given`` or ``score_given``. Unlike texts have a cosine of
    about 1 / sqrt(``dims``) by chance.
    """
    names, profiles = learn_languages(docs.where(training), dims)
    table = np.array([*names, UNKNOWN])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            v = bundles(b["text"].to_pylist(), list(range(b.num_rows)), b.num_rows, dims)
            size = np.linalg.norm(v, axis=1)
            best, score = np.full(len(v), len(names)), np.zeros(len(v))
            if names:
                cosine = v @ profiles.T / np.maximum(size, 1e-300)[:, None]
                best = np.where(size > 0, cosine.argmax(1), len(names))
                score = np.where(size > 0, np.clip(cosine.max(1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(table[best].tolist(), pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])
        letter_vectors.cache_clear()
        give_back()

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), pack(carry))
    out = given.mapInArrow(predict, with_fields(given, "lang_pred string, score double"))
    return out.select("doc_id", *unpack(tuple(c for c in carry if c != "doc_id"), ("lang_pred", "score")), "lang_pred", "score")


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, crc_of_id() % 3 != 1)
    return out.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
