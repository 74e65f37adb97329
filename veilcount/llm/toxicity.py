"""Operator 9: toxicity, by a factorization machine over hashed terms.

Besides a weight each term has a short factor vector, and two terms that stand
together add the product of their factors: an insult and the mention of a group
may weigh more together than apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import crc_of_id
from .repeats import text_views
from .terms import Sparse, distinct_terms, sigmoid

DIMS = 1 << 17
FACTORS = 4
PREFIX = 5
#: Most labelled documents that the machine is fitted on, the first by hash of doc_id.
SAMPLE = 12_000


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        line = np.bincount(row, self.weight[term], n)
        pair = np.zeros(n)
        for f in range(self.factor.shape[1]):
            x = self.factor[term, f]
            pair += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
        return self.bias + line + pair / 2

    @staticmethod
    def fit(rows: Sparse, label: np.ndarray, epochs: int = 12, alone: int = 3, rate: float = 0.4, least: int = 3, sparse: float = 0.2, shrink: float = 1e-3) -> FactorizationMachine:
        """Follow-the-regularised-leader for the weights, then for the factors of terms that kept a weight.

        Terms in fewer than ``least`` rows stay at 0, as do those whose summed
        gradient stays under ``sparse`` times the root of the number of rows; the
        first ``alone`` rounds fit weights only. Factors of all frequent terms
        were tried: they learn pairs of which neither term tells anything alone,
        but memorise the sample, and find 0.6 to 0.7 of the held-out toxic
        documents instead of 0.99.
        """
        random, sparse = np.random.default_rng(9), sparse * np.sqrt(len(label))
        frequent = np.bincount(rows.ids, minlength=DIMS) >= least
        share = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        fm = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(DIMS), random.normal(0, 0.01, (DIMS, FACTORS)))
        lead, seen_w, seen_v = np.zeros(DIMS), np.ones(DIMS), np.ones((DIMS, FACTORS))
        for epoch in range(epochs if 0 < label.sum() < len(label) else 0):
            order = random.permutation(len(label))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                row, term = rows.take(part)
                row, term = row[frequent[term]], term[frequent[term]]
                kept = fm.weight[term] != 0
                error = sigmoid(fm.margin(row[kept], term[kept], len(part))) - label[part]
                used, place = np.unique(term, return_inverse=True)
                g = np.bincount(place, error[row], len(used))
                grown = seen_w[used] + g * g
                lead[used] += g - (np.sqrt(grown) - np.sqrt(seen_w[used])) / rate * fm.weight[used]
                seen_w[used] = grown
                z = lead[used]
                fm.weight[used] = np.where(np.abs(z) <= sparse, 0, (np.sign(z) * sparse - z) / (np.sqrt(grown) / rate + shrink))
                if epoch < alone:
                    continue
                row, term = row[kept], term[kept]
                used, place = np.unique(term, return_inverse=True)
                for f in range(FACTORS):
                    x = fm.factor[term, f]
                    g = np.bincount(place, error[row] * (np.bincount(row, x, len(part))[row] - x), len(used)) + shrink * fm.factor[used, f]
                    seen_v[used, f] += g * g
                    fm.factor[used, f] -= 0.3 * rate / np.sqrt(seen_v[used, f]) * g
        fm.factor[fm.weight == 0] = 0
        return fm


def terms_of(text: np.ndarray) -> np.ndarray:
    return distinct_terms(text, DIMS, PREFIX)


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[Sparse, np.ndarray]:
    """Terms and labels of a bounded sample; of several labels of one document the greatest counts."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [terms_of(t) for t in text_views(pa.chunked_array([b["text"]]))]
            yield pa.record_batch({"doc_id": b["doc_id"], "y": b["y"], "ids": pa.array(ids, pa.list_(pa.int64()))})

    # broadcast: at most ``sample`` ids
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    rows = text.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id").mapInArrow(extract, "doc_id long, y int, ids array<bigint>").toArrow()
    # rows that repeat a doc_id by their terms, so that the order is always the same
    kinds = [zlib.crc32(np.asarray(x.values).tobytes()) for x in rows["ids"].combine_chunks()] if rows.num_rows else []
    order = np.lexsort((np.array(kinds, np.int64), np.asarray(rows["doc_id"])))
    ids = [np.asarray(x.values) for x in rows["ids"].combine_chunks()] if rows.num_rows else []
    return Sparse([ids[i] for i in order]), np.asarray(rows["y"]).astype(float)[order]


def toxicity(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ``score`` (0 to 1) and ``predicted`` of every document.

    The machine is fitted on at most ``sample`` documents with a label among
    the rows of ``labels`` where ``training`` holds, and scores by the
    lower-cased text alone. Null and empty texts get the score of no term at
    all. Without labels of both kinds every score is the share of label 1 (a
    half if there is none). Repeated rows are scored each, very long texts as a
    whole; other columns are left out.
    """
    rows, label = labelled_terms(docs, labels.where(training), "toxic", sample)
    fm = FactorizationMachine.fit(rows, label)
    used = np.flatnonzero(fm.weight)
    # only terms with a weight travel
    weight, factor, bias = fm.weight[used].astype(np.float32), fm.factor[used].astype(np.float32), fm.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DIMS, len(used))
        place[used] = np.arange(len(used))
        own = FactorizationMachine(bias, np.append(weight, 0), np.vstack([factor, np.zeros((1, FACTORS))]))
        for b in batches:
            out = np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 64):
                texts = text_views(pa.chunked_array([b["text"].slice(at, 64)]))
                found = Sparse([place[terms_of(t)] for t in texts])
                row, term = found.take(np.arange(len(found)))
                out[at : at + 64] = sigmoid(own.margin(row, term, len(found)))
            yield pa.record_batch({"doc_id": b["doc_id"], "score": pa.array(out)})

    given = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    out = given.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, labels, crc_of_id() % 5 != 0)
    return out.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
