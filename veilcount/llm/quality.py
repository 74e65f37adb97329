"""Operator 4: document quality, by co-training two views.

One classifier sees the text's content (hashed words and their shapes), the
other only what is known about the page (source, language, length).
Both start from labelled documents. In every round each names the unlabelled
documents that it is surest of, and the other learns from them too. Then each
view is calibrated on labelled documents kept apart, and a last small model
weighs the two calibrated views against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import text_views
from .terms import Sparse, distinct_terms, sigmoid

CONTENT, PAGE = 1 << 15, 1 << 12
#: Most labelled and unlabelled documents that are fitted on, the first by hash of doc_id.
LABELLED, POOL = 8_000, 8_000
ROUNDS, EXCHANGED, SURE = 4, 600, 0.95
COLUMNS = ("source", "lang", "n_chars")


def level(share: float) -> int:
    """0 for nothing, then seven steps of a share."""
    return 0 if share <= 0 else 1 + int(np.searchsorted((0.01, 0.03, 0.08, 0.2, 0.4, 0.7), share))


def shape_terms(text: np.ndarray, words: int, different: int) -> np.ndarray:
    """Numbers below 128: shares of capitals, digits and marks, and of words that are repeated."""
    n = max(1, len(text))
    marks = np.bincount(text, minlength=256)
    capitals, digits = marks[65:91].sum(), marks[48:58].sum()
    odd = sum(marks[ord(c)] for c in "%*#$&~^_=<>")
    shares = (capitals / n, digits / n, marks[33] / n, marks[124] / n, odd / n, 1 - different / max(1, words), marks[10] / n, (marks[44] + marks[46]) / n)
    return np.array([*(8 * i + level(float(x)) for i, x in enumerate(shares)), 64 + min(15, int(np.log2(1 + words))), 80 + min(15, int(n / max(1, words)))])


def content_terms(text: np.ndarray) -> np.ndarray:
    found = distinct_terms(text, CONTENT - 128) + 128
    inner = np.concatenate([[False], text > 32])
    words = int((inner[1:] & ~inner[:-1]).sum())
    return np.concatenate([shape_terms(text, words, len(found)), found])


def page_terms(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = np.log2(1 + max(0, n_chars or 0))
    known = [f"s{source}", f"l{lang}", f"c{int(2 * size)}", f"s{source} l{lang}", f"l{lang} c{int(size)}"]
    hashed = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") % PAGE for x in known]
    return np.unique(np.array(hashed, np.int64))


@dataclass
class Linear:
    bias: float
    weight: np.ndarray

    def margin(self, rows: Sparse) -> np.ndarray:
        row, term = rows.take(np.arange(len(rows)))
        return self.bias + np.bincount(row, self.weight[term], len(rows))

    @staticmethod
    def fit(rows: Sparse, label: np.ndarray, dims: int, epochs: int = 6, rate: float = 0.3, sparse: float = 0.2) -> Linear:
        """Logistic regression by the follow-the-regularised-leader rule."""
        random, sparse = np.random.default_rng(4), sparse * np.sqrt(len(label))
        share = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        model = Linear(float(np.log(share / (1 - share))), np.zeros(dims))
        lead, seen = np.zeros(dims), np.ones(dims)
        for _ in range(epochs if 0 < label.sum() < len(label) else 0):
            order = random.permutation(len(label))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                row, term = rows.take(part)
                error = sigmoid(model.bias + np.bincount(row, model.weight[term], len(part))) - label[part]
                used, place = np.unique(term, return_inverse=True)
                g = np.bincount(place, error[row], len(used))
                grown = seen[used] + g * g
                lead[used] += g - (np.sqrt(grown) - np.sqrt(seen[used])) / rate * model.weight[used]
                seen[used] = grown
                z = lead[used]
                model.weight[used] = np.where(np.abs(z) <= sparse, 0, (np.sign(z) * sparse - z) / (np.sqrt(grown) / rate + 1e-3))
        return model


def logistic(x: np.ndarray, label: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one of the constant) of a small dense logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps if 0 < label.sum() < len(label) else 0):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - label) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def joined(a: Sparse, b: Sparse, rows: np.ndarray) -> Sparse:
    """All rows of a, then the given rows of b."""
    return Sparse([a.ids[i:j] for i, j in zip(a.at[:-1], a.at[1:], strict=True)] + [b.ids[b.at[i] : b.at[i + 1]] for i in rows])


@dataclass
class CoTrained:
    views: tuple[Linear, Linear]
    scale: tuple[np.ndarray, np.ndarray]
    weight: np.ndarray

    def scores(self, content: Sparse, page: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both together."""
        logits = [v.margin(rows) * s[0] + s[1] for v, rows, s in zip(self.views, (content, page), self.scale, strict=True)]
        both = np.column_stack([*logits, np.ones(len(logits[0]))]) @ self.weight
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(both)

    @staticmethod
    def fit(labelled: tuple[Sparse, Sparse], label: np.ndarray, pool: tuple[Sparse, Sparse]) -> CoTrained:
        part = np.arange(len(label)) % 4 == 0
        empty = Sparse([])
        train = [joined(empty, v, np.flatnonzero(~part)) for v in labelled]
        told = [label[~part]] * 2
        ones = float(label[~part].mean()) if (~part).any() else 0.5
        share = (1 - ones, ones)
        free = [np.ones(len(pool[0]), bool)] * 2
        dims = (CONTENT, PAGE)
        views = [Linear.fit(v, y, d) for v, y, d in zip(train, told, dims, strict=True)]
        for _ in range(ROUNDS if len(pool[0]) else 0):
            given = []
            for mine, other in ((0, 1), (1, 0)):
                p = sigmoid(views[mine].margin(pool[mine]))
                sure = [np.flatnonzero(free[other] & (q >= SURE)) for q in (1 - p, p)]
                # in the shares that the labels have
                most = min(EXCHANGED, *(len(s) / max(x, 1e-9) for s, x in zip(sure, share, strict=True)))
                take = [s[np.argsort(-np.abs(p[s] - 0.5), kind="stable")][: int(most * x)] for s, x in zip(sure, share, strict=True)]
                given.append((other, np.concatenate(take), np.repeat([0.0, 1.0], [len(t) for t in take])))
            for other, rows, y in given:
                free[other] = free[other].copy()
                free[other][rows] = False
                train[other], told[other] = joined(train[other], pool[other], rows), np.concatenate([told[other], y])
            views = [Linear.fit(v, y, d) for v, y, d in zip(train, told, dims, strict=True)]
        kept = [joined(empty, v, np.flatnonzero(part)) for v in labelled]
        margins = [v.margin(rows) for v, rows in zip(views, kept, strict=True)]
        scale = tuple(logistic(m[:, None], label[part]) for m in margins)
        logits = np.column_stack([m * s[0] + s[1] for m, s in zip(margins, scale, strict=True)])
        return CoTrained((views[0], views[1]), (scale[0], scale[1]), logistic(logits, label[part]))


def features(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    texts = text_views(pa.chunked_array([batch["text"]]))
    known = zip(*(batch[c].to_pylist() for c in COLUMNS), strict=True)
    return [content_terms(t) for t in texts], [page_terms(*k) for k in known]


def quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """doc_id, ``content_score``, ``page_score``, ``score`` (0 to 1) and ``keep`` (score of a half or more) of every document.

    Fitted on at most ``labelled`` documents with a label 0 or 1 (the greatest,
    if several) and ``pool`` others. Missing text, source, lang or n_chars is a
    value of its own. Without labels of both kinds every score is a half and
    all documents are kept. Repeated rows are scored each, very long texts as a
    whole; other columns are left out.
    """
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in COLUMNS))
    truth = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    known = truth.orderBy(*by_hash).limit(labelled)
    others = docs.select("doc_id").where("doc_id is not null").distinct().join(truth, "doc_id", "left_anti").orderBy(*by_hash).limit(pool).withColumn("y", F.lit(-1))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, page = features(b)
            yield pa.record_batch({"doc_id": b["doc_id"].cast(pa.int64()), "y": b["y"], "content": pa.array(content, pa.list_(pa.int32())), "page": pa.array(page, pa.list_(pa.int32()))})

    # broadcast: at most ``labelled + pool`` ids
    chosen = F.broadcast(known.unionByName(others))
    rows = given.join(chosen, "doc_id").mapInArrow(extract, "doc_id long, y int, content array<int>, page array<int>").toArrow()
    order = np.argsort(np.asarray(rows["doc_id"]), kind="stable")
    y = np.asarray(rows["y"])[order]
    views = [[np.asarray(x.values) for x in rows[c].combine_chunks()] if rows.num_rows else [] for c in ("content", "page")]
    some, rest = order[y >= 0], order[y < 0]
    model = CoTrained.fit(tuple(Sparse([v[i] for i in some]) for v in views), y[y >= 0].astype(float), tuple(Sparse([v[i] for i in rest]) for v in views))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(b.num_rows) for _ in range(3)]
            for at in range(0, b.num_rows, 64):
                content, page = (Sparse(x) for x in features(b.slice(at, 64)))
                for o, x in zip(out, model.scores(content, page), strict=True):
                    o[at : at + 64] = x
            yield pa.record_batch({"doc_id": b["doc_id"], "content_score": pa.array(out[0]), "page_score": pa.array(out[1]), "score": pa.array(out[2])})

    out = given.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content_score double, page_score double, score double")
    return out.withColumn("keep", F.col("score") >= 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
