"""Operator 2: exact top-k inner products, by a dual-tree search over cover trees.

Queries and data go into one tree: its nodes are nets of a bounded sample of
the rows (farthest-first, so that a level's centres stand at least its radius
apart), every row belongs to the leaf whose centre is nearest, and each node
knows the covering radius of its data and of its queries. A pair of nodes
cannot hold a better neighbour, and is dropped with all below it, if
``<c_q, c_d> + r_q |c_d| + r_d |c_q| + r_q r_d`` is under the worst kth score
known for the node's queries. The scores known at the start are those against
the sample. Surviving leaf pairs become a join of blocks of rows; each block
has small balls of its own, which are pruned the same way before products are
taken.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the tree is fitted on, and whose scores give the first bounds.
SAMPLE = 4096
LEAVES = 48
BLOCK = 4096
#: Queries that meet one block at a time.
QUERIES = 4096
ABSENT = -(1 << 62)
#: Rows and queries of a block where vectors are too large for 64 bits, and a number beyond all their products.
LARGE, MIDDLE = 256, 3 << 2300
MOST = float(np.finfo(float).max)


@dataclass
class CoverTree:
    """Centres in farthest-first order; node (level, i) is centre i in the net of that level."""

    centres: np.ndarray
    levels: list[int]
    parents: list[np.ndarray]

    @staticmethod
    def fit(points: np.ndarray, leaves: int) -> CoverTree:
        order, gap = [0], [np.inf]
        near = np.linalg.norm(points - points[0], axis=1)
        while len(order) < min(leaves, len(points)):
            i = int(near.argmax())
            if near[i] == 0:
                break
            order.append(i)
            gap.append(float(near[i]))
            near = np.minimum(near, np.linalg.norm(points - points[i], axis=1))
        centres = points[order]
        levels, radius = [1], gap[1] if len(gap) > 1 else 0
        while levels[-1] < len(order):
            radius /= 2 ** 0.25
            levels.append(max(levels[-1], sum(g > radius for g in gap)))
        parents = [np.zeros(1, int)]
        for above, here in zip(levels, levels[1:], strict=False):
            parents.append(distances(centres[:here], centres[:above]).argmin(1))
        return CoverTree(centres, levels, parents)

    def radii(self, leaf: np.ndarray) -> list[np.ndarray]:
        """Covering radius of every node, from those of the leaves (-1: no rows below)."""
        below = np.arange(len(leaf))
        out = []
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                below = self.parents[level + 1][below]
            reach = np.where(leaf < 0, -1.0, np.linalg.norm(self.centres - self.centres[below], axis=1) + leaf)
            r = np.full(self.levels[level], -1.0)
            np.maximum.at(r, below, reach)
            out.append(r)
        return out[::-1]

    def pairs(self, query_radius: np.ndarray, data_radius: np.ndarray, worst: np.ndarray) -> list[tuple[int, int]]:
        """Leaf pairs (queries', data's) that may hold a score of at least ``worst``, by descent from the pair of roots."""
        rq, rd = self.radii(query_radius), self.radii(data_radius)
        low, below = [worst], np.arange(len(worst))
        for level in range(len(self.levels) - 1, 0, -1):
            below = self.parents[level][below]
            w = np.full(self.levels[level - 1], np.inf)
            np.minimum.at(w, below, worst)
            low.insert(0, w)
        live = np.array([[0, 0]])
        for level, size in enumerate(self.levels):
            if level:
                to = self.parents[level]
                kids = [np.flatnonzero(to == i) for i in range(self.levels[level - 1])]
                live = np.array([(a, b) for q, d in live for a in kids[q] for b in kids[d]]).reshape(-1, 2)
            q, d = live[:, 0], live[:, 1]
            c, norm = self.centres[:size], np.linalg.norm(self.centres[:size], axis=1)
            a, b = rq[level][q], rd[level][d]
            bound = (c[q] * c[d]).sum(1) + a * norm[d] + b * norm[q] + a * b
            live = live[(a >= 0) & (b >= 0) & (bound + np.abs(bound) * 1e-9 + 1e-6 >= low[level][q])]
        return [tuple(x) for x in live.tolist()]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Whole-number rows, short ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where every sum stays under 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ d.T.astype(float)).astype(np.int64) if most < 2**53 else q @ d.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best, ties to the smaller id; ids ascend."""
    scores = np.where(ids[None] == own[:, None], ABSENT, scores)
    k = min(k, scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    above, level = scores > kth[:, None], scores == kth[:, None]
    take = above | (level & (np.cumsum(level, axis=1) <= (k - above.sum(1))[:, None]))
    return np.nonzero(take & (scores != ABSENT))


def search_block(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block: (query id, vector id, score)."""
    order = np.argsort(d_ids, kind="stable")
    d, d_ids = d[order], d_ids[order]
    tree = CoverTree.fit(d[np.linspace(0, len(d) - 1, min(len(d), 256)).astype(int)].astype(float), 16)
    gap = distances(d.astype(float), tree.centres)
    ball = gap.argmin(1)
    radius = np.zeros(len(tree.centres))
    np.maximum.at(radius, ball, gap[np.arange(len(d)), ball])
    out = []
    for at in range(0, len(q), 256):
        part, low = q[at : at + 256].astype(float), floor[at : at + 256]
        reach = part @ tree.centres.T + np.linalg.norm(part, axis=1)[:, None] * radius
        live = (reach * (1 + np.sign(reach) * 1e-9) + 1e-3 >= low[:, None]).any(0)
        near = np.flatnonzero(live[ball])
        if len(near):
            scores = products(q[at : at + 256], d[near])
            r, c = best(scores, d_ids[near], q_ids[at : at + 256], k)
            out.append((q_ids[at : at + 256][r], d_ids[near][c], scores[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def exact_top_k(vectors: DataFrame, query: Column, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k greatest inner products with the other rows.

    ``vector`` is an array of whole numbers. Rows whose key or vector is null,
    or whose vector holds null, take no part. Ties go to the smaller key; fewer
    candidates than k give fewer rows. Rows that repeat a key are candidates
    each (never for a query of the same key); a key that is a query more than
    once asks with its least vector. Vectors of unequal length are compared as
    if the shorter went on with zeros. Other columns are left out. Vectors so
    large that a product might not fit into 64 bits meet the others in blocks,
    in Python's integers; they are ranked by their exact products, and a score
    beyond 64 bits is shown as the nearest that fits. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), query.alias("asks")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    size = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    width, most = (x or 0 for x in rows.agg(F.max(F.size("v")), F.max(size)).first())
    asking = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    limit = math.isqrt((1 << 62) // max(1, width))
    if most <= limit:
        found = searched(whole(rows), whole(asking), width, k)
        order = [F.desc("score"), F.col("vec_id")]
    else:
        large = size > limit
        found = None
        for part in (searched(whole(rows.where(~large)), whole(asking.where(~large)), width, k), in_blocks(asking, rows.where(large), width, k), in_blocks(asking.where(large), rows.where(~large), width, k)):
            if part is not None:
                part = part if "beyond" in part.columns else part.withColumn("beyond", F.lit(None).cast("string"))
                found = part if found is None else found.unionByName(part)
        order = [F.desc("score"), F.desc_nulls_last("beyond"), F.col("vec_id")]
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.transform("v", lambda x: x.cast("long")))


def in_blocks(asking: DataFrame, data: DataFrame, width: int, k: int) -> DataFrame | None:
    """(query_id, vec_id, score, beyond): the k best of each query within each block of rows, compared one by one.

    ``beyond`` orders the scores that don't fit into 64 bits.
    """
    sizes = [x.count() for x in (asking, data)]
    if not all(sizes):
        return None
    groups, blocks = (-(-n // LARGE) for n in sizes)
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select(salt(groups).alias("g"), each(blocks).alias("b"), "id", "v", F.lit(True).alias("asks"))
    right = data.select(each(groups).alias("g"), salt(blocks).alias("b"), "id", "v", F.lit(False).alias("asks"))

    def exact(lists: list[list[float]]) -> np.ndarray:
        # every double of 2**52 or more is a whole number
        return np.array([[int(x) for x in v] + [0] * (width - len(v)) for v in lists], object).reshape(-1, width)

    def search(table: pa.Table) -> pa.Table:
        asks, ids = np.asarray(table["asks"].combine_chunks()), np.asarray(table["id"]).astype(np.int64)
        v = exact(table["v"].to_pylist())
        out = []
        for i in np.flatnonzero(asks):
            near = np.flatnonzero(~asks & (ids != ids[i]))
            scores = v[near] @ v[i] if len(near) else []
            for s, other in heapq.nsmallest(k, ((-s, int(ids[j])) for s, j in zip(scores, near, strict=True))):
                beyond = f"{MIDDLE - s:x}" if not -(2**63) < -s < 2**63 else None
                out.append((int(ids[i]), other, min(2**63 - 1, max(-(2**63), -s)), beyond))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "beyond": pa.string()}
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), columns, strict=True)})

    return left.unionByName(right).groupBy("b", "g").applyInArrow(search, "query_id long, vec_id long, score long, beyond string")


def searched(rows: DataFrame, asking: DataFrame, width: int, k: int) -> DataFrame | None:
    """(query_id, vec_id, score): the k best of each query in each block of the leaves that may hold one; None without a pair."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").select("id", "v").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return None
    sample_ids = np.asarray(sample["id"]).astype(np.int64)
    points = matrix(sample["v"], width)
    by_id = np.argsort(sample_ids, kind="stable")
    sample_ids, points = sample_ids[by_id], points[by_id]
    tree = CoverTree.fit(points.astype(float), LEAVES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], width)
            gap = distances(x.astype(float), tree.centres)
            leaf = gap.argmin(1)
            # recomputed without cancellation, as a radius must not be too small
            span = np.linalg.norm(x - tree.centres[leaf], axis=1)
            yield pa.record_batch({"id": b["id"], "v": b["v"], "leaf": pa.array(leaf, pa.int32()), "span": pa.array(span)})

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b["v"], width), np.asarray(b["id"]).astype(np.int64)
            low = np.full(len(x), ABSENT, np.int64)
            for at in range(0, len(x), 256):
                s = np.where(sample_ids[None] == ids[at : at + 256, None], ABSENT, products(x[at : at + 256], points))
                if s.shape[1] >= k:
                    low[at : at + 256] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int64())], [*b.schema.names, "low"])

    data = rows.select("id", "v").mapInArrow(place, "id long, v array<bigint>, leaf int, span double")
    asking = asking.mapInArrow(place, "id long, v array<bigint>, leaf int, span double").mapInArrow(first_bound, "id long, v array<bigint>, leaf int, span double, low long")

    size, r_d = np.zeros(len(tree.centres), int), np.full(len(tree.centres), -1.0)
    for x in data.groupBy("leaf").agg(F.count("*").alias("n"), F.max("span").alias("r")).collect():
        size[x["leaf"]], r_d[x["leaf"]] = x["n"], x["r"]
    asks, r_q, worst = size * 0, r_d * 0 - 1, np.full(len(size), np.inf)
    for x in asking.groupBy("leaf").agg(F.count("*").alias("n"), F.max("span").alias("r"), F.min("low").alias("w")).collect():
        asks[x["leaf"]], r_q[x["leaf"]], worst[x["leaf"]] = x["n"], x["r"], x["w"]
    live = tree.pairs(r_q, r_d, worst)
    if not live:
        return None

    blocks = np.maximum(1, -(-size // BLOCK))
    # whole leaves of queries share a group; a leaf of more is split
    group, splits, at, held = {}, np.maximum(1, -(-asks // QUERIES)), 0, 0
    for leaf in np.flatnonzero(asks):
        if held and held + asks[leaf] > QUERIES:
            at, held = at + 1, 0
        group[int(leaf)] = at
        held += asks[leaf]
        if splits[leaf] > 1:
            at, held = at + int(splits[leaf]), 0
    wide = spark.createDataFrame([(q, d, group[q], int(splits[q]), int(blocks[d])) for q, d in live], "q int, d int, g int, splits int, blocks int")
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # bounded by LEAVES * LEAVES rows
    to_data = F.broadcast(wide.select("d", F.explode(F.sequence("g", F.expr("g + splits - 1"))).alias("g"), "blocks").distinct())
    to_query = F.broadcast(wide)
    left = data.join(to_data, data["leaf"] == to_data["d"]).select("d", salt(F.col("blocks")).alias("b"), "g", "id", "v", F.lit(None).cast("long").alias("low"))
    right = asking.join(to_query, asking["leaf"] == to_query["q"]).select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), (F.col("g") + salt(F.col("splits"))).alias("g"), "id", "v", "low")

    def search(table: pa.Table) -> pa.Table:
        low = table["low"].combine_chunks()
        x, ids = matrix(table["v"], width), np.asarray(table["id"]).astype(np.int64)
        is_query = ~np.asarray(low.is_null())
        floor = np.asarray(low.fill_null(0)).astype(np.int64)[is_query]
        q, v, s = (np.zeros(0, np.int64),) * 3
        if is_query.any() and not is_query.all():
            q, v, s = search_block(x[is_query], ids[is_query], floor, x[~is_query], ids[~is_query], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return left.unionByName(right).groupBy("d", "b", "g").applyInArrow(search, "query_id long, vec_id long, score long")


def quantised(embeddings: DataFrame, levels: int = 256) -> DataFrame:
    """vec_id and floor(levels * x) of each component (the greatest double, if that is beyond it); rows with null or non-finite components are left out."""
    x = embeddings.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    x = x.where(F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # doubles of 2**52 or more are whole already; as doubles, since not all of them fit into 64 bits
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(F.least(F.greatest(c, F.lit(-MOST)), F.lit(MOST)))
    return x.select("vec_id", F.transform("e", lambda c: floor(c * levels)).alias("vector"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(rows, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
