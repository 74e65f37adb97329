"""Work and memory on skewed input: pages of one template, and long documents before short ones."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from veilcount.llm import near_dedup, repeats
from veilcount.llm.near_dedup import near_duplicates


def template_pages(spark, n, close=0):
    """A body of 300 words with 40 to 70 own ones each, under 0.8 similar; ``close`` more that differ in 5 words only."""
    random.seed(n)
    body, tail = (" ".join(f"{x}{i}" for i in range(k)) for x, k in (("body", 300), ("tail", 55)))
    rows = [body + " " + " ".join(f"own{d}x{i}" for i in range(random.randint(40, 70))) for d in range(n)]
    rows += [body + " " + tail + " " + " ".join(f"own{n + d}x{i}" for i in range(5)) for d in range(close)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("close", [0, 20])
def test_template_pages_do_not_meet_one_another(spark, monkeypatch, close):
    met = []
    plain = near_dedup.meeting

    def counted(placed):
        asking, one = plain(placed)
        n = asking.groupBy("key", "level").count().join(one.groupBy("key", "level").agg(F.count("*").alias("m")), ["key", "level"])
        met.append(n.agg(F.coalesce(F.sum(F.col("count") * F.col("m")), F.lit(0))).first()[0])
        return asking, one

    monkeypatch.setattr(near_dedup, "meeting", counted)
    work = []
    for n in (200, 800):
        met.clear()
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates(template_pages(spark, n, close)).collect()}
        assert all(got[d] == d for d in range(n))
        assert len({got[d] for d in range(n, n + close)}) <= 1
        work.append(sum(met))
    # four times the documents, some four times the rows that meet, and not sixteen
    assert work[1] <= 6 * work[0] + 2000


def test_levels_lose_no_pair(spark):
    """Pairs are those of all rows that share a key and enough."""
    random.seed(11)
    rows = [(k, i, i, 1.0, random.uniform(0, 3), random.uniform(0, 3), [], random.random() < 0.7, random.random() < 0.7) for i in range(60) for k in random.sample(range(4), 2)]
    placed = spark.createDataFrame(rows, "key long, id long, label long, total double, s double, rest double, before array<long>, few boolean, asking boolean")
    asking, one = near_dedup.meeting(placed)
    got = {tuple(r) for r in asking.alias("a").join(one.alias("b"), ["key", "level"]).where("a.id <> b.id and least(a.rest, b.rest) >= (a.s + b.s) / 2").select("key", "a.id", "b.id").collect()}
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[8] and y[7] and min(x[5], y[5]) >= (x[4] + y[4]) / 2}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("order", ["long first", "mixed", "one id"])
def test_chunks_are_cut_by_bytes(spark, order):
    size, random_ = 1 << 16, random.Random(6)
    sizes = [20_000] * 60 + [50] * 6000
    if order == "mixed":
        random_.shuffle(sizes)
    rows = [(7 if order == "one id" and i % 3 == 0 else i * i, "x" * n) for i, n in enumerate(sizes)] + [(5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    number, n = repeats.chunk_numbers(docs, size)
    chunks = docs.select(number.alias("c"), "doc_id", F.octet_length("text").alias("b")).groupBy("c").agg(F.sum("b").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("c").collect()
    assert all(0 <= r["c"] < n for r in chunks)
    assert all(x["high"] < y["low"] for x, y in zip(chunks, chunks[1:], strict=False))
    if order == "one id":
        assert len(chunks) > 5
    else:
        assert max(r["b"] or 0 for r in chunks) <= size + 20_000
        assert len(chunks) >= sum(sizes) // (size + 20_000)


def test_many_chunks_split_ranges_by_id(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGES", 4)
    docs = spark.createDataFrame([(i, "y" * 100) for i in range(2000)] + [(None, "z" * 100)] * 5, "doc_id long, text string").repartition(3)
    number, n = repeats.chunk_numbers(docs, 5000)
    chunks = docs.where("doc_id is not null").select(number.alias("c"), "doc_id").groupBy("c").agg(F.count("*").alias("k"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("c").collect()
    assert len(chunks) > 12 and all(r["c"] < n for r in chunks) and all(x["high"] < y["low"] for x, y in zip(chunks, chunks[1:], strict=False))
    nothing, k = repeats.chunk_numbers(docs.where("doc_id = -1"), 5000)
    assert k == 1 and docs.where("doc_id = -1").select(nothing).count() == 0


def test_other_texts_of_one_id_stay(spark):
    rows = [(1, "a b c d e f g h i j k l", "en", "s", 1), (1, "z y x w v u t s r q p o", "en", "s", 1), (1, "z y x w v u t s r q p o", "en", "s", 1), (2, "m n m n m n o p o p q q", "en", "s", 1), (None, "a b c d e f g h i j k l", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in cp.drop_near_duplicates(spark, docs, "").collect()))
    assert got == [(0, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (2, rows[3][1])]
