"""Operator 11 against a plain version in Python's integers, and on awkward rows."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from veilcount.llm import vector_codes as vc


def plain(rows, parts, entries, rounds, scale):
    """(id, code, error) in order, and the digest, without any transform."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = parts * -(-max((len(v) for _, v in rows), default=0) // parts)
    own = width // parts
    whole = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v)) for _, v in rows]
    cut = [[w[j * own : (j + 1) * own] for j in range(parts)] for w in whole]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]

    def best(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for j, book in enumerate(books):
            held = [[] for _ in book]
            for c in cut:
                held[best(c[j], book)[1]].append(c[j])
            books[j] = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else old for h, old in zip(held, book, strict=True)]
    out = []
    for (i, _), c in zip(rows, cut, strict=True):
        found = [best(p, b) for p, b in zip(c, books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_sequency_order_counts_sign_changes():
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    changes = [(h[i][1:] != h[i][:-1]).sum() for i in vc.sequency_order(16)]
    assert changes == list(range(16))
    assert (vc.walsh(np.eye(16, dtype=np.int64)).T == h[vc.sequency_order(16)]).all()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_is_exact_with_ties(kind):
    random.seed(5)
    for size in (1, 3, 8):
        x = np.array([[random.randint(-3, 3) for _ in range(size)] for _ in range(200)]).astype(kind)
        c = np.array([[random.randint(-3, 3) for _ in range(size)] for _ in range(16)]).astype(kind)
        entry, far = vc.nearest(vc.walsh(x), vc.walsh(c))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        padded = 1 << max(0, size - 1).bit_length()
        assert (entry == full.argmin(1)).all()
        assert (far == full.min(1) * padded).all()


@pytest.mark.parametrize("huge", [False, True])
def test_like_the_plain_version(spark, huge):
    random.seed(7)
    rows = [(i // 2 if i % 5 else None, [random.choice((-0.5, 0.25, 1.0, random.uniform(-2, 2))) for _ in range(random.choice((9, 12)))], random.choice((1, 2, None)), "x") for i in range(120)]
    if huge:
        rows += [(3, [3e38, -3e38, 1e300], 1, "x"), (4, [1e-300, 4e15], 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    out, books = vc.compress(df, parts=4, entries=8, rounds=3)
    want, digest = plain([(i, v) for i, v, _, _ in rows], 4, 8, 3, vc.SCALE)
    got = out.collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=order) == sorted(((i, c, e if e < 2**63 else None) for i, c, e in want), key=order)
    assert {r["codebooks_sha256"] for r in got} == {digest} == {books.digest}
    # a sum over equal labels, nulls together
    assert len({r["label_error"] for r in got}) <= 3
    if not huge:
        assert sum({r["label_error"] for r in got}) == sum(e for _, _, e in want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan], 1), (4, [inf], None), (5, [], 3), (None, [0.5] * 8, None), (6, [0.5] * 8, None), (6, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r)[:4] for r in vc.compress(df)[0].collect()), key=str)
    assert [r[0] for r in got] == [5, 6, 6, None]
    assert all(r[2] == 0 and r[3] == 0 for r in got)
    assert vc.compress(df.where("vec_id < 5"))[0].count() == 0
    only_empty = vc.compress(df.where("vec_id = 5"))[0].first()
    assert (only_empty["code"], only_empty["error"], only_empty["codebooks_sha256"]) == ("00" * 8, 0, hashlib.sha256(b"").hexdigest())


def test_decompressed_vectors_are_near(spark):
    rows = [(i, [((i % 4) * 7 + j) % 5 / 5 for j in range(16)], 0) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = vc.compress(df)
    back = {r["vec_id"]: r["vector"] for r in vc.decompress(codes, books).collect()}
    assert all(abs(a - b) < 0.001 for i, v, _ in rows for a, b in zip(v, back[i], strict=True))
    assert books.table(df.sparkSession).count() == 8 * 16
