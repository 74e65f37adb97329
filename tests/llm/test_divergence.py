"""Operator 12 against plain Python, also cut into many blocks, passes and tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilcount.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, value long, rank string"
UNIT = 1_000_000_000


def plain(rows, least=3, most=200):
    docs = [((lang or "", source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    holds, counts = Counter(), defaultdict(Counter)
    for (lang, source), terms in docs:
        holds.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in holds.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def p(c, lang):
        total = sum(c[t] for t in kept[lang])
        return {t: 1 + UNIT * (c[t] + 1) // (total + len(kept[lang])) for t in kept[lang]}

    for lang, source in counts:
        own, q = p(counts[lang, source], lang), p(whole[lang], lang)
        pairs = []
        for other in [s for k, s in counts if k == lang and s != source]:
            r = p(counts[lang, other], lang)
            pairs.append((other, sum((own[t] - r[t]) ** 2 // r[t] for t in kept[lang])))
        terms = [(t, (own[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if counts[lang, source][t] and own[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    random.seed(4)
    words = ["Alpha", "beta", "GAMMA", "gam", "gammas", "été", "Été", "漢字", "x", "𝔘𝔫", "be", "bet", "ant", "ants", "aunt", "aunts"] + ["".join(random.choices("abcé", k=random.randint(1, 5))) for _ in range(60)]
    out = [(" ".join(random.choices(words, k=random.randint(0, 40))) + random.choice(("", ".", " 7up", "\n")), random.choice(("en", "en", "de", None, "xx")), random.choice(("s1", "S2", "é", None, "s10", "big", "big", "big"))) for _ in range(150)]
    return [*out, (None, "en", "nothing"), ("", "fr", "s1"), ("7 8", "fr", "s2"), ("twice twice", "it", "s1"), ("only only", "pt", None)] + [("lone word here", "it", "s2")] * 3


@pytest.mark.parametrize("tiny", [False, True])
def test_like_the_plain_version(spark, rows, tiny, monkeypatch):
    if tiny:
        for name, value in (("BLOCK_BYTES", 40), ("PASS_BYTES", 6000), ("SLICE", 20), ("HELD", 10), ("TERMS", 7), ("SOURCES", 2), ("CELLS", 300), ("BROADCAST_GROUPS", 3)):
            monkeypatch.setattr(dv, name, value)
    df = spark.createDataFrame([(1, *r, 5, "given") for r in rows], DOCS).repartition(4)
    got = dv.divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_limit_and_empty_table(spark, rows):
    df = spark.createDataFrame([(1, *r, 5, "given") for r in rows], DOCS)
    assert sorted(map(tuple, dv.divergence(df, least=2, most=3).collect())) == plain(rows, 2, 3)
    assert dv.divergence(df.where("doc_id = 0")).count() == 0


def test_a_long_term_and_a_long_text(spark):
    rows = [("w" * 3_000_000 + " a b a", "en", "s1"), ("a " * 2_000_000, "en", "s2")] + [("w" * 3_000_000, "en", "s1"), ("a", "en", "s2")] * 2
    df = spark.createDataFrame([(i, *r, 5, "given") for i, r in enumerate(rows)], DOCS)
    assert sorted(map(tuple, dv.divergence(df).collect())) == plain(rows)


def test_transducer_is_minimal_and_counts_in_order():
    random.seed(8)
    terms = sorted({bytes(random.choices(b"abc\xc3\xff", k=random.randint(1, 6))) for _ in range(400)})
    built = dv.Transducer.unpack(dv.Transducer.build(terms).pack())
    probe = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms if len(t) > 1]
    text, ends = np.frombuffer(b"".join(probe), np.uint8), np.cumsum([len(t) for t in probe])
    want = [terms.index(t) if t in set(terms) else -1 for t in probe]
    for cells in (0, 1 << 20):
        assert built.laid_out(cells).ordinals(text, ends - [len(t) for t in probe], ends).tolist() == want
    # one state for each set of ways to go on
    after = {frozenset(t[i:] for t in terms if t.startswith(p[:i])) for p in terms for i in range(len(p) + 1)}
    assert len(built.final) == len(after)


def test_shares_of_large_counts_are_exact():
    n, total = np.array([[0, 5, 10**13]]), np.array([3 * 10**13])
    assert dv.shares(n, total).tolist() == [[1 + UNIT * (x + 1) // (3 * 10**13) for x in (0, 5, 10**13)]]
