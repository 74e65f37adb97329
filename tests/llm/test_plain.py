"""Models and decontamination against plain versions that share no arithmetic with them."""

import math
import random
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest

from veilcount.llm import decontaminate, language_id, quality, toxicity
from veilcount.llm.terms import Sparse

SF = "/root/testdata/sf0.001"


def words_of_letters(text):
    held = []
    for c in (text or "").lower():
        if unicodedata.category(c)[0] == "L":
            held.append(ord(c) % language_id.LETTERS + 1)
        elif held:
            yield held
            held = []
    if held:
        yield held


def plain_bundle(text, vectors, dims):
    total = [0] * dims
    for word in words_of_letters(text):
        for a, b, c in zip([0, *word[:-1]], word, [*word[1:], 0], strict=True):
            x, y, z = vectors[a], vectors[b], vectors[c]
            for i in range(dims):
                # permuted twice, once and not at all
                total[i] += x[i - 2] * y[i - 1] * z[i]
    return total


def test_languages_by_bundles_and_cosines(spark):
    dims = 32
    vectors = language_id.letter_vectors(dims)[2].astype(int).tolist()
    random.seed(8)
    letters = {"aa": "abcdeé", "bb": "aöxyzß", "cc": "漢字中aq"}
    rows = [(i, " ".join("".join(random.choices(letters[lang], k=random.randint(1, 6))) for _ in range(random.randint(0, 12))) + random.choice(("", " 7!", ".B")), lang) for i in range(60) for lang in [random.choice(list(letters))]]
    rows += [(60, None, "aa"), (61, "12 ?", "bb"), (62, "abc", None)]
    known = {}
    for i, text, lang in rows:
        if i % 3 and lang and text is not None:
            known[lang] = [a + b for a, b in zip(known.get(lang, [0] * dims), plain_bundle(text, vectors, dims), strict=True)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_id.F.col("doc_id") % 3 != 0, dims=dims).collect()}
    for i, text, _ in rows:
        v = plain_bundle(text, vectors, dims)
        cosines = {lang: sum(a * b for a, b in zip(v, p, strict=True)) / (norm(v) or 1) / norm(p) for lang, p in known.items()}
        best = max(sorted(cosines), key=lambda x: round(cosines[x], 9))
        want = (best, min(1, max(0, cosines[best]))) if norm(v) else ("und", 0)
        assert (got[i][0], round(got[i][1], 6)) == (want[0], round(want[1], 6)), text


def test_toxicity_is_the_sum_over_pairs(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, label = toxicity.labelled_terms(docs, labels, "toxic", 500)
    fm = toxicity.FactorizationMachine.fit(rows, label)
    random.seed(1)
    used = np.flatnonzero(fm.weight)
    assert len(used) > 5
    # also with factors on all terms, and large ones
    fm.factor[used] = np.random.default_rng(2).normal(0, 1, (len(used), toxicity.FACTORS))
    some = [np.unique(np.array(random.choices(used.tolist() + list(range(50)), k=n), np.int64)) for n in (0, 1, 2, 3, 10, 40)]
    row, term = Sparse(some).take(np.arange(len(some)))
    got = fm.margin(row, term, len(some))
    for terms, margin in zip(some, got, strict=True):
        want = fm.bias + sum(fm.weight[t] for t in terms)
        for i, a in enumerate(terms):
            for b in terms[i + 1 :]:
                want += sum(float(x) * float(y) for x, y in zip(fm.factor[a], fm.factor[b], strict=True))
        assert margin == pytest.approx(want, abs=1e-8)


def test_toxicity_query_scores_by_its_machine(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    training = toxicity.crc_of_id() % 5 != 0
    fm = toxicity.FactorizationMachine.fit(*toxicity.labelled_terms(docs, labels.where(training), "toxic", toxicity.SAMPLE))
    got = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity(spark, SF).collect()}
    for doc, text in duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()[:60]:
        terms = [t for t in toxicity.terms_of(np.frombuffer((text or "").lower().encode(), np.uint8)).tolist() if fm.weight[t]]
        z = fm.bias + sum(fm.weight[t] for t in terms) + sum(float(fm.factor[a] @ fm.factor[b]) for i, a in enumerate(terms) for b in terms[i + 1 :])
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-4)


def test_quality_views_by_hand():
    random.seed(3)
    make = lambda dims, n: Sparse([np.unique(np.array(random.choices(range(dims), k=random.randint(1, 8)), np.int64)) for _ in range(n)])
    content, page = make(40, 300), make(12, 300)
    label = np.array([float(0 in content.ids[i:j] or 1 in content.ids[i:j]) for i, j in zip(content.at[:-1], content.at[1:], strict=True)])
    model = quality.CoTrained.fit((content, page), label, (make(40, 80), make(12, 80)))
    got = model.scores(content, page)
    for d in range(300):
        z = []
        for rows, view, scale in zip((content, page), model.views, model.scale, strict=True):
            margin = view.bias + sum(float(view.weight[t]) for t in rows.ids[rows.at[d] : rows.at[d + 1]])
            z.append(margin * scale[0] + scale[1])
        both = z[0] * model.weight[0] + z[1] * model.weight[1] + model.weight[2]
        for score, x in zip(got, (*z, both), strict=True):
            assert score[d] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, x)))), abs=1e-9)
    assert ((got[2] >= 0.5) == (label == 1)).mean() > 0.9


@pytest.mark.parametrize("seed", [1, 2])
def test_items_of_every_length_by_the_rule(spark, seed):
    """The query's SQL compares all diagonals with a stretch that the rule leaves; few different words make many."""
    random.seed(seed)
    words = "a b c d e f g".split()
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 40)))) for i in range(60)]
    items = [(i, " ".join(random.choices(words, k=1 + i % 15))) for i in range(45)]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(name, pd.DataFrame(rows, columns=[key, "text"]))
    want = sorted(con.execute(decontaminate.OP8_SQL).fetchall())
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
