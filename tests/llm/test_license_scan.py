"""Operator 13 against plain searches for every span of words, and on awkward rows."""

import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from veilcount.llm.license_scan import NOTICES, PHRASES, Notice, Scanner, license_scan, op13_license_scan

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(words):
    return sorted((i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def distances(a, text):
    """Edit distances of ``a`` to every prefix of ``text``."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


@lru_cache(maxsize=None)
def errors(notice, span):
    """Fewest errors of the notice's parts, the bracketed ones unchanged; part after part over all prefixes."""
    far = 10**6
    now = {0: 0}
    for part in filter(None, re.split(r"(\[[^\]]*\])", notice.words)):
        new = {}
        for at, cost in now.items():
            if part[0] == "[":
                if span.startswith(part[1:-1], at):
                    new[at + len(part) - 2] = min(cost, new.get(at + len(part) - 2, far))
            else:
                for j, d in enumerate(distances(part, span[at : at + len(part) + notice.errors + 1])):
                    if d <= notice.errors:
                        new[at + j] = min(cost + d, new.get(at + j, far))
        now = new
    return now.get(len(span), far)


def best(notice, words):
    """Fewest errors over all spans of words of about the notice's length, None if too many."""
    size, found = len(notice.text), []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            span = " ".join(words[i:j])
            if len(span) > size + notice.errors:
                break
            if len(span) >= size - notice.errors:
                found.append(errors(notice, span))
    return min((e for e in found if e <= notice.errors), default=None)


def broken(text, n):
    for _ in range(n):
        at = random.randrange(len(text))
        text = random.choice((text[:at] + text[at + 1 :], text[:at] + random.choice("aeit 2") + text[at:], text[:at] + random.choice("aeit 2") + text[at + 1 :]))
    return text


def test_finds_what_a_search_of_all_spans_finds():
    random.seed(13)
    scanner = Scanner(NOTICES, PHRASES)
    filler = "under the license of a version 2 gnu mit public apache general permission to use copy lesser é".split()
    some, hits = [n for n in NOTICES if len(n.text) < 50], Counter()
    for _ in range(250):
        parts = [" ".join(random.choices(filler, k=random.randint(0, 5))) for _ in range(3)]
        chosen = random.choices(some, k=2)
        text = " ".join([parts[0], broken(chosen[0].text, random.randint(0, 4)), parts[1], broken(chosen[1].text, random.randint(0, 3)), parts[2]])
        words = words_of(text)
        n, places, matches = scanner.scan(np.frombuffer(text.encode(), np.uint8))
        assert (n, places) == (len(words), base(words))
        for i, notice in enumerate(some):
            i = NOTICES.index(notice)
            own = [m for m in matches if m[0] == i]
            want = best(notice, words)
            assert min((e for *_, e in own), default=None) == want, (notice, text)
            hits[want] += 1
            for _, first, last, e in own:
                assert errors(notice, " ".join(words[first : last + 1])) == e
    assert min(hits[e] for e in (0, 1, 2, 3)) > 5


@pytest.mark.parametrize("notice", [n for n in NOTICES if len(n.text) >= 50])
def test_long_notices(notice):
    random.seed(14)
    scanner = Scanner((notice,), ())
    for n in range(notice.errors + 1):
        text = "so " + broken(notice.text, n) + " and on"
        assert scanner.scan(np.frombuffer(text.encode(), np.uint8))[2][0][3] <= n
    other = "so " + " ".join(w[::-1] for w in notice.text.split())
    assert scanner.scan(np.frombuffer(other.encode(), np.uint8))[2] == []


def test_no_notice_is_another_licence():
    for n in NOTICES:
        labels = {NOTICES[m[0]].label for m in Scanner(NOTICES, ()).scan(np.frombuffer(n.text.encode(), np.uint8))[2]}
        assert labels == {n.label}


def test_query_on_whole_documents(spark):
    import duckdb

    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in op13_license_scan(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        words, r = words_of(text), got[doc]
        places = base(words)
        labels = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(labels))
        assert set(labels) <= set(filter(None, r["labels"].split(",")))
        assert r["score"] == 1 if places else 0 <= r["score"] < 1 or r["labels"]
    assert any(r["n_base"] for r in got.values())


def test_awkward_rows(spark):
    far = "word " * 400_000
    rows = [(1, None), (2, ""), (3, "...!"), (4, "x" * 3_000_000), (5, far + "Under the MIT License. " * 3), (6, "CC-BY-NC cc by nc cc by nc"), (None, "under the mit licence"), (7, "under the mpl license"), (7, "Apache License, Version 1.1"), (8, "GNU Lesser General Pubic License"), (9, "Apache Licence, Version 2.0 und é")]
    df = spark.createDataFrame([(*r, 1.0, "given") for r in rows], "doc_id long, text string, score double, labels string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["labels"])) for r in license_scan(df).collect()), key=lambda r: (r[0] or 0, r[1]))
    assert got == [
        (None, 4, 0, None, None, "mit"), (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 0, 0, None, None, ""), (4, 1, 0, None, None, ""), (5, 400_012, 3, 400_000, 400_008, "mit"),
        (6, 9, 3, 0, 6, "cc-by-nc"), (7, 4, 0, None, None, ""), (7, 5, 0, None, None, ""), (8, 5, 0, None, None, "lgpl"), (9, 7, 0, None, None, "apache-2"),
    ]
    assert license_scan(df.where("doc_id = 99")).count() == 0
    assert license_scan(df, (), ()).agg({"n_words": "sum"}).first()[0] > 400_000
    with pytest.raises(ValueError):
        license_scan(df, (Notice("x", "abc", 3),))
