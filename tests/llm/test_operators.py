"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcount.llm import decontaminate, near_dedup, pieces, quality, queries, repeats, substring_dedup, suffix_dedup, top_k, toxicity, url_filter
from veilcount.llm.decontaminate import contamination
from veilcount.llm.language_id import identify

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"


def table(name):
    return duckdb.connect().execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return sorted((r[0], r[1]) for r in table("documents"))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and repeated rows, a very long text, and a column that an operator adds itself."""
    same = "one two three four five six seven " * 8
    rows = [(None, "no id here " * 12, "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, same, "en", "s", 5), (3, same, "en", "s", 5), (4, same, None, None, 5), (5, "\t\n  ", "de", "s", 4), (6, "é漢字▁ 　x", "de", "s", 3), (7, "word " * 60_000, "en", "s", 9), (8, "7 8 9 !?", "fr", "s", 4)]
    return spark.createDataFrame([(*r, "label") for r in rows], DOCS)


def brute(sequences, length):
    """True for every item that a window covers which also starts earlier."""
    seen, out = set(), []
    for q in sequences:
        gone = [False] * len(q)
        for i in range(len(q) - length + 1):
            w = tuple(q[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        out.append(gone)
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 40_000])
def test_substring_dedup_is_exact(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "Windows", lambda **k: repeats.Windows(chunk_bytes=chunk, **k))
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_substring_dedup"](spark, SF).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in texts]
    for (d, _), w, gone in zip(texts, words, brute(words, 20), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("chunk", [4 << 20, 40_000])
def test_suffix_dedup_is_exact(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "Windows", lambda **k: repeats.Windows(**(k | {"chunk_bytes": chunk})))
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    raw = [t.encode() for _, t in texts]
    for (d, _), b, gone in zip(texts, raw, brute(raw, 100), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip([False, *gone], gone, strict=False))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_blocks_and_long_texts_change_nothing(spark, monkeypatch):
    """Documents longer than a block are cut into overlapping parts."""
    monkeypatch.setattr(repeats, "BLOCK", 64)
    random.seed(3)
    body = ["".join(random.choices("ab", k=40)) for _ in range(6)]
    docs = ["".join(random.choices(body, k=30)) for _ in range(12)]
    spec = repeats.Windows(100, 50, suffix_dedup.byte_symbols)
    import pyarrow as pa

    t = pa.table({"doc_id": pa.array(range(12), pa.int64()), "text": docs})
    chunk, _ = repeats.read_chunk(t)
    d, at, n = repeats.Resolver(chunk, spec, None).late(None)
    late = {(int(x), int(y) + k) for x, y, m in zip(d, at, n, strict=True) for k in range(int(m))}
    seen, want = set(), set()
    for i, text in enumerate(docs):
        for j in range(len(text) - 99):
            want |= {(i, j)} if text[j : j + 100] in seen else set()
            seen.add(text[j : j + 100])
    assert late == want


def test_repeats_on_odd_rows(spark, odd):
    out = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.substring_dedup(odd, carry=("label",)).collect()}
    assert out[(1, 0)]["kept"] == "" and out[(2, 0)]["kept"] == "" and out[(1, 0)]["label"] == "label"
    same = [r for (d, _), r in out.items() if d in (3, 4)]
    assert sorted(len(r["kept"]) > 0 for r in same) == [False, True]
    assert out[(7, 60_000)]["kept"] == "word"
    assert suffix_dedup.suffix_dedup(odd).count() == odd.count()
    whole = suffix_dedup.suffix_dedup(odd, 2, characters=True)
    assert all(r["kept"].decode() is not None for r in whole.collect())
    assert substring_dedup.substring_dedup(odd.where("false")).count() == 0
    assert suffix_dedup.suffix_dedup(odd.where("false")).count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/de/", "https://EXAMPLE.com/de/1", "http://x.org/fr/", "http://x.org/en/", "http://notexample.com/de/", "http://x.net", "mailto:a@x.net/", None, "", "http://y.com/ads/1", "ftp://q/://a.net/", "http://y.com?u=http://a.net/"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(0, urls[0], "v")], "page_id long, url string, verdict string")
    got = url_filter.url_filter(df, url_filter.LISTED + url_filter.PLAIN).collect()
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls) + 1
    assert by == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "allow"), 12: (None, "allow")}
    assert url_filter.url_filter(df.where("false"), url_filter.LISTED).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    rows = [(i, [random.randint(-50, 50) for _ in range(8)]) for i in range(700)] + [(i, [9] * 8) for i in range(700, 1000)]
    rows += [(1000, [1] * 5), (1001, None), (1002, [None] * 8), (None, [1] * 8)]
    for name, value in (("SAMPLE", 64), ("LEAVES", 9), ("BLOCK", 50), ("QUERIES", 10)):
        monkeypatch.setattr(top_k, name, value)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<long>, rank string")
    got = {}
    for r in top_k.exact_top_k(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for q, v in (r for r in usable if r[0] % 20 == 0):
        best = sorted((-dot(v, w), i) for i, w in usable if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert top_k.exact_top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_of_negative_products(spark):
    """Leaves of radius 0 whose score equals a negative kth score, and a tie with it, aren't pruned."""
    rows = [(0, [100, 0]), (1, [-100, 0]), (2, [-100, 1]), (3, [-100, 2]), (4, [-100, 3]), (5, [-100, 4]), (6, [-100, 5])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in top_k.exact_top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(k, k, -10000) for k in range(1, 6)]


def test_quantised_leaves_out_bad_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["vector"]) for r in top_k.quantised(df).collect()] == [(1, [128, -1])]


def weighted_sets(texts, weights):
    doc, shingle, count = near_dedup.shingles([np.frombuffer(t.encode(), np.uint8) for t in texts])
    out = [{} for _ in texts]
    for d, x, w in zip(doc.tolist(), shingle.tolist(), weights.of(shingle, count).tolist(), strict=True):
        out[d][x] = w
    return out


def weighted_jaccard(a, b):
    shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1e-9)


def classes(texts, weights, threshold=0.8):
    """The smallest number of each text's class, by all pairs."""
    sets, root = weighted_sets(texts, weights), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or weighted_jaccard(sets[i], sets[j]) >= threshold:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op7_near_dedup"](spark, SF).collect()}
    weights = near_dedup.document_frequencies(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got == {d: texts[i][0] for (d, _), i in zip(texts, classes([t for _, t in texts], weights), strict=True)}


def test_document_frequencies_are_exact(spark):
    """With few counters as with many, whatever is frequent is counted over all documents."""
    random.seed(4)
    docs = [" ".join(random.choice(["a b c d e f", "b c d e f g h", "x y z"]) + f" {random.randrange(3000)}" for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in docs], "text string").repartition(5)
    views = [np.frombuffer(t.encode(), np.uint8) for t in docs]
    keys, counts = np.unique(near_dedup.shingles(views)[1], return_counts=True)
    for counters in (1 << 16, 64, 16):
        least = max(1.0, counts.sum() / counters)
        want = {k: 1 + near_dedup.RAISE * np.log(400 / n) / np.log(400 / least) for k, n in zip(keys.tolist(), counts.tolist(), strict=True) if n > least}
        got = near_dedup.document_frequencies(df, counters)
        assert dict(zip(got.keys.tolist(), got.factor.tolist(), strict=True)) == pytest.approx(want)


def test_near_duplicates_in_divided_groups(spark):
    """Families of edits, deletions and additions around one text, which is in the corpus or isn't: the same classes as by all pairs."""
    random.seed(8)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]

    def copy(words, edits):
        w = list(words)
        for _ in range(edits):
            i, kind = random.randrange(len(w)), random.random()
            w[i : i + 1] = [f"e{random.randrange(10**9)}"] if kind < 0.5 else [] if kind < 0.75 else [w[i], f"e{random.randrange(10**9)}"]
        return w

    families = [base, *(copy(base, k) for k in (3, 5, 8, 12)), base[:80], base + [f"t{i}" for i in range(60)]]
    docs = [" ".join(copy(random.choice(families[1:]), random.randrange(6))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = classes(docs, near_dedup.document_frequencies(df))
    assert len(set(want)) > 20
    # so many bands that hardly any link is left to chance
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df, bands=24, rows_of_band=2).collect()} == dict(enumerate(want))


def test_near_duplicates_on_odd_rows(spark, odd):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(odd).collect()}
    assert got == {None: None, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_large_group_of_loose_copies(spark):
    """Copies that are near to the original but not to each other all join its class, and looser ones don't."""
    random.seed(11)
    base = [f"w{random.randrange(10**6)}" for _ in range(400)]

    def copy(edits):
        w = list(base)
        for i in random.sample(range(len(w)), edits):
            w[i] = f"e{random.randrange(10**9)}"
        return " ".join(w)

    rows = [(i, copy(7)) for i in range(40)] + [(50, " ".join(base))] + [(100 + i, copy(60)) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, b0 long")).collect()}
    assert {got[i] for i in [*range(40), 50]} == {0}
    assert all(got[100 + i] == 100 + i for i in range(40))


def test_contamination(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    changed = item.replace("delta", "DIFFERENT").replace("kappa", "x")
    rows = [(1, f"before {changed} after"), (2, "quite another text " * 9), (3, " ".join(item.split()[:6])), (None, item), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["offset"], r["agreeing"], r["run"]) for r in contamination(docs, bench).collect()]
    assert got == [(1, 7, 1, 11, 13)]
    assert contamination(odd, bench).count() == 0
    assert contamination(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.7, 0.9, 1.0])
def test_masks_leave_no_pattern_of_substitutions_out(share):
    for width in range(1, 16):
        misses = decontaminate.allowed(width, share)
        masks = decontaminate.masks_for(width, misses)
        hits = [{at + o for o, x in enumerate(m) if x == "1"} for m in masks for at in range(width - len(m) + 1)]
        assert all(any(not hit & set(p) for hit in hits) for p in itertools.combinations(range(width), misses))


def test_contamination_equals_the_rule(spark):
    """Every item of 1 to 14 tokens with every allowed pattern of substitutions, and one too many, against the rule itself."""
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in range(1, 15)}
    texts = []
    for n, words in items.items():
        for k in range(decontaminate.allowed(min(n, 13), 0.8) + 2):
            texts += [[f"x{j}" if j in p else w for j, w in enumerate(words)] for p in itertools.combinations(range(n), k)]
    texts = [["before"] * (i % 3) + t + ["after"] * (i % 2) for i, t in enumerate(texts)] + [items[13][2:], items[14][:11]]
    want = set()
    for d, t in enumerate(texts):
        for n, b in items.items():
            width, found = min(n, 13), []
            for shift in range(-n, len(t)):
                same = [0 <= j + shift < len(t) and t[j + shift] == b[j] for j in range(n)]
                most = max(sum(same[i : i + width]) for i in range(n - width + 1))
                found += [(-most, shift)] if most * 5 >= width * 4 else []
            want |= {(d, n, min(found)[1], -min(found)[0], width)} if found else set()
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(b)) for n, b in items.items()] + [(99, "?!")], "item_id long, text string")
    assert {tuple(r) for r in contamination(docs, bench).collect()} == want
    assert {1, 4, 9, 10, 13} <= {x[1] for x in want}


def test_language_on_held_out_rows(spark, odd):
    out = queries.QUERIES["op5_language_id"](spark, SF)
    lang = {r[0]: r[2] for r in table("documents")}
    held = [r for r in out.collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(odd, F.lit(True), carry=("label",)).collect()}
    assert got[1] == got[2] == got[5] == got[8] == ("und", 0.0)
    assert {r["lang_pred"] for r in identify(odd, F.lit(False)).collect()} == {"und"}
    assert identify(odd.where("false"), F.lit(True)).count() == 0


def test_toxicity_pairs_of_terms(spark, odd):
    """Two terms that are harmless alone weigh together; the linear part can't see that."""
    random.seed(2)
    rows = [(random.random() < 0.5, random.random() < 0.5) for _ in range(1500)]
    make = lambda a, b: np.array(sorted([*([11] if a else []), *([22] if b else []), *random.sample(range(100, 400), 5)]))
    found = toxicity.Sparse([make(a, b) for a, b in rows])
    label = np.array([float(a and b) for a, b in rows])
    fm = toxicity.FactorizationMachine.fit(found, label, epochs=20)
    test = toxicity.Sparse([np.array(x) for x in ([11, 22], [11], [22], [150])])
    m = fm.margin(*test.take(np.arange(4)), 4)
    assert m[0] > 2 and m[1:].max() < 0.5 and abs(fm.factor[11] @ fm.factor[22]) > 0.05


def test_toxicity_finds_training_terms_in_new_texts(spark, odd):
    rows = [(i, f"plain text number {i} " + ("with an insultword inside" if i % 4 == 0 else "and nothing else")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)
    none = toxicity.toxicity(odd, labels.where("false"), F.lit(True)).collect()
    assert len(none) == odd.count() and {r["score"] for r in none} == {0.5}


def test_quality_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.quality(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good = [r for r in got if r["quality"] == 1]
    assert sum(r["keep"] for r in good) >= 0.95 * len(good)
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) >= 0.9 * len(got)
    none = quality.quality(odd, labels.where("false")).collect()
    assert len(none) == odd.count() and all(r["keep"] for r in none)


def paths(voc, word):
    def go(at, score, ids):
        if at == len(word):
            yield score, ids
        for end, piece, s in voc.edges(word, at) if at < len(word) else ():
            yield from go(end, score + s, ids + ([piece] if piece >= 0 else voc.spell_unknown(ord(word[at]))))

    return sorted(go(0, 0.0, []), key=lambda x: -x[0])


def test_n_best_equals_enumeration():
    voc = pieces.Vocabulary(*pieces.load_vocabulary())
    for word in ("▁hello", "▁thation", "▁éta漢t", "▁a\nb", "▁▁x", "abc"):
        got, want = voc.n_best(word, 6), paths(voc, word)[:6]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_encoding_round_trip_and_scores():
    voc = pieces.Vocabulary(*pieces.load_vocabulary())
    texts = ["hello thation.", "", "a  b\n\nc", " x", "a▁b 漢字é", "word " * 3, "on-line! " + "x" * 100]
    ids, scores = pieces.encode_block(voc, texts, 4)
    for text, own, best in zip(texts, ids, scores, strict=True):
        assert pieces.decode_ids(voc, own).decode() == text
        if text:
            word = "▁" + "".join(chr(pieces.OWN_MARK) if c == "▁" else "▁" if c == " " else c for c in text)
            assert best == pytest.approx([s for s, _ in voc.n_best(word, 4)])


def test_n_best_segmentations_of_texts(spark):
    voc = pieces.Vocabulary(*pieces.load_vocabulary())
    texts = ["hello thation.", "", "a  b\n\nc", " x", "a▁b 漢字é", "word word", "on-line! " + "x" * 70, "a", None, "the same words the same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode(docs, carry=("text",), check=True).collect():
        if r["text"] is None:
            assert r["n_best"] is None and r["ids"] is None and r["scores"] is None
            continue
        ids = [tuple(x["ids"]) for x in r["n_best"]]
        assert r["round_trip"] and len(set(ids)) == len(ids)
        assert list(ids[0]) == r["ids"] and [x["score"] for x in r["n_best"]] == r["scores"]
        if not r["text"]:
            assert ids == [()]
            continue
        word = "▁" + "".join(chr(pieces.OWN_MARK) if c == "▁" else "▁" if c == " " else c for c in r["text"])
        every = voc.n_best(word, 40)
        assert r["scores"] == pytest.approx([s for s, _ in every[:4]])
        score = {tuple(x): s for s, x in every}
        assert [score[x] for x in ids] == pytest.approx(r["scores"])
        assert all(pieces.decode_ids(voc, np.array(x)).decode() == r["text"] for x in ids)


def test_encoding_odd_rows(spark, odd):
    out = {r["doc_id"]: r for r in pieces.decode(pieces.encode(odd, carry=("text", "label")), carry=("doc_id", "text", "ids", "label")).collect()}
    assert out[1]["ids"] is None and out[1]["decoded"] is None and out[2]["ids"] == []
    assert all(r["decoded"] == r["text"] for r in out.values())
    assert pieces.encode(odd.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r, strict=True)) for r in want.fetchall()]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda r: str([r[c] for c in columns])
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, rows))


def test_carried_columns_with_the_names_of_outputs(spark):
    rows = [(1, "some words of a text", "a"), (2, None, "b")]
    base = spark.createDataFrame(rows, "doc_id long, text string, x string")
    for run, names in ((lambda d, c: identify(d, F.lit(False), carry=c), ("lang_pred", "score")), (lambda d, c: substring_dedup.substring_dedup(d, carry=c), ("n_words", "spans", "kept")), (lambda d, c: suffix_dedup.suffix_dedup(d, carry=c), ("n_bytes", "spans", "kept")), (lambda d, c: pieces.encode(d, carry=c), ("ids", "n_best", "scores"))):
        wide = base.select("doc_id", "text", F.lit("en").alias("lang"), *(F.col("x").alias(n) for n in (*names, "chunk", "carried")))
        out = run(wide, (*names, "chunk", "carried"))
        assert {r["doc_id"]: [r[f"{n}_given"] for n in names] + [r["chunk"], r["carried"]] for r in out.collect()} == {1: ["a"] * (len(names) + 2), 2: ["b"] * (len(names) + 2)}


@pytest.mark.parametrize("block", [256, 3])
def test_products_beyond_64_bits(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "LARGE", block)
    random.seed(17)
    big = (2.0**40, -(2.0**40), 1e300, -1e300, 2.0**31, 2.0**62, 7e18)
    rows = [(i, [float(random.randint(-9, 9)) for _ in range(random.choice((2, 3)))]) for i in range(40)]
    rows += [(i, [random.choice((*big, float(random.randint(-5, 5)))) for _ in range(3)]) for i in range(40, 60)] + [(50, [1.0, 2.0, 3.0]), (7, [2.0**40, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    got = {}
    for r in top_k.exact_top_k(df, F.col("vec_id") % 2 == 0, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [int(x) for x in v]) for i, v in rows]
    asks = {}
    for i, v in rows:
        if i % 2 == 0:
            asks[i] = min(asks.get(i, v), v)
    for q, v in asks.items():
        own = [int(x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(own, w, strict=False)), i) for i, w in whole if i != q)[:4]
        assert sorted(got[q]) == [(n + 1, i, min(2**63 - 1, max(-(2**63), -s))) for n, (s, i) in enumerate(best)]


def test_one_huge_vector_leaves_the_query_running(spark):
    rows = [(i, [i / 7, 1.0, -0.5]) for i in range(60)] + [(60, [3e38, 1.0, 0.0]), (61, [1e308, 0.0, 0.0])]
    df = top_k.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = top_k.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 50 and r["rank"] < 3} == {(50, 1, 61), (50, 2, 60)}
    assert max(r["score"] for r in got) == 2**63 - 1


def test_queries_of_models_and_segmentations(spark):
    docs, labels = ({r[0]: r for r in table(t)} for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for d, r in got.items())
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_quality"](spark, SF).collect()}
    known = [d for d, r in labels.items() if r[1] is not None]
    assert set(got) == set(docs) and sum(got[d]["keep"] == (labels[d][1] == 1) for d in known) >= 0.9 * len(known)
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("score", "content_score", "page_score"))
    voc = pieces.Vocabulary(*pieces.load_vocabulary())
    for r in queries.QUERIES["op10_sentencepiece"](spark, SF).collect():
        assert r["round_trip"] and r["n_ids"] == len(pieces.encode_block(voc, [docs[r["doc_id"]][1]], 1)[0][0])
        assert r["scores"] == sorted(r["scores"], reverse=True)


def test_models_score_odd_rows(spark, odd):
    """Null, empty, very long and repeated rows under models that have learned something."""
    rows = [(i, ("nice words in a row " if i % 2 else "junk %% $$ ** insultword ") * (1 + i % 3), "en", "s", 60, "x") for i in range(100, 500)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(100, 500)], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(docs, labels, F.lit(True)), quality.quality(docs, labels)):
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        same = {r["score"] for r in got if r["doc_id"] == 3}
        assert len(same) == 1
