"""The pipeline's stages take effect and keep what they should."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = cp.saved(stage(spark, docs, SF))
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert set(rows) <= set(before), name
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
            texts = {d: r["text"] for d, r in rows.items()}
            if name == "near_dedup":
                assert len(set(texts.values())) == len(texts)
            if name == "suffix_dedup":
                assert set(rows) == set(before)
                assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
                seen = set()
                for d in sorted(before):
                    raw = before[d].encode()
                    gone = [raw[j : j + 100] in seen or seen.add(raw[j : j + 100]) is not None for j in range(len(raw) - 99)]
                    assert any(gone) == (texts[d] != before[d])
            else:
                assert all(before[d] == t for d, t in texts.items())
            before = texts
    assert all(r["ids"] is not None for r in rows.values())


def test_odd_rows(spark):
    rows = [(None, "some words without an id", "en", "s", 24), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "the same text twice over", "en", "s", 24), (3, "the same text twice over", "en", "s", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "None"]
    kept = cp.keep_known_languages(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3", "None"]
    cut = {r["doc_id"]: r for r in cp.cut_repeats(spark, docs, SF).collect()}
    assert cut[1]["text"] is None and cut[2]["text"] == "" and cut[1]["n_chars"] == 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


CLASHING = "score lang_pred lang_pred_given stays chunk kept leak ids n_best scores _null spans n_bytes n_words copy carried gone stand b0 digest label band space key rest asking place part round_trip Text2".split()


def test_columns_with_the_names_of_outputs_and_inner_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHING))
    for i, (name, stage) in enumerate(cp.STAGES):
        plain, got = stage(spark, docs, SF), stage(spark, wide, SF)
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in plain.select("doc_id").collect()}, name
        if i < len(cp.STAGES) - 1:
            assert got.columns == wide.columns
            assert all(r[c] == f"{c} of {r['doc_id']}" for r in got.collect() for c in CLASHING)
            assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
        else:
            assert all(r["ids_given"] == f"ids of {r['doc_id']}" for r in got.collect())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.saved(stage(spark, docs, SF))
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"]), tuple(r["scores"])) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(docs)


def test_unlike_texts_go_and_short_clean_ones_stay(spark):
    random.seed(6)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [w for r in known.where("lang = 'en' and n_chars > 200").limit(200).collect() for w in r["text"].split()[3:7]]
    rows = [(10**6 + i, " ".join(words[4 * i : 4 * i + 3]), "en") for i in range(150)]
    rows += [(2 * 10**6 + i, "".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(600)), None) for i in range(50)]
    mixed = known.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in cp.keep_known_languages(spark, mixed, SF).collect()}
    assert sum(10**6 + i in kept for i in range(150)) >= 147
    assert sum(2 * 10**6 + i in kept for i in range(50)) <= 5
