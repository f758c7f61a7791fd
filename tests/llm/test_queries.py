"""Each registered query over a small folder of awkward documents, and the helpers they share."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import common, language, pii
from vigil.llm.components import components
from vigil.llm.queries import queries

COLUMNS = {
    "op1_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op2_sentencepiece": {"doc_id", "n_tokens", "ids"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_quality": {"doc_id", "held_out", "score", "predicted"},
    "op5_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op7_line_dedup": {"doc_id", "text"},
    "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "un") for b in ("da", "sen", "por", "ix")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " \n ", "word " * 30_000, texts[0], texts[0], "a line\nof text\na line\n" * 50]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, texts[3]), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, len(texts)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    place, n = folder
    got = queries()[name](spark, place)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    assert len(rows) == n and {r.doc_id for r in rows} == set(range(n))
    if "score" in got.columns:
        assert all(0 <= r.score <= 1 for r in rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ein Satz", "x", 2.0)], "doc_id long, text string, lang_pred string, score double")
    got = language.identify(docs, language.train([("de", "ein Satz"), ("en", "a sentence")])).first()
    assert got.lang_pred in ("de", "en") and 0 <= got.score <= 1


def test_ftrl_weights_are_sparse():
    rows = [(y, f"{y} " * 5 + str(k)) for y in ("aa", "bb") for k in range(40)]
    assert (language.train(rows).w == 0).mean() > 0.7


def test_components_of_a_hub_and_a_chain(spark):
    links = [(0, k) for k in range(1, 1500)] + [(k, k + 1) for k in range(2000, 2060)] + [(3000, 3000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 1500)) and all(got[k] == 2000 for k in range(2001, 2061)) and 3000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)], "key long, x long")
    unique = spark.createDataFrame([(k, k * 10) for k in range(95)], "key long, y long")
    got = common.join_hot(rows, unique, "key", how, hot_rows=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(unique, "key", how).collect()), key=str)


def test_lowest_is_exact(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("y"))
    got = {(r.y, r.doc_id) for r in common.lowest(rows, "y", 7, 3).collect()}
    every = sorted((r.y, r.h, r.doc_id) for r in rows.withColumn("h", F.xxhash64("doc_id")).collect())
    assert got == {(y, d) for v in range(3) for y, _, d in [e for e in every if e[0] == v][:7]}


def test_pii_recall_and_many_spans():
    rng, found, all_ = random.Random(99), {}, {}
    for text, spans in pii._synthetic(rng, 400):
        got = pii.detector().spans(text)[1]
        for s, e, k in spans:
            all_[k] = all_.get(k, 0) + 1
            found[k] = found.get(k, 0) + any(k == x[2] and abs(s - x[0]) <= 2 and abs(e - x[1]) <= 2 for x in got)
    assert all(found[k] >= 0.9 * n for k, n in all_.items())
    assert len(pii.detector().spans("mail a.b@c.de, " * 20_000)[0]) == 20_000
