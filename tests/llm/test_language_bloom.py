import zlib

import numpy as np
import pytest

from lattis.llm import language_bloom as L


def test_filters_contain_all_and_counts_are_corrected():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(3)]
    bloom = L.BitSlicedBloom.build(["a", "b", "c"], sets, bits=14, hashes=3)
    for i, own in enumerate(sets):
        assert ((bloom.members(own) >> i) & 1).all()
    probe = np.concatenate([sets[1][:1000], rng.integers(0, 1 << 63, 9000).astype(np.uint64)])
    counts = bloom.counts(probe)
    assert abs(counts[1] - 1000) < 250 and counts[0] < 250 and counts[2] < 250


def test_ngrams_see_letters_and_word_ends_only():
    assert (L.ngrams("Ab, c1d")[0] == L.ngrams("ab--C 9 D")[0]).all()
    assert L.ngrams("123 !")[1] is False and L.ngrams("")[1] is False and L.ngrams("x")[1] is True


def test_many_languages_use_wider_slots():
    sets = [np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(20)]
    bloom = L.BitSlicedBloom.build([f"l{k:02}" for k in range(20)], sets, bits=16)
    assert bloom.slots.dtype == np.uint32
    assert bloom.counts(sets[13]).argmax() == 13


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify_documents(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_odd_rows(odd_docs, no_docs):
    rows = L.identify_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 6, 7)) for r in rows)
    kept = L.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 5}
    assert not {r["doc_id"] for r in kept.collect()} & {2, 3, 6, 7}
    assert L.identify_documents(no_docs).collect() == [] and L.keep_identified(no_docs).collect() == []


def test_more_than_64_languages(spark):
    words = lambda k: " ".join("".join(chr(97 + (k * 7 + i * j * j + k * i) % 26) for j in range(6)) + chr(0x4E00 + k) for i in range(40))
    rows = [(100 * k + i, words(k), f"l{k:03}") for k in range(70) for i in range(8 + (k < 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bloom = L.train(docs)
    assert len(bloom.languages) == 70 == len(bloom.share) and bloom.slots.shape[0] == 2
    assert [bloom.decide(words(k))[0] for k in range(70)] == bloom.languages
    assert L.keep_identified(docs).count() == len(rows)
    with pytest.raises(ValueError, match="languages at most"):
        L.train(docs.selectExpr("doc_id", "text", "cast(doc_id as string) as lang").union(spark.range(9_000, 9_900).selectExpr("id", "'a'", "cast(id as string)")))


def test_texts_too_short_for_an_ngram_get_the_commonest_language(spark):
    docs = spark.createDataFrame([(k, "ein kurzer Satz vom Regen" if k > 3 else "a short line of rain", "de" if k > 3 else "cs") for k in range(20)], "doc_id long, text string, lang string")
    bloom = L.train(docs)
    assert bloom.languages == ["cs", "de"] and bloom.decide("x") == ("de", 0.0, 0.0) and bloom.decide("1") == ("und", 0.0, 0.0)
    assert bloom.decide("qqqq qqqq")[0] == "de"
