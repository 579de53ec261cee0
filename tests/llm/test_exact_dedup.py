import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattis.llm import exact_dedup as E


def plain(docs, largest):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        best = (max if largest else min)(named) if named else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", [E.content_hash, lambda t: F.length(t) % 3, lambda t: F.lit(1)])
def test_equals_a_plain_version_whatever_the_hash(odd_docs, keep, hashed):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows(E.exact_duplicates(odd_docs.repartition(3), keep, hashed=hashed)) == plain(docs, keep == "largest")


def test_a_third_of_all_rows_in_one_group(spark):
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the one text").when(F.col("id") % 7 == 0, F.concat(F.lit("t"), F.col("id") % 11)).otherwise(F.col("id").cast("string")).alias("text"))
    assert rows(E.exact_duplicates(docs, "largest")) == plain([tuple(r) for r in docs.collect()], True)


def test_empty_table_and_clashing_columns(spark, no_docs):
    assert rows(E.exact_duplicates(no_docs)) == []
    docs = spark.createDataFrame([(1, "a", "x", 1, "h"), (2, "a", None, 2, "h")], "doc_id long, text string, keep_id string, group_size int, _hash string")
    assert rows(E.exact_duplicates(docs)) == plain([(1, "a"), (2, "a")], False)
    assert [r["doc_id"] for r in E.keep_one_of_each(docs).collect()] == [1]


def test_normalised_texts_and_an_unknown_choice(spark):
    docs = spark.createDataFrame([(1, " A b "), (2, "a b"), (3, "a  b")], "doc_id long, text string")
    found = {r["doc_id"]: r["keep_id"] for r in E.exact_duplicates(docs, normalise=lambda t: F.lower(F.trim(t))).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        E.exact_duplicates(docs, "newest")


def test_kept_rows_hold_every_text_once(odd_docs):
    kept = E.keep_one_of_each(odd_docs, "smallest").select("doc_id", "text").distinct().collect()
    texts = {r["text"] or "" for r in odd_docs.collect()}
    assert len(kept) == len(texts) and {r["text"] or "" for r in kept} == texts


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert rows(E.exact_duplicates(docs)) == plain([tuple(r) for r in docs.collect()], False)
    assert sorted(map(str, E.keep_one_of_each(docs).collect())) == sorted(map(str, docs.where("doc_id = 4 or text = 'b'").collect()))


def test_main_path_is_native(spark, sf_dir):
    from lattis.llm.queries import op12_exact_dedup

    plan = op12_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
