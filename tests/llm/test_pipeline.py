"""Each stage of the pipeline against a plain version over what the stage before kept."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lattis.llm import decontaminate, simhash_bk
from lattis.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[1:5])
    assert all(set(ids(b)) <= set(ids(a)) for a, b in zip(steps[:4], steps[1:5]))


def test_quality_keeps_good_labels_and_drops_bad(spark, steps):
    kept = set(ids(steps[1]))
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert np.mean([(i in kept) == (q == 1) for i, q in labels]) > 0.9


def test_near_dedup_keeps_the_smallest_of_each_group(steps):
    rows = [(r["doc_id"], simhash_bk.simhash(r["text"])) for r in steps[2].collect()]
    group = {i: i for i, _ in rows}
    for i, a in sorted(rows):
        for j, b in sorted(rows):
            if j < i and bin(a ^ b).count("1") <= 3:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert ids(steps[3]) == sorted(i for i, g in group.items() if i == g)


def test_decontamination_drops_passages(spark, steps):
    items = [" ".join(w.decode() for w in decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in steps[3].collect():
        text = " ".join(w.decode() for w in decontaminate.words_of(r["text"]))
        if any(f" {x} " in f" {text} " for x in items):
            assert r["doc_id"] not in ids(steps[4])
    assert len(ids(steps[4])) < len(ids(steps[3])) or ids(steps[3]) == ids(steps[4])


def test_packing_places_every_kept_document(steps):
    assert sorted({r["doc_id"] for r in steps[5].collect()}) == ids(steps[4])


def test_run_and_entry(spark, steps):
    assert "pipeline" in __spark_entry__.queries()
    found = corpus_pipeline.run(spark, SF)
    assert found.count() == steps[5].count()


def test_empty_and_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.drop("score", "fp")
    for start in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, start, SF).columns == start.columns, name
            stage(spark, start, SF).collect()
