import zlib

import numpy as np

from lattis.llm import quality_gbt as Q


def test_trees_fit_and_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = Q.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    for row, margin in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9


def test_one_label_or_no_rows_give_a_constant():
    x = np.zeros((5, len(Q.FEATURES)))
    assert len(set(Q.fit(x, np.ones(5)).score(x))) == 1
    assert Q.fit(np.zeros((0, len(Q.FEATURES))), np.zeros(0)).score(x).tolist() == [0.5] * 5


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r["doc_id"]: r for r in Q.score_documents(docs, labels).collect()}
    assert len(found) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    own = [(found[i]["predicted"], q) for i, q in truth.items() if found[i]["held_out"]]
    assert np.mean([p == q for p, q in own]) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (4, None), (None, 1), (4, 7)], "doc_id long, quality int")
    assert Q.score_documents(odd_docs, labels).count() == odd_docs.count()
    assert all(r["score"] is not None for r in Q.score_documents(odd_docs, labels).collect())
    assert Q.score_documents(no_docs, labels).collect() == []
    assert Q.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert len(Q.statistics(None)) == len(Q.statistics("a b. C!!\nd | e")) == len(Q.FEATURES)
