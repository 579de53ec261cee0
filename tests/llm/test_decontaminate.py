import random
from collections import Counter

import numpy as np

from lattis.llm import decontaminate as D


def slow(docs, items, least=0.8, each=5):
    """Every window of every document against every item."""
    found = set()
    shingles = lambda w: Counter(tuple(w[i : i + min(each, len(w))]) for i in range(len(w) - min(each, len(w)) + 1))
    for key, text in docs:
        words = D.words_of(text)
        for item, passage in items:
            own = D.words_of(passage)
            if own and any(D.similarity(shingles(words[i : i + len(own)]), shingles(own)) >= least for i in range(len(words) - len(own) + 1)):
                found.add((key, item))
    return found


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([1, 3, 5, 15, 20, 30, 45, 60, 60, 60])]
    docs = []
    for k in range(60):
        words = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            own = list(rng.choice(items[3:])[1])
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(0, 2)] = [rng.choice(vocabulary)] * rng.randrange(0, 2)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((k, " ".join(words).replace("w1 ", "W1, ")))
    return docs, [(k, " ".join(w)) for k, w in items]


def test_equals_brute_force(spark):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = slow(docs, items)
    for block in (20_000, 3):
        rows = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == expected and len(rows) == len(expected)
    assert len(expected) > 40
    assert any(r["similarity"] < 1 for r in rows) and any(r["hamming"] > 0 for r in rows)


def test_items_longer_than_the_document_equal_brute_force(spark):
    """Documents that are an item with words cut off or deleted, against every item as one window."""
    rng = random.Random(11)
    items = [(k, [f"x{k}y{i}" if rng.random() < 0.8 else "the" for i in range(n)]) for k, n in enumerate([2, 3, 4, 5, 6, 8, 9, 12, 15, 20, 30, 40, 40, 59])]
    docs = []
    for _, own in items:
        for cut in range(12):
            docs += [own[: len(own) - cut], own[cut:], [w for i, w in enumerate(own) if i not in rng.sample(range(len(own)), min(len(own), cut // 4))]]
    rows = [(k, " ".join(w)) for k, w in enumerate(docs)]
    passages = [(k, " ".join(w)) for k, w in items]
    shingles = lambda w, each: Counter(tuple(w[i : i + each]) for i in range(len(w) - each + 1))
    expected = {}
    for key, words in enumerate(docs):
        for item, own in items:
            n, each = min(len(own), len(words)), min(5, len(own))
            best = max((D.similarity(shingles(words[i : i + n], each), shingles(own, each)) for i in range(len(words) - n + 1)), default=0)
            if best >= 0.8:
                expected[key, item] = (round(best, 9), n)
    found = D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["n_words"]) for r in found} == expected
    assert len(found) == len(expected) > len(slow(rows, passages)) + 50
    forty = next(k for k, w in enumerate(docs) if w == items[11][1][:39])
    assert expected[forty, 11] == (round(35 / 36, 9), 39)


def test_index_gives_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 9, 12))) for k in range(80)]
    (group,) = D.ItemIndex(items).groups
    probe = group.prints[rng.integers(0, 80, 200)]
    for _ in range(18):
        probe = probe ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    found = {*zip(*(x.tolist() for x in group.candidates(probe, 19)[:2]))}
    near = np.bitwise_count(probe[:, None] ^ group.prints[None, :]) <= 19
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the rain", "x"), (3, "the wind of the hill blows", "x"), (3, "the wind of the hill blows", "x"), (4, "id", None)], "item_id long, text string, doc_id string")
    rows = D.find_contamination(odd_docs, benchmark).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in rows) == [("1", 3), ("None", 4)]
    kept = D.keep_clean(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert D.find_contamination(no_docs, benchmark).collect() == []
    assert D.find_contamination(odd_docs, benchmark.limit(0)).collect() == []
    assert D.keep_clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_blocks_are_looked_up_under_all_values_in_reach():
    """More items of one length than values in reach: looked up, a few windows at a time."""
    rng = np.random.default_rng(2)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 50, 12))) for k in range(4_000)]
    (group,) = D.ItemIndex(items).groups
    assert all(len(values) > len(D._masks(4)) for values, _, _ in group.blocks)
    probe = group.prints[rng.integers(0, 4_000, 60)]
    for _ in range(16):
        probe = probe ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    near = np.bitwise_count(probe[:, None] ^ group.prints[None, :]) <= 19
    for cells in (1 << 22, 5_000):
        window, item, distance = group.candidates(probe, 19, cells)
        assert {*zip(window.tolist(), item.tolist())} == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}
        assert (np.bitwise_count(probe[window] ^ group.prints[item]) == distance).all()


def test_documents_are_read_once_however_many_items(spark):
    docs, items = corpus()
    found = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=2)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_the_radius_loses_no_similar_window():
    """Windows that differ in as many shingles as similarity 0.8 allows."""
    rng = np.random.default_rng(0)
    for m in (9, 15, 30, 56):
        a = rng.integers(0, 1 << 62, (1_500, m)).astype(np.uint64) * np.uint64(4)
        k = m // 9
        b = a.copy()
        b[:, :k] = rng.integers(0, 1 << 62, (1_500, k)).astype(np.uint64) * np.uint64(4)
        mix = lambda x: D._mix(x.ravel()).reshape(x.shape)
        assert (m - k) / (m + k) >= 0.8
        assert np.bitwise_count(D.signature(mix(a)) ^ D.signature(mix(b))).max() <= 23
