import numpy as np
import xxhash

from lattis.llm import simhash_bk as S


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x1c")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, ids):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if label[i] != label[j] and bin(values[i] ^ values[j]).count("1") <= 3:
                    low = min(label[i], label[j])
                    high = max(label[i], label[j])
                    label = [low if x == high else x for x in label]
                    changed = True
    return [min((ids[k] for k in range(len(ids)) if label[k] == label[i] and ids[k] is not None), default=None) for i in range(len(ids))]


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        assert S.simhash(r["text"]) == slow_print(r["text"])
    for text in ("A b", "É\x0bA  É b\x1cc d", "x", "one two three", "a a a a a a"):
        assert S.simhash(text) == slow_print(text)


def chain(rng, n):
    """Fingerprints in clusters, chains and at random."""
    out = [int(x) for x in rng.integers(0, 1 << 63, n)]
    for k in range(n):
        x = out[int(rng.integers(0, len(out)))]
        for _ in range(int(rng.integers(1, 5))):
            x ^= 1 << int(rng.integers(0, 64))
        out.append(x)
    return out


def test_components_equal_brute_force(spark):
    values = chain(np.random.default_rng(2), 150)
    ids = [None if k == 7 else k for k in range(len(values))]
    rows = [(i, int(np.uint64(v).astype(np.int64))) for i, v in zip(ids, values)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    for shard_size in (16_384, 3):
        groups = prints.select("fp").distinct()
        links = {(r["src"], r["dst"]) for r in S.link_fingerprints(groups, shard_size=shard_size, batch_rows=50).collect()}
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") > 0 for a, b in links)
        roots = {r["node"]: r["component"] for r in S.connected_components(spark.createDataFrame(list(links), "src long, dst long")).collect()}
        own = [roots.get(fp, fp) for _, fp in rows]
        slow = components(values, list(range(len(values))))
        assert len({*zip(own, slow)}) == len(set(own)) == len(set(slow))
    found = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(prints).collect()), key=str)
    assert found == sorted(zip(ids, components(values, ids)), key=str)


def test_tree_search_equals_brute_force():
    rng = np.random.default_rng(4)
    values = np.unique(np.array(chain(rng, 200), dtype=np.uint64))
    forest = S.BKForest(values, np.zeros(len(values), np.int64))
    found = {(int(q), int(n)) for a, b in forest.within(np.arange(len(values)), 3) for q, n in zip(a, b)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}
    own = forest.parent[forest.parent >= 0], np.flatnonzero(forest.parent >= 0)
    assert (np.bitwise_count(values[own[0]] ^ values[own[1]]) == forest.edge[own[1]]).all()


def test_odd_rows_and_the_filter(odd_docs, no_docs):
    found = S.near_duplicate_documents(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[5]["component_id"] == 4 and by_id[6]["component_id"] == 2 and by_id[2]["fingerprint"] == "0" * 16
    kept = S.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 7, 8]
    assert S.near_duplicate_documents(no_docs).collect() == [] and S.keep_one_of_each(no_docs).collect() == []


def test_repeats_of_a_kept_id_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert [r["doc_id"] for r in S.keep_one_of_each(docs).collect()] == [1]
