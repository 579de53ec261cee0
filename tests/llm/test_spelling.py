import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattis.llm import spelling as S


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain(docs, one_in=199, length=6, occurrences=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= occurrences}
    mates = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(mates[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(mates[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = found(S.spelling_variants(docs))
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[1] is not None for r in got) >= 20


@pytest.mark.parametrize("seed", range(4))
def test_many_variants_of_few_words(spark, seed):
    rng = random.Random(seed)
    stems = ["aabbcc", "rainbow", "ÀÉñandú", "ßtraße×", "bookkeeper", "zzzzzzz"]
    rows = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = list(rng.choice(stems[: 1 + i % 6]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
            text.append("".join(w))
        rows.append((i if i % 10 else None, rng.choice([" ", "-", "1", " ½ "]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.spelling_variants(docs, one_in=7)) == plain(rows, 7)


def test_odd_rows_and_none(odd_docs, no_docs, spark):
    assert found(S.spelling_variants(odd_docs)) == plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found(S.spelling_variants(no_docs)) == []
    clash = spark.createDataFrame([(1, "rainbow " * 9, "x", 3, "y")], "doc_id long, text string, word string, n int, run string")
    assert found(S.spelling_variants(clash)) == plain([(1, "rainbow " * 9)])


def test_very_long_words_and_texts(spark):
    long = "".join(random.Random(3).choice("abcde") for _ in range(60_000))
    rows = [(i, long if i % 2 else long[:30_000] + long[30_001:]) for i in range(24)] + [(90, "x" * 50_000), (91, ("rain" * 4 + ". ") * 20_000), (92, ("Rain" * 4 + "s\n") * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.spelling_variants(docs)) == plain(rows)


def test_pieces_end_where_runs_end(spark):
    text = "ab 12 çdé\U0001f600x" * 50 + "é" * 40 + "\n\n" + "q"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [r["run"] for r in S.runs(docs, piece=7).collect()]
    assert got == [r.lower() for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_keys_of_distinct_deletions():
    words = ["aab", "ab", "xab", "", "b"]
    place, key = S.deletion_keys(pa.array(words))
    by = {w: [k for p, k in zip(place, key) if words[p] == w] for w in words}
    assert [len(by[w]) for w in words] == [3, 3, 4, 1, 2]
    assert by["ab"][0] in by["aab"] and by["ab"][0] in by["xab"] and by["b"][0] in by["ab"] and by[""][0] in by["b"]
    assert len(S.deletion_keys(pa.array([], pa.string()))[0]) == 0


def test_chains_lead_to_the_last_form(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "word long, form long")
    assert {r["root"] for r in S.follow(links).collect()} == {n}
    assert S.follow(links.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)
