import random

from hypothesis import given
from hypothesis import strategies as st

from lattis.llm import license_scan as L


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest(a, b)


@given(st.permutations(list(range(9))), st.permutations(list(range(9))))
def test_alignment_of_unique_words_is_longest(a, b):
    assert len(L.align(a, b)) == longest(a, b)


@given(st.lists(st.integers(0, 9), max_size=12))
def test_increasing_subsequence(values):
    at = L.increasing(values)
    assert all(i < j and values[i] < values[j] for i, j in zip(at, at[1:]))
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(at) == max(best, default=0)


def test_every_template_is_found_in_a_long_text_and_nothing_else_is():
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["the", "of", "work", "is", "under", "license", "in", "any", "rain", "hill"]) for _ in range(n))
    read = L.Template.all_of(L.TEMPLATES)
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            found = L.scan(L.words_of(f"{filler(300)}\n{t.upper()}\n{filler(2000)} License {t}"), read, 0.8)
            assert (name, 1.0) in [x[:2] for x in found]
            words = t.split()
            if len(words) > 20:
                del words[7], words[12]
                assert name in [x[0] for x in L.scan(L.words_of(filler(50) + " " + " ".join(words)), read, 0.8)]
    assert L.scan(L.words_of("the work under a version of the public rain is licensed"), read, 0.8) == []


def test_odd_rows(odd_docs, no_docs, spark):
    rows = L.scan_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["license"] is None and r["coverage"] == 0 for r in rows)
    assert L.scan_documents(no_docs).collect() == []
    docs = spark.createDataFrame([(1, "Released under the MIT License. Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    (r,) = L.scan_documents(docs).collect()
    assert (r["license"], r["coverage"], r["n_licenses"]) == ("CC-BY-NC-4.0", 1.0, 2)


def test_neighbouring_licenses_are_told_apart():
    read = L.Template.all_of(L.TEMPLATES)
    expected = {
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Licensed under CC BY 3.0.": None,
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Released under the BSD License.": None,
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache Software License, Version 2.0.": None,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This library is licensed under the GNU General Public License version 3, see below.": "GPL-3.0",
    }
    for text, name in expected.items():
        for around in ("{}", "some rain. {} Under the hill a license of the work is public."):
            assert [x[0] for x in L.scan(L.words_of(around.format(text)), read, 0.8)][:1] == ([name] if name else []), text


def test_a_longer_license_hides_the_one_it_contains():
    read = L.Template.all_of(L.TEMPLATES)
    two, three = L.words_of(L.TEMPLATES["BSD-2-Clause"][0]), L.words_of(L.TEMPLATES["BSD-3-Clause"][0])
    assert [x[0] for x in L.scan(two, read, 0.8)] == ["BSD-2-Clause"]
    assert [x[0] for x in L.scan(three, read, 0.8)] == ["BSD-3-Clause"]
    del three[40], three[50]
    assert [x[0] for x in L.scan(three, read, 0.8)] == ["BSD-3-Clause"]
    assert [x[0] for x in L.scan([*three, *["rain"] * 200, *two], read, 0.8)] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_gaps_within_a_notice():
    """Words strewn into a notice: found as long as one and a half templates hold enough of it."""
    read = L.Template.all_of(L.TEMPLATES)
    words = L.words_of(L.TEMPLATES["MIT"][1])
    key = read[[t.license for t in read].index("MIT") + 1].keys[0]
    at = [k for k in range(0, len(words), 4) if not key[0] < k < key[1]]
    strewn = [w for k, x in enumerate(words) for w in (["zzz", x] if k in at else [x])]
    assert [x[:2] for x in L.scan(strewn, read, 0.8)] == [("MIT", 1.0)]


def slow_scan(words, templates, least, margin=0.5):
    """Every stretch that begins with a word of a template, whatever it holds."""
    found = []
    for t in templates:
        reach = len(t.words) + max(2, int(margin * len(t.words)))
        for a, w in enumerate(words):
            pairs = t.covered(words[a : a + reach], least) if w in t.counts else []
            if pairs:
                found.append((-len(pairs) / len(t.words), t.license, a + pairs[0][0], a + pairs[-1][0] + 1, t.contains))
    out = []
    for coverage, name, a, b, _ in sorted(set(found), key=lambda m: m[:4]):
        inside = any(name in inner and a < d and c < b for *_, c, d, inner in found)
        if not inside and all(name != x[0] and (b <= x[2] or a >= x[3]) for x in out):
            out.append((name, -coverage, a, b))
    return out


def test_scan_equals_a_scan_of_every_stretch():
    rng = random.Random(4)
    texts = {"A": ("p q [r s] t u v w",), "B": ("p q [r x] t u v w",), "C": ("p q [r s] t u v w y z [m n] o",), "D": ("a b a b c a",)}
    read = L.Template.all_of(texts)
    assert read[[t.license for t in read].index("C")].contains == {"A"}
    hits = 0
    for _ in range(400):
        words = [rng.choice("pqrstuvwxyzmnoabc") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            own = list(rng.choice(read).words)
            for _ in range(rng.randrange(3)):
                own.insert(rng.randrange(len(own)), rng.choice("kpqa"))
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        found = L.scan(words, read, 0.8)
        assert found == slow_scan(words, read, 0.8)
        hits += len(found)
    assert hits > 100
