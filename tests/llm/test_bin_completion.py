import bisect
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattis.llm import bin_completion as B
from lattis.llm.tokens import run_memo

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The least number of bins, by trying every placement."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[k] <= capacity:
                rest = list(bins)
                rest.remove(b)
                place(k + 1, [*rest, b + lengths[k]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_as_few_bins_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, rng.integers(1, 11)).tolist()
    patterns = B.solve(np.bincount(lengths, minlength=21), 20)
    assert all(sum(f) <= 20 for f, _ in patterns)
    used = sorted(itertools.chain.from_iterable(list(f) * n for f, n in patterns))
    assert used == sorted(lengths)
    assert sum(n for _, n in patterns) == fewest(lengths, 20)


def test_large_histograms_reach_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(2048, rng.geometric(1 / 400, 200_000)), minlength=2049)
    n = sum(k for _, k in B.solve(counts, 2048))
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert n <= bound * 1.001
    assert B.solve(np.zeros(9, int), 8) == []


@pytest.mark.parametrize("lengths", [{1: 5_000}, {1: 5_000, 2: 700}, {1: 66_000, 300: 40, 700: 50, 2048: 3}])
def test_fillings_of_very_many_pieces(lengths):
    counts = np.zeros(2049, dtype=int)
    counts[list(lengths)] = list(lengths.values())
    patterns = B.solve(counts, 2048)
    assert all(sum(f) <= 2048 for f, _ in patterns)
    used = sum(n * np.bincount(f, minlength=2049) for f, n in patterns)
    assert (used == counts).all()
    assert sum(n for _, n in patterns) == -(-int((counts * np.arange(2049)).sum()) // 2048)


def test_many_empty_texts(spark):
    docs = spark.range(5_000).selectExpr("id as doc_id", "case when id % 2 = 0 then '' end as text")
    rows = B.pack_documents(docs, PATH).collect()
    check(rows, docs.collect(), 2048)
    assert len({r["sequence_id"] for r in rows}) == 3


def check(rows, docs, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    t = Tokenizer.from_file(PATH)
    expected = []
    for r in docs:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(str(r["doc_id"]), k // capacity, k, len(own), zlib.crc32(own.tobytes())) for k in range(0, len(ids), capacity) for own in [ids[k : k + capacity]]]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_every_piece_is_placed_once(odd_docs, capacity):
    check(B.pack_documents(odd_docs.repartition(3), PATH, capacity).collect(), odd_docs.collect(), capacity)


def test_no_documents(no_docs):
    assert B.pack_documents(no_docs, PATH).collect() == []


def test_memo_equals_the_tokenizer_and_stays_bounded():
    texts = ["Hello's WORLD  x <|endoftext|> İs ½² é ﬁ 漢字 it's we'll 123 _a_b!!", "", " \n ", "don't’s “q”\x1c á é", "x" * 5000, *(f"w{i}z, q{i % 9}" for i in range(300))]
    whole = Tokenizer.from_file(PATH)
    memo = run_memo(PATH)
    small = type(memo)(PATH, most=50)
    for m in (memo, small, small):
        for some in (texts[:3], texts[3:100], texts):
            ids, ends = m.encode(some)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("seed", range(25))
def test_the_lower_bound_holds(seed):
    rng = np.random.default_rng(100 + seed)
    lengths = rng.integers(1, 21, rng.integers(1, 11)).tolist()
    counts = np.bincount(lengths, minlength=21)
    packing = B.pack_counts(counts, 20)
    assert B.least_bins(counts, 20) == packing.least <= fewest(lengths, 20) == packing.sequences


def test_the_bound_sees_what_large_pieces_waste():
    rng = np.random.default_rng(3)
    for lengths, gap in ((rng.integers(600, 720, 9000), 0), (np.r_[rng.integers(900, 1200, 5000), rng.integers(1, 300, 3000)], 0.002), (rng.integers(500, 2049, 8700), 0.002), (np.r_[np.ones(1_000_000, int)], 0)):
        packing = B.pack_counts(np.bincount(lengths, minlength=2049), 2048)
        assert 0 <= packing.sequences - packing.least <= gap * packing.sequences


def test_exchanges():
    bits = lambda *lengths: sum(1 << s for s in lengths)
    assert B.dominated((5, 3), 10, bits(4)) and B.dominated((5, 3), 10, bits(7)) and B.dominated((5, 3), 8, bits(8))
    assert not B.dominated((5, 3), 8, bits(4, 6)) and not B.dominated((5, 3), 10, bits(11, 3)) and not B.dominated((5, 3), 10, 0)


@pytest.mark.parametrize("empty", [1_100, 3_000])
def test_empty_texts_beside_a_long_one(spark, empty):
    docs = spark.range(empty).selectExpr("id as doc_id", "'' as text").union(spark.createDataFrame([(-1, "the rain " * 1500)], "doc_id long, text string"))
    rows = B.pack_documents(docs, PATH).collect()
    check(rows, docs.collect(), 2048)
    assert {(r["n_sequences"], r["least_sequences"]) for r in rows} == {(len({r["sequence_id"] for r in rows}),) * 2}


def best_fit_decreasing(lengths, capacity):
    """Sequences of plain best fit, a piece at a time."""
    rooms, n = [], 0
    for s in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, s)
        n += i == len(rooms)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - s)
    return n


def never_above_best_fit(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    plain = best_fit_decreasing(lengths.tolist(), capacity)
    assert sum(n for _, n in B.best_fit(counts, capacity)) == plain
    packing = B.pack_counts(counts, capacity)
    assert (sum(n * np.bincount(f, minlength=capacity + 1) for f, n in packing.patterns) == counts).all()
    assert all(sum(f) <= capacity for f, _ in packing.patterns)
    assert packing.least <= packing.sequences == sum(n for _, n in packing.patterns) <= plain
    return plain - packing.sequences


@pytest.mark.parametrize("seed", range(50))
def test_never_above_best_fit_on_small_mixes(seed):
    rng = np.random.default_rng(1_000 + seed)
    low = int(rng.integers(1, 40))
    never_above_best_fit(rng.integers(low, int(rng.integers(low + 1, 101)), int(rng.integers(1, 400))), 100)


@pytest.mark.parametrize("seed", range(3))
def test_never_above_best_fit_on_narrow_mixes(seed):
    rng = np.random.default_rng(seed)
    never_above_best_fit(np.clip(rng.normal(690, 60, 4_000).astype(int), 1, 2048), 2048)
    never_above_best_fit(np.clip(rng.normal(690, 30, 20_000).astype(int), 1, 2048), 2048)
    assert never_above_best_fit(rng.integers(450, 950, 5_000), 2048) > 0  # here the search finds more
