import numpy as np
import public_tokenizers
import pytest

from lattis.llm import files
from lattis.llm.token_counts import count_document_tokens, count_tokens
from lattis.llm.tokens import byte_bpe
from lattis.session import new_shared_path

RANKS, END = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256


def count(spark, docs, **how):
    return count_document_tokens(spark, docs, RANKS, public_tokenizers.PATTERN, **how)


@pytest.mark.parametrize("block_bytes", [64, 4 << 20])
def test_counts_equal_the_tokenizer(spark, odd_docs, block_bytes):
    encoding = byte_bpe(RANKS, public_tokenizers.PATTERN)
    expected = sorted((r["doc_id"] or -1, len(encoding.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect())
    small = odd_docs if block_bytes > 64 else odd_docs.where("n_chars < 1000 or n_chars is null")
    if block_bytes == 64:
        expected = [x for x in expected if x[0] not in (4, 5)]
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in count(spark, small, block_bytes=block_bytes).collect()) == expected


def test_no_documents(spark, no_docs):
    assert count(spark, no_docs).collect() == []


def write(spark, ids, dtype="<u2"):
    path = f"{new_shared_path(spark, 'test')}/flat.bin"
    with files.create(path) as f:
        f.write(np.array(ids, dtype=dtype).tobytes())
    return spark.createDataFrame([(path,), (path,)], "file string")


@pytest.mark.parametrize("block_bytes", [2, 6, 1000])
def test_boundaries_across_blocks(spark, block_bytes):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 300)
    expected, start = [], 0
    for k, end in enumerate([*np.flatnonzero(ids == 0), *([300] if ids[-1] else [])]):
        expected.append((k, start, int(end) - start, end < 300))
        start = int(end) + 1
    found = count_tokens(write(spark, ids), 0, block_bytes=block_bytes).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in found] == expected


def test_file_without_an_end_and_empty_file(spark):
    assert [(r["n_tokens"], r["ended"]) for r in count_tokens(write(spark, [5, 6, 7]), 0, block_bytes=2).collect()] == [(3, False)]
    assert count_tokens(write(spark, []), 0).collect() == []


def test_a_file_of_a_gigabyte(spark):
    """In blocks of 4 MB; the window sees numbers a block, and no block's ends."""
    path = f"{new_shared_path(spark, 'test')}/flat.bin"
    part = np.ones(1 << 24, dtype="<u2")
    part[[5, 6, 3_000_000, 9_999_999]] = 0
    with files.create(path) as f:
        for _ in range(32):
            f.write(part.tobytes())
    assert files.size(path) == 1 << 30
    found = count_tokens(spark.createDataFrame([(path,)], "file string"), 0)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("ends" in line for line in windows)
    rows = found.orderBy("ordinal").collect()
    files.remove(path)
    ends = np.concatenate([np.array([5, 6, 3_000_000, 9_999_999]) + k * len(part) for k in range(32)] + [[32 * len(part)]])
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in rows] == [(k, a + 1, b - a - 1, k < 128) for k, (a, b) in enumerate(zip([-1, *ends], ends.tolist()))]
