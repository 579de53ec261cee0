"""Spelling variants: a symmetric-delete join of words, and forms followed to their roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.session import cut_lineage, materialize

LETTERS = r"A-Za-zÀ-ÿ"
FORMS = "word string, form string, root string, n long, n_near long, form_n long"

#: An odd multiplier and its inverse modulo 2**64, so that a deleted code point shifts what follows by one power.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 50_000) -> DataFrame:
    """``doc_id, run``: the maximal letter runs of whole texts, with A to Z in lower case.

    A text is first cut into pieces of about ``piece`` characters that end
    where a run ends, so that a very long text isn't a single array of runs.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.col(text_col).cast("string")
    pieces = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}[{LETTERS}]*"), F.lit(0))).alias("_piece"))
    found = pieces.select("doc_id", F.explode(F.regexp_extract_all("_piece", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))


def misspelt(doc_id: Column, run: Column, one_in: int) -> Column:
    """``run`` without one code point if ``one_in`` divides the crc32 of ``<doc_id>:<run>``; the code point is at crc32 % length.

    A null ``doc_id`` is written as nothing.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, 1, at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, one_in: int = 199, length: int = 6, occurrences: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the results of :func:`misspelt` with ``length`` code points and ``occurrences`` or more, over all documents."""
    words = runs(docs, id_col, text_col).select(misspelt(F.col("doc_id"), F.col("run"), one_in).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(place in words, key)`` of every word and of its distinct single deletions.

    Keys are 64-bit polynomial hashes of code points, so a word of any
    length takes memory in proportion to it; equal strings have equal keys.
    Of a run of one code point only the first is deleted, as the others give
    the same string.
    """
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(points)) - np.repeat(starts, sizes)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), _BASE)]), dtype=np.uint64)
    values = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[within], dtype=np.uint64)])
    first, last = sums[starts], sums[ends]
    whole = last - first
    place = np.arange(len(points))
    before, after = sums[place] - first[word], last[word] - sums[place + 1]
    distinct = (within == 0) | (points != np.roll(points, 1))
    deleted = (before + after * _BACK)[distinct]
    return np.concatenate([np.arange(len(texts)), word[distinct]]), np.concatenate([whole, deleted]).view(np.int64)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: the ids of words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    ``words`` (``wid, word``) holds distinct words and is stable when read
    again. Two such words share a key: one is a deletion of the other, or
    both have the same deletion. Those that share a key otherwise, or by a
    collision, fail the exact check.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ends = np.cumsum(pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(batch):  # a few million bytes of words at a time
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (2 << 20), side="right")))
                some = batch.slice(at, stop - at)
                place, key = deletion_keys(some.column("word"))
                yield pa.RecordBatch.from_arrays([pa.array(key), some.column("wid").take(pa.array(place))], names=["key", "wid"])
                at = stop

    keys = materialize(words.select("wid", "word").mapInArrow(run, "key long, wid long"), "deletions")
    shared = keys.select("key", F.col("wid").alias("a")).join(keys.select("key", F.col("wid").alias("b")), "key").where("a < b").select("a", "b").distinct()
    left, right = (words.select(F.col("wid").alias(x), F.col("word").alias(f"{x}_word")) for x in "ab")
    return shared.join(left, "a").join(right, "b").where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, where forms lead nowhere in a circle: the last form of each word.

    Each round joins every word's last known form to that one's own, so the
    rounds are logarithmic in the longest chain.
    """
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = joined.drop("_moved")
        if not joined.where("_moved").limit(1).count():
            return roots


def spelling_variants(docs: DataFrame, ratio: int = 5, one_in: int = 199, length: int = 6, occurrences: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``FORMS``: a row a word.

    Words are counted over whole texts (:func:`count_words`). A word's form
    is its near word (:func:`near_pairs`) of largest ``n``, the smallest in
    code-point order among equals, if that ``n`` is at least ``ratio`` times
    the word's own; ``root`` is reached by following forms to the last.
    ``n_near`` is the number of near words.

    Null and empty texts hold no words, and no words give no rows. Repeated
    rows count as often as they occur. Extra columns play no part.

    Counts combine before the shuffle, however frequent a word is. A key is
    shared by words that differ by one code point from a common string: by
    few, in any language, and never by more than the alphabet allows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead upwards")
    counted = materialize(count_words(docs, one_in, length, occurrences, id_col, text_col), "counted")
    words = materialize(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("wid"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    named = both.join(words.select(F.col("wid").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near_word").alias("form"), F.col("near").alias("fid"))).alias("best"))
    up = best.select("wid", "n_near", "best.form", "best.fid", (-F.col("best.m")).alias("form_n"))
    told = materialize(words.join(up, "wid", "left").withColumn("_up", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))), "forms")
    roots = follow(told.where("_up").select(F.col("wid").alias("word"), F.col("fid").alias("form")))
    rooted = roots.join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select(F.col("word").alias("wid"), "root_word")
    own = lambda c: F.when(F.col("_up"), F.col(c))
    return told.join(rooted, "wid", "left").select(
        "word", own("form").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), own("form_n").alias("form_n")
    )
