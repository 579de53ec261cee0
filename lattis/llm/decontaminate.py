"""Benchmark decontamination: SimHash windows as long as the items.

Every window of a document that is as long (in words) as some item gets a
64-bit SimHash of its word shingles. A multi-index over four blocks of the
items' fingerprints gives all items within the Hamming radius: of 64 bits
that differ in at most ``radius``, some block of 16 differs in at most a
quarter of them. Exact weighted-shingle similarity then decides.

Which windows need a fingerprint is bounded exactly beforehand: two equal
windows of ``m`` shingles with similarity ``t`` share ``2mt/(1+t)`` of them,
so a window in which fewer shingles occur in any item can't match one.

An item longer than the document is compared with the whole document, as one
window. There the items that share enough shingles are found exactly, without
the fingerprints: of few shingles, those differ too much.
"""

from __future__ import annotations

import itertools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm import files
from lattis.llm.memory import trimmed
from lattis.session import deal, materialize, new_shared_path

MATCH = "doc_id long, item_id long, similarity double, hamming int, start_word long, n_words long"
_base = np.uint64(0x9E3779B97F4A7C15)
_ascii_space = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates words like white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_ascii_space).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, from prefix sums of powers over joined bytes."""

    def __init__(self, size: int = 1 << 16):
        self.grow(size)

    def grow(self, size: int) -> None:
        odd, inverse = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, odd)], dtype=np.uint64)
        self.undo = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64)
        if len(data) + 1 > len(self.power):
            self.grow(2 * len(data) + 2)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = np.cumsum(length)
        start = stop - length
        total = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)]
        return _mix((total[stop] - total[start]) * self.undo[start] + length.astype(np.uint64) * _base)


def shingle_hashes(words: np.ndarray, each: int = 5) -> np.ndarray:
    """Hashes of all runs of ``each`` words; of fewer words, of the whole sequence."""
    if not len(words):
        return words
    each = min(each, len(words))
    n = len(words) - each + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(each):
        h = (h + words[i : n + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    return _mix(h)


def signature(windows: np.ndarray) -> np.ndarray:
    """The SimHash of each row of shingle hashes (repeats count); a bit is the majority's."""
    n, m = windows.shape
    bits = np.unpackbits(np.ascontiguousarray(windows).view(np.uint8).reshape(n, m, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > m, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts: sum of minima over sum of maxima."""
    low = sum(min(n, b[s]) for s, n in a.items())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


@dataclass
class ItemsOfLength:
    """The items of one length and the multi-index over their fingerprints."""

    n_words: int
    ids: np.ndarray
    shingles: np.ndarray
    prints: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def candidates(self, prints: np.ndarray, radius: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ``(window, item, distance)`` with fingerprints within ``radius``.

        A block of a window is looked up under all values that the radius
        allows, or compared with the items' values where those are fewer;
        ``cells`` bounds how many of either are held at a time.
        """
        masks = _masks(radius // 4)
        out = []
        step = max(1, cells // max(1, min(len(masks), max(len(values) for values, _, _ in self.blocks))))
        for a in range(0, len(prints), step):
            some, pairs = prints[a : a + step], []
            for b, (values, first, items) in enumerate(self.blocks):
                own = (some >> np.uint64(16 * b)).astype(np.uint16)
                if len(values) <= len(masks):
                    window, value = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= radius // 4)
                else:
                    slot = np.full(1 << 16, -1, dtype=np.int32)
                    slot[values] = np.arange(len(values))
                    value = slot[own[:, None] ^ masks[None, :]]
                    window = np.nonzero(value >= 0)[0]
                    value = value[value >= 0]
                many = first[value + 1] - first[value]
                at = np.repeat(first[value] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                window, item = np.repeat(window, many), items[at]
                near = np.bitwise_count(some[window] ^ self.prints[item]) <= radius
                pairs.append(window[near] * len(self.ids) + item[near])
            found = np.unique(np.concatenate(pairs))
            window, item = found // len(self.ids), found % len(self.ids)
            out.append((window + a, item, np.bitwise_count(some[window] ^ self.prints[item])))
        window, item, distance = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return window, item, distance

    def sharing(self, window: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ``(0, item, distance)`` of items with ``least`` or more shingles that ``window`` has too."""
        item = np.flatnonzero(np.isin(self.shingles, window).sum(axis=1) >= least)
        return np.zeros_like(item), item, np.bitwise_count(signature(window[None, :]) ^ self.prints[item])


_known_masks: dict[int, np.ndarray] = {}


def _masks(most: int) -> np.ndarray:
    """All 16-bit values of at most ``most`` set bits."""
    if most not in _known_masks:
        _known_masks[most] = np.array([sum(1 << i for i in chosen) for k in range(most + 1) for chosen in itertools.combinations(range(16), k)], dtype=np.uint16)
    return _known_masks[most]


class ItemIndex:
    """Items by length, and the set of all their shingles behind a bit filter."""

    def __init__(self, items: list[tuple[int, str]], each: int = 5, bits: int = 20):
        self.each = each
        hasher = WordHasher()
        lengths: dict[int, list[tuple[int, np.ndarray]]] = {}
        for key, text in items:
            hashes = hasher(words_of(text))
            if len(hashes):
                lengths.setdefault(len(hashes), []).append((key, shingle_hashes(hashes, each)))
        self.groups: list[ItemsOfLength] = []
        for n, rows in sorted(lengths.items()):
            shingles = np.array([s for _, s in rows])
            prints = signature(shingles)
            blocks = []
            for b in range(4):
                own = (prints >> np.uint64(16 * b)).astype(np.uint16)
                order = np.argsort(own, kind="stable")
                values, first = np.unique(own[order], return_index=True)
                blocks.append((values, np.r_[first, len(own)], order))
            self.groups.append(ItemsOfLength(n, np.array([k for k, _ in rows]), shingles, prints, blocks))
        every = [s for rows in lengths.values() for _, s in rows]
        self.shingles = {n: np.unique(np.concatenate([s for _, s in rows])) for n, rows in lengths.items() if n < each}
        long = [s for n, rows in lengths.items() if n >= each for _, s in rows]
        self.shingles[each] = np.unique(np.concatenate(long)) if long else np.empty(0, np.uint64)
        self.bits = bits
        self.filter = np.zeros(1 << bits, dtype=bool)
        for s in every:
            self.filter[s >> np.uint64(64 - bits)] = True

    def known(self, hashes: np.ndarray, each: int) -> np.ndarray:
        """Whether each shingle occurs in an item."""
        table = self.shingles[each]
        hit = self.filter[hashes >> np.uint64(64 - self.bits)]
        at = np.flatnonzero(hit)
        if len(at) and len(table):
            near = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
            hit[at] = table[near] == hashes[at]
        return hit if len(table) else np.zeros(len(hashes), dtype=bool)

    def matches(self, words: np.ndarray, least: float, radius: int, windows: int = 8_192) -> list[tuple[int, float, int, int, int]]:
        """``(item_id, similarity, hamming, start, n_words)``: each item's best window in the document."""
        best: dict[int, tuple[float, int, int, int]] = {}
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for group in self.groups:
            each = min(self.each, group.n_words)
            n_words = min(group.n_words, len(words))
            m, own = n_words - each + 1, group.n_words - each + 1
            if m < 1 or m < least * own - 1e-9:  # longer items differ even more
                break
            if each not in cache:
                hashes = shingle_hashes(words, each) if len(words) >= each else np.empty(0, np.uint64)
                cache[each] = hashes, np.r_[0, np.cumsum(self.known(hashes, each))]
            hashes, hits = cache[each]
            if not hits[-1]:
                continue
            shared = hits[m:] - hits[:-m]
            enough = np.ceil((m + own) * least / (1 + least) - 1e-9)
            starts = np.flatnonzero(shared >= enough)
            for k in range(0, len(starts), windows):
                chosen = starts[k : k + windows]
                rows = np.lib.stride_tricks.sliding_window_view(hashes, m)[chosen]
                pairs = group.sharing(rows[0], enough) if m < own else group.candidates(signature(rows), radius)
                for w, i, distance in zip(*pairs):
                    found = similarity(Counter(rows[w].tolist()), Counter(group.shingles[i].tolist()))
                    key, start = int(group.ids[i]), int(chosen[w])
                    if found >= least and (key not in best or (-found, start) < (-best[key][0], best[key][2])):
                        best[key] = (found, int(distance), start, n_words)
        return [(key, *x) for key, x in sorted(best.items())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 23, each: int = 5, block: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``MATCH`` for each document and item of which it holds a passage.

    The row tells the item's most similar window in the whole text (the
    first of equal ones), which is the whole text where the item is longer.
    Null and empty texts, and items without a word,
    match nothing; rows with a null id are reported under it; repeated rows
    give repeated matches; items that share an id give one row; other
    columns aren't read. No documents, or no items, give no rows.

    Items are indexed ``block`` at a time, by tasks, into files that the
    documents' tasks read one after the other; so a task holds one block,
    the driver the files' names, and documents are read and hashed once and
    never shuffled.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // block))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    folder = new_shared_path(docs.sparkSession, "items")
    written = materialize(deal(numbered, "block").sortWithinPartitions("block", "item_id", "text").select("block", "item_id", "text").mapInArrow(_index(folder, each), "file string"), "blocks")
    names = sorted(r["file"] for r in written.collect())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_search(names, least, radius), MATCH)


def _index(folder: str, each: int):
    """Writes each block of items as an index file and returns the files' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write() -> pa.RecordBatch:
            name = f"{folder}/{files.attempt_name(f'block{now}', '.items')}"
            with files.create(name) as out:
                out.write(pickle.dumps(ItemIndex(held, each), protocol=5))
            return pa.RecordBatch.from_pydict({"file": [name]})

        now, held = None, []
        for batch in batches:
            for k, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now and held:
                    yield write()
                    held = []
                now = k
                held.append((item, text))
        if held:
            yield write()

    return run


def _search(names: list[str], least: float, radius: int, words_at_once: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        columns = [x.split()[0] for x in MATCH.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        at_hand: tuple[str, ItemIndex] | None = None

        def search(held: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal at_hand
            for name in names:
                if at_hand is None or at_hand[0] != name:
                    at_hand = None  # before the next is read: one block at a time
                    at_hand = name, pickle.loads(files.read_range(name, 0, files.size(name)))
                out = [(key, *m) for key, words in held for m in at_hand[1].matches(words, least, radius)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=columns)

        held, n = [], 0
        for batch in trimmed(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = hasher(words_of(text.as_py()))
                if len(words):
                    held.append((key, words))
                    n += len(words)
                if n >= words_at_once:
                    yield from search(held)
                    held, n = [], 0
        if held:
            yield from search(held)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item; columns as they are.

    A row with a null id can't be named by a match and stays; so do null and
    empty texts. Repeated rows go or stay together.
    """
    found = find_contamination(docs, benchmark, least, id_col=id_col, text_col=text_col)
    # written, so that the size of this set is known where it is joined: documents move only if it is large
    gone = materialize(found.where("doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
