"""Best-fit packing of token pieces by bin completion over the length histogram.

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the search runs on the counts by length (a bounded table, whatever the
corpus), and gives *patterns*: a filling and the number of sequences that use
it. Pieces are then placed by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattis.llm.memory import trimmed
from lattis.llm.tokens import run_memo
from lattis.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, n_sequences long, least_sequences long"


# ---------------------------------------------------------------- search


def completions(counts: np.ndarray, room: int, most: int = 6, effort: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths that are left.

    Fuller fillings come first and, of equally full ones, those with fewer
    and larger items. A filling is dominated, and isn't listed, if it leaves
    room for another item at hand, or if some of its items can be exchanged
    for one larger or equal item at hand (:func:`dominated`). Of fillings
    that are all dominated by some that weren't met, the first stays.
    ``effort`` bounds the items tried once a filling has been found.
    """
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {}
    smallest = int(np.flatnonzero(counts[: room + 1])[0]) if counts[: room + 1].any() else 0
    if not smallest:
        return [()]
    sizes = np.flatnonzero(counts[: room + 1])[::-1]

    def descend() -> None:
        """Depth first, largest items first. The nesting is a list: a filling may hold as many items as the room has tokens."""
        left: dict[int, int] = {}
        tries, space, chosen = effort, room, []
        nested = [[0, False]]  # by chosen item: the next place in ``sizes``, and whether any item has fitted
        while nested:
            k = nested[-1][0]
            while k < len(sizes) and counts[sizes[k]] <= left.get(int(sizes[k]), 0):
                k += 1
            if k == len(sizes):
                if not nested.pop()[1]:
                    found[tuple(chosen)] = room - space
                if chosen:
                    s = chosen.pop()
                    left[s] -= 1
                    space += s
                continue
            if tries <= 0 and found:
                return
            tries -= 1
            s = int(sizes[k])
            nested[-1] = [k + 1, True]
            if space - s < smallest:
                found[(*chosen, s)] = room - space + s
                if space == s and sum(1 for v in found.values() if v == room) >= 2:
                    return
                continue
            left[s] = left.get(s, 0) + 1
            chosen.append(s)
            space -= s
            nested.append([k + int(np.searchsorted(-sizes[k:], -space)), False])

    # pairs that fill the room exactly are the commonest best case: find them first
    half = sizes[sizes * 2 >= room]
    mates = half[(counts[room - half] > 0) & ((room - half != half) | (counts[half] > 1))]
    for s in mates[: most // 2 + 1]:
        found[(int(s), int(room - s))] = room
    if len(found) < 2:
        descend()
    ranked = sorted(found, key=lambda f: (-found[f], len(f), tuple(-x for x in f)))
    at_hand = int.from_bytes(np.packbits(counts[: room + 1] > 0, bitorder="little").tobytes(), "little")
    free = (f for f in ranked[: 16 * most] if not dominated(f, room, at_hand & ~sum(1 << s for s in set(f) if counts[s] <= f.count(s))))
    return list(islice(free, most)) or ranked[:1]


def dominated(filling: tuple[int, ...], room: int, at_hand: int) -> bool:
    """Whether items of ``filling`` can be exchanged for one item at hand that is larger, or as large as two or more.

    Bit t of ``at_hand`` tells whether an item of t tokens is left beside the
    filling. Whatever packing goes on from the filling goes on as well after
    the exchange, as what comes out fits where the other item was.
    """
    slack = room - sum(filling)
    any_of, many = 1, 0  # bit t: some items (two or more of them) have t tokens together
    for s in filling:
        many |= (many | (any_of & ~1)) << s
        any_of |= any_of << s
    # every sum plus 1 to ``slack``, by doubling the span that is covered
    reach, covered = (any_of & ~1) << 1 if slack else 0, 1
    while covered < slack:
        more = min(covered, slack - covered)
        reach |= reach << more
        covered += more
    return bool(at_hand & (reach | many))


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the sequences: tokens / capacity, and what large pieces waste.

    For a threshold ``a`` up to half the capacity, pieces over ``capacity -
    a`` are alone among those of ``a`` and more, pieces over half the capacity
    are in sequences of their own, and what the others of ``a`` and more need
    beyond the room left there takes further sequences. Of pieces longer than
    a (k + 1)-th of the capacity, k at most fit together. The best of all counts.
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    n, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    half = capacity // 2 + 1  # the least length of which no two fit
    a = np.arange(0, capacity // 2 + 1)
    alone = n[-1] - n[capacity - a + 1]
    from_ = np.minimum(half, capacity - a + 1)
    single = n[capacity - a + 1] - n[from_]
    room = single * capacity - (tokens[capacity - a + 1] - tokens[from_])
    small = tokens[from_] - tokens[np.minimum(a, from_)]
    k = np.arange(1, 65)
    some = -(-(n[-1] - n[capacity // (k + 1) + 1]) // k)
    return int(max((alone + single + np.maximum(0, -(-(small - room) // capacity))).max(), some.max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram, as patterns like :func:`solve`'s.

    Pieces come longest first, each into the fullest sequence that has room.
    Sequences of equal content are one entry with their number, so the work
    follows the distinct lengths, not the pieces.
    """
    open_: dict[int, list[tuple[tuple, int]]] = {}  # by room left: (filling as nested pairs, number)
    for s in np.flatnonzero(counts)[::-1].tolist():
        if s == 0:
            continue
        left = int(counts[s])
        for room in sorted(r for r in open_ if r >= s):
            fits, stay, moved = room // s, [], []
            for filling, n in open_.pop(room):
                full = min(n, left // fits)
                left -= full * fits
                if full:
                    moved.append((room - fits * s, ((filling, s, fits), full)))
                n -= full
                if n and left:  # fewer pieces than one sequence takes
                    moved.append((room - left * s, ((filling, s, left), 1)))
                    n, left = n - 1, 0
                if n:
                    stay.append((filling, n))
            if stay:
                open_[room] = stay
            for r, entry in moved:
                open_.setdefault(r, []).append(entry)
            if not left:
                break
        fits = capacity // s
        for times, k in ((left // fits, fits), (1, left % fits)):
            if times and k:
                open_.setdefault(capacity - k * s, []).append((((), s, k), times))

    def flat(filling: tuple) -> tuple[int, ...]:
        parts = []
        while filling:
            filling, s, k = filling
            parts.append((s,) * k)
        return tuple(x for part in reversed(parts) for x in part)

    return [(flat(filling), n) for entries in open_.values() for filling, n in entries]


@dataclass
class Packing:
    """Patterns ``(lengths of one sequence, number of such sequences)``, how many sequences they are, and a lower bound."""

    patterns: list[tuple[tuple[int, ...], int]]
    sequences: int
    least: int


def solve(counts: np.ndarray, capacity: int, budget: int = 2_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths of one sequence, number of such sequences)``.

    Branch and bound: each node takes the largest length that is left and
    completes its bin in every undominated way, each as often as the counts
    allow, or else half as often. Best-fit decreasing is the first incumbent,
    and completes the first ``dives`` nodes for further ones, so the result
    never takes more sequences than best fit. A branch ends when its
    sequences so far plus the waste bound reach the incumbent; the search
    stops at the lower bound or after ``budget`` nodes.
    """
    return pack_counts(counts, capacity, budget).patterns


def pack_counts(counts: np.ndarray, capacity: int, budget: int = 2_000, dives: int = 100) -> Packing:
    """:func:`solve`, with the number of sequences and the lower bound; equal, they prove that there can't be fewer."""
    counts = counts.astype(np.int64).copy()
    floor = least_bins(counts, capacity)
    if not counts.any():
        return Packing([], 0, 0)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    path: list[tuple[tuple[int, ...], int]] = []
    used, spent = 0, 0

    def options(width: int) -> list[tuple[tuple[int, ...], int]]:
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        ways = completions(counts, capacity - top, width)
        counts[top] += 1
        out = []
        for way in ways:
            filling = (top, *way)
            need = {s: filling.count(s) for s in set(filling)}
            out.append((filling, min(int(counts[s]) // k for s, k in need.items())))
        return out + [(filling, n // 2) for filling, n in out if n > 1]

    def apply(step: tuple[tuple[int, ...], int], sign: int) -> None:
        for s in step[0]:
            counts[s] -= sign * step[1]

    stack: list[Iterator[tuple[tuple[int, ...], int]]] = []
    if best_n > floor:
        stack.append(iter(options(4)))
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                last = path.pop()
                apply(last, -1)
                used -= last[1]
            continue
        spent += 1
        if spent > budget or best_n <= floor:
            break
        apply(step, 1)
        if used + step[1] + least_bins(counts, capacity) >= best_n:
            apply(step, -1)
            continue
        path.append(step)
        used += step[1]
        rest = best_fit(counts, capacity) if dives > 0 and counts.any() else []
        dives -= 1
        if (rest or not counts.any()) and used + (n := sum(k for _, k in rest)) < best_n:
            best, best_n = [*path, *rest], used + n
        if not counts.any():
            path.pop()
            apply(step, -1)
            used -= step[1]
        else:
            stack.append(iter(options(4)))
    return Packing(best, best_n, floor)


class Placement:
    """Where the piece of a given length and rank goes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for filling, times in patterns:
            offset = 0
            for s in dict.fromkeys(filling):
                k = filling.count(s)
                rows.setdefault(s, []).append((ranks.get(s, 0), base, k, offset))
                ranks[s] = ranks.get(s, 0) + k * times
                offset += k * s
            base += times
        self.tables = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in rows.items()}
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for s in np.unique(length):
            at = length == s
            first, base, copies, begin = self.tables[int(s)]
            r = rank[at]
            i = np.searchsorted(first, r, side="right") - 1
            local = r - first[i]
            sequence[at] = base[i] + local // copies[i]
            offset[at] = begin[i] + local % copies[i] * s
        return sequence, offset


# ------------------------------------------------------------- operators


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and, but for one long text, ``size`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(max(stop, at + 1), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole texts: each text's identifiers and ``end_id``.

    Columns ``PIECES``. Only texts longer than ``capacity`` are cut; a null
    text counts as empty and is the end identifier alone. ``part`` and
    ``idx`` number the pieces of a length within their task. Rows repeat as
    often as their document does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        memo = run_memo(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for some in _slices(trimmed(batches)):
            texts = [t or "" for t in some.column(1).to_pylist()]
            ids, bounds = memo.encode(texts)
            out: list[tuple] = []
            for key, a, b in zip(some.column(0).to_pylist(), bounds.tolist(), bounds.tolist()[1:]):
                for piece, at in enumerate(range(a, b + 1, capacity)):
                    stop = min(at + capacity, b)
                    crc = zlib.crc32(ids[at:stop])
                    n = stop - at
                    if at + capacity > b:
                        crc, n = zlib.crc32(end, crc), n + 1
                    out.append((key, piece, at - a, n, crc, part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, budget: int = 2_000) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; columns ``PACKED``.

    ``n_sequences`` is the number of sequences in all, and
    ``least_sequences`` a lower bound on it: where they are equal, the
    packing is proven to be as short as can be; where they aren't, their
    difference is the most that a longer search could win.
    ``pieces`` must be stable when read again (a written table). No pieces
    give no rows. To the driver goes one count for each length, so at most
    ``capacity`` rows; ranks across tasks come from the counts by task and
    length. All pieces are packed together, whatever task they came from.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    packing = pack_counts(counts, capacity, budget)
    placement = Placement(packing.patterns)
    totals = [pa.scalar(packing.sequences, pa.int64()), pa.scalar(packing.least, pa.int64())]
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placement.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset), *(pa.repeat(t, len(batch)) for t in totals)], names=[x.split()[0] for x in PACKED.split(", ")])

    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("idx")).alias("rank"))
    return ranked.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`cut_pieces`, written once, then :func:`pack`."""
    return pack(materialize(cut_pieces(docs, tokenizer, capacity, 0, id_col, text_col), "pieces"), capacity)
