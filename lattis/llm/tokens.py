"""Whole-text token identifiers, by a public tokenizer, as little-endian bytes."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A character outside these: regex engines may split a text with it in
#: different ways, or NFC may change it. Without one, a run without white
#: space has the same identifiers in every text.
ODD = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")


class RunMemo:
    """Identifiers of a ``tokenizers`` file that drops white space, by memo.

    Lower-cased runs without white space are told apart and looked up in
    Arrow; those not seen yet are encoded together by the tokenizer, as words
    of one sequence. Texts with an ``ODD`` character, or with the opening of
    a special token, go to the tokenizer as they are. Both ways give the
    tokenizer's own identifiers. A memo that outgrows ``most`` runs keeps
    the half that it met first.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known = pa.array([], pa.large_string())
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' identifiers in one array, and where each text's begin (and the last's end)."""
        plain = np.fromiter(("<|" not in t and (t.isascii() or ODD.search(t) is None) for t in texts), bool, len(texts))
        runs = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain)], pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        first = np.cumsum(self.length) - self.length
        ids, many = _gather(self.ids, first, self.length, place[coded.indices.to_numpy()])
        ends = np.r_[0, np.cumsum(many)][runs.offsets.to_numpy()]
        if len(self.known) > self.most:  # common runs are met early
            self.length = self.length[: self.most // 2].copy()
            self.ids = self.ids[: int(self.length.sum())].copy()
            self.known = pa.concat_arrays([self.known.slice(0, self.most // 2), pa.array([], pa.large_string())])
        if plain.all():
            return ids, ends
        parts = [ids[a:b] if p else self._whole(t) for t, p, a, b in zip(texts, plain, ends, ends[1:])]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _places(self, runs: pa.Array, at_once: int = 2_000) -> np.ndarray:
        """Where in the memo each of the distinct ``runs`` is; new ones are added."""
        place = pc.fill_null(pc.index_in(runs, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.known) + np.arange(len(new))
        fresh = runs.take(pa.array(new))
        words = fresh.to_pylist()
        ids, length = [self.ids], [self.length]
        for k in range(0, len(words), at_once):
            own = words[k : k + at_once]
            found = self.tokenizer.encode(own, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, dtype="<u4"))
            length.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(own)))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids, self.length = np.concatenate(ids), np.concatenate(length)
        return place


def _gather(values: np.ndarray, first: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``which`` of ``values``, end to end, and their lengths."""
    many = length[which]
    shift = first[which] - (np.cumsum(many) - many)
    return values[np.repeat(shift, many) + np.arange(many.sum())], many


_open: dict[tuple, object] = {}


def run_memo(path: str) -> RunMemo:
    """One memo a worker process and file."""
    key = ("runs", path)
    if key not in _open:
        _open[key] = RunMemo(path)
    return _open[key]


def byte_bpe(path: str, pattern: str):
    """A byte-level tiktoken encoding of a ranks file; one a worker process."""
    key = ("bytes", path)
    if key not in _open:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _open[key] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _open[key]
