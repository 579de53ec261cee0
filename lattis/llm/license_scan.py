"""License scans by patience alignment.

Words that occur once in the text and once in a template are anchors; the
longest increasing subsequence of their places is kept, and the gaps between
anchors are aligned in the same way. Coverage is the share of the template's
words that the alignment finds in one stretch of the text, one and a half
templates long. The words that tell a license from its neighbours must all be
found, with no other word between them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license notices, by identifier. Square brackets
#: stand around the words that tell a license from others.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the [GNU Affero General Public License, version 3].",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License] as published by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the [Apache License, Version 2.0].",
        'Licensed under the [Apache License, Version 2.0] (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. [Redistributions of source code] must retain the above copyright notice, this list of conditions and the following disclaimer. 2. [Redistributions in binary form] must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. [Redistributions of source code] must retain the above copyright notice, this list of conditions and the following disclaimer. 2. [Redistributions in binary form] must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. [Neither the name of] the copyright holder nor the names of its contributors may be used to [endorse or promote products] derived from this software without specific prior written permission.',
    ),
    "CC-BY-4.0": ("Licensed under [CC BY 4.0].", "This work is licensed under a [Creative Commons Attribution 4.0] International License."),
    "CC-BY-NC-4.0": ("Licensed under [CC BY-NC 4.0].", "This work is licensed under a [Creative Commons Attribution-NonCommercial 4.0] International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under [CC BY-NC-ND 4.0].", "This work is licensed under a [Creative Commons Attribution-NonCommercial-NoDerivatives 4.0] International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under [CC BY-NC-SA 4.0].", "This work is licensed under a [Creative Commons Attribution-NonCommercial-ShareAlike 4.0] International License."),
    "CC-BY-ND-4.0": ("Licensed under [CC BY-ND 4.0].", "This work is licensed under a [Creative Commons Attribution-NoDerivatives 4.0] International License."),
    "CC-BY-SA-4.0": ("Licensed under [CC BY-SA 4.0].", "This work is licensed under a [Creative Commons Attribution-ShareAlike 4.0] International License."),
    "CC0-1.0": ("Licensed under [CC0 1.0].", "This work is dedicated to the public domain under [CC0 1.0] Universal."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the [Eclipse Public License 2.0] which is available at https://www.eclipse.org/legal/epl-2.0",),
    "GPL-2.0": (
        "This work is licensed under the [GNU General Public License, version 2].",
        "This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation; either [version 2 of the License], or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the [GNU General Public License, version 3].",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice [appear in all copies].",),
    "LGPL-2.1": (
        "This work is licensed under the [GNU Lesser General Public License, version 2.1].",
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation; either [version 2.1 of the License], or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the [GNU Lesser General Public License, version 3].",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation, either [version 3 of the License], or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the [MIT License].",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, [sublicense, and/or sell copies] of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "MPL-2.0": (
        "Licensed under the [Mozilla Public License, version 2.0].",
        "This Source Code Form is subject to the terms of the [Mozilla Public] License, [v. 2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is [free and unencumbered software] released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
SCAN = "doc_id long, license string, coverage double, start_word long, stop_word long, n_licenses int"
_word = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased ASCII words; hyphens and dots join within a word."""
    return _word.findall((text or "").lower())


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(top_at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs ``(place in text, place in template)`` of equal words, increasing in both.

    Equal ends of a gap are matched first, then words unique to both sides;
    gaps without such a word match nothing more. Gaps wait in a list, so
    their number, not the depth of a call, bounds the work.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        own = Counter(template[c:d])
        seen: dict[str, int] = {}
        for i in range(a, b):
            w = text[i]
            if own.get(w) == 1:
                seen[w] = -1 if w in seen else i
        anchors = [(seen[template[j]], j) for j in range(c, d) if own[template[j]] == 1 and seen.get(template[j], -1) >= 0]
        if not anchors:
            continue
        kept = [anchors[k] for k in increasing([i for i, _ in anchors])]
        found += kept
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            if k > i + 1 and m > j + 1:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(found)


@dataclass
class Template:
    """A notice's words, the ranges of those that must be found together, and what licenses it contains."""

    license: str
    words: list[str]
    keys: list[tuple[int, int]]
    counts: Counter
    needs: frozenset[str]
    contains: frozenset[str] = frozenset()

    @staticmethod
    def read(license: str, text: str) -> Template:
        words: list[str] = []
        keys = []
        for k, part in enumerate(re.split(r"[\[\]]", text)):
            own = words_of(part)
            if k % 2 and own:
                keys.append((len(words), len(words) + len(own)))
            words += own
        return Template(license, words, keys, Counter(words), frozenset(w for a, b in keys for w in words[a:b]))

    @staticmethod
    def all_of(texts: dict[str, tuple[str, ...]], least: float = 0.8) -> list[Template]:
        found = [t for name, own in sorted(texts.items()) for t in (Template.read(name, x) for x in own) if t.words]
        for t in found:
            t.contains = frozenset(o.license for o in found if o.license != t.license and len(o.words) < len(t.words) and o.covered(t.words, least))
        return found

    def covered(self, text: Sequence[str], least: float) -> list[tuple[int, int]]:
        """The alignment with ``text``, or nothing if it covers too little or a key isn't found whole."""
        pairs = align(text, self.words)
        if len(pairs) < least * len(self.words) - 1e-9:
            return []
        at = {j: i for i, j in pairs}
        whole = all(j in at and at[j] == at.get(a, -1) + j - a for a, b in self.keys for j in range(a, b))
        return pairs if whole else []


def scan(words: list[str], templates: list[Template], least: float, margin: float = 0.5) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, start, stop)`` of the licenses found, best covered first (ties: by name, then place).

    A stretch of text, one and a half templates long, that begins with a
    word of the template is aligned to it, wherever enough of the template's
    words occur in the stretch for ``least`` of them to be covered; no
    stretch that could match is left out. A license has one place: the best
    that no better covered license takes. A match within that of a license
    that contains it (BSD-2-Clause in BSD-3-Clause) doesn't count.
    """
    here = set(words)
    counts: Counter | None = None
    matches: list[tuple[float, str, int, int, frozenset[str]]] = []
    for t in templates:
        if not t.needs <= here:
            continue
        if counts is None:
            counts = Counter(words)
            places: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
        n = len(t.words)
        need = least * n - 1e-9
        if sum(min(k, counts[w]) for w, k in t.counts.items()) < need:
            continue
        reach = n + max(2, int(margin * n))
        for a in _starts(words, sorted(i for w in t.counts for i in places.get(w, ())), t.counts, need, reach):
            pairs = t.covered(words[a : a + reach], least)
            if pairs:
                matches.append((-len(pairs) / n, t.license, a + pairs[0][0], a + pairs[-1][0] + 1, t.contains))
    found: dict[str, tuple[float, int, int]] = {}
    for coverage, name, a, b, _ in sorted({m for m in matches}, key=lambda m: m[:4]):
        if name in found or any(name in inner and a < d and c < b for _, _, c, d, inner in matches):
            continue
        if all(b <= c or a >= d for _, c, d in found.values()):
            found[name] = (-coverage, a, b)
    return [(name, *x) for name, x in found.items()]


def _starts(words: list[str], places: list[int], counts: Counter, need: float, reach: int) -> Iterator[int]:
    """Those of ``places`` from which ``reach`` words hold ``need`` or more of the template's, each as often as it has it."""
    held: Counter = Counter()
    met = stop = 0
    for a in places:
        while stop < len(places) and places[stop] < a + reach:
            w = words[places[stop]]
            met += held[w] < counts[w]
            held[w] += 1
            stop += 1
        if met >= need:
            yield a
        w = words[a]
        held[w] -= 1
        met -= held[w] < counts[w]


def scan_documents(docs: DataFrame, least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``SCAN`` for every row of ``docs``.

    ``license`` is the best covered one (ties: the first in order), with the
    words of the whole text that it spans, and ``n_licenses`` the number
    found. Texts without one, null and empty texts, give nulls and a
    coverage of 0. Repeated rows, and rows with a null id, are rows of their
    own; no rows give no rows; other columns aren't read.
    """
    read = Template.all_of(TEMPLATES if templates is None else templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCAN.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scan(words_of(text.as_py()), read, least)
                out.append((key, *(found[0] if found else (None, 0.0, None, None)), len(found)))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCAN)
