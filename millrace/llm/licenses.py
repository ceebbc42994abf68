"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into word K-grams; of every W neighbouring K-gram hashes the
smallest (the rightmost of equals) is a fingerprint. A text looks up all its
K-grams, so any run of K + W - 1 = 4 words that it shares with a template is a
candidate; with COVERAGE 0.8 a template of 20 words or more keeps such a run
however its words are replaced or dropped. Shorter templates are not thinned
out (a run of 3 words does), and those of up to TINY words go by 2-grams.

Hits whose places in the template rise are one candidate, also across words
that were put in (at most as many as the template has). It is aligned within
BAND words of its diagonals, and again on either side of what was found.

The inverted index is broadcast: three arrays of at most MOST_WORDS entries.
More templates are scanned in parts of that size. A scan doesn't shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordhash import gram_hashes, text_hashes

K, W, BAND, COVERAGE = 3, 2, 6, 0.8
#: Words of templates that go by 2-grams, and of those that are not thinned out.
TINY, SHORT = 5, 19
#: Words of the templates in one index, at most; it then stays within some 20 MB.
MOST_WORDS = 500_000
# Public licence notices and texts, by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-short": "This project is licensed under the terms of the MIT license.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(r"\w+")


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the fingerprints among K-gram hashes."""
    if len(hashes) <= w:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, int)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], w)
    return np.unique(len(hashes) - 1 - (windows.argmin(axis=1) + np.arange(len(windows))))


def banded(template: np.ndarray, text: np.ndarray, low: int, high: int, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """Best local alignment whose diagonals (place in text less place in template) lie in low..high.

    Returns score, matched words, start and end (exclusive) in the text. Of
    equal scores the one with the most matched words counts.
    """
    unit = 1 << 24  # cells hold the score in these units, and the matched words below them
    match, mismatch, gap = match * unit + 1, mismatch * unit, gap * unit
    width = high - low + 1
    h = np.zeros((len(template) + 1, width + 1), dtype=np.int64)  # one column more, for what comes from above
    step = -gap * np.arange(width)
    for i, word in enumerate(template):
        at = i + low + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == word
        t = np.maximum(0, np.maximum(h[i, :width] + np.where(same, match, mismatch), h[i, 1:] + gap))
        t[~inside] = 0
        row = np.maximum.accumulate(t + step) - step
        row[~inside] = 0
        h[i + 1, :width] = row
    i, b = map(int, np.unravel_index(int(h.argmax()), h.shape))
    if not h[i, b]:
        return 0, 0, 0, 0
    (score, matched), end = divmod(int(h[i, b]), unit), int(i + low + b)
    start = end
    while i > 0 and h[i, b] > 0:
        at = i - 1 + low + b
        same = 0 <= at < len(text) and text[at] == template[i - 1]
        if h[i, b] == h[i - 1, b] + (match if same else mismatch):
            i, start = i - 1, at
        elif b + 1 <= width and h[i, b] == h[i - 1, b + 1] + gap:
            i, b = i - 1, b + 1
        else:
            b, start = b - 1, at
    return score, matched, int(start), end


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of the lower-cased text stand in the text itself."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    upto = np.cumsum([len(c.lower()) for c in text])  # a letter may become two
    at = lambda places: np.searchsorted(upto, np.array(places, dtype=np.int64), side="right")
    return list(zip(at([a for a, _ in spans]).tolist(), (at([b - 1 for _, b in spans]) + 1).tolist(), strict=True))


Find = tuple[int, int, int, str, float]  # score, first word, end word, template, coverage


def best_apart(found: Sequence[Find]) -> list[Find]:
    """Of overlapping finds the one with the best score, then the first, then the first name; in order of place."""
    starts: list[int] = []
    kept: list[Find] = []
    for f in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
        at = bisect_left(starts, f[1])
        if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
            starts.insert(at, f[1])
            kept.insert(at, f)
    return kept


class Index:
    """Fingerprints of the templates, in an inverted index by length of the gram."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(n for n, t in templates.items() if t and _WORD.search(t))
        self.words = text_hashes([templates[n] for n in self.names])
        rows: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        for n, words in enumerate(self.words):
            k = min(2 if len(words) <= TINY else K, len(words))
            grams = gram_hashes(words, k)
            places = winnow(grams, 1 if len(words) <= SHORT else W)
            rows[k].append((grams[places], n, places))
        self.tables = {}
        for k, some in rows.items():
            keys = np.concatenate([g for g, _, _ in some])
            order = np.argsort(keys, kind="stable")
            owner = np.concatenate([np.full(len(g), n, dtype=np.int32) for g, n, _ in some])
            place = np.concatenate([p for _, _, p in some]).astype(np.int32)
            self.tables[k] = keys[order], owner[order], place[order]

    def _hits(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: (place in the text, place in the template), sorted."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (keys, owner, place) in self.tables.items():
            if len(words) < k:
                continue
            grams = gram_hashes(words, k)
            first = np.searchsorted(keys, grams)
            for p in np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == grams).tolist():
                at = int(first[p])
                while at < len(keys) and keys[at] == grams[p]:
                    hits[int(owner[at])].append((p, int(place[at])))
                    at += 1
        for spots in hits.values():
            spots.sort()
        return hits

    def _candidates(self, spots: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
        """Hits of one copy: their places in the template rise, and lie at most its length apart in the text."""
        group: list[tuple[int, int]] = []
        at = 0
        while at < len(spots):
            p, last = spots[at][0], group[-1][1] if group else -1
            places = []
            while at < len(spots) and spots[at][0] == p:
                places.append(spots[at][1])
                at += 1
            ahead = min((x for x in places if x > last), default=None)
            if group and (ahead is None or p - group[-1][0] > size):
                yield group
                group, ahead = [], places[0]
            group.append((p, ahead if ahead is not None else places[0]))
        if group:
            yield group

    def _aligned(self, n: int, words: np.ndarray, group: list[tuple[int, int]], coverage: float) -> Iterator[Find]:
        own, size = self.words[n], len(self.words[n])
        diagonals = [p - place for p, place in group]
        parts = [(max(0, min(diagonals) - BAND), min(len(words), max(diagonals) + size + BAND))]
        while parts:
            low, high = parts.pop()
            some = [p - place for p, place in group if low <= p < high]
            if not some or high - low < coverage * size:
                continue
            score, matched, start, end = banded(own, words[low:high], min(some) - BAND - low, max(some) + BAND - low)
            if matched >= coverage * size:
                yield score, low + start, low + end, self.names[n], matched / size
                parts += [(low, low + start), (low + end, high)]

    def finds(self, words: np.ndarray, coverage: float = COVERAGE) -> list[Find]:
        found = [f for n, spots in self._hits(words).items() for group in self._candidates(spots, len(self.words[n])) for f in self._aligned(n, words, group, coverage)]
        return list(dict.fromkeys(found))

    def scan(self, text: str, coverage: float = COVERAGE, words: np.ndarray | None = None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) in code points; of overlapping finds the one with the best score.

        words: the text's word hashes, if they are known.
        """
        words = text_hashes([text])[0] if words is None else words
        found = best_apart(self.finds(words, coverage))
        spans = _word_spans(text) if found else []
        return [(name, share, spans[s][0], spans[e - 1][1]) for _, s, e, name, share in found]


def _parts(templates: Mapping[str, str], most: int) -> list[dict[str, str]]:
    """Templates in parts of at most ``most`` words (one that is longer is a part of its own)."""
    parts: list[dict[str, str]] = [{}]
    size = 0
    for name in sorted(templates):
        n = len(_WORD.findall(templates[name] or ""))
        if parts[-1] and size + n > most:
            parts.append({})
            size = 0
        parts[-1][name] = templates[name]
        size += n
    return parts


_FINDS = "doc_id long, text_hash long, score long, first long, upto long, license string, coverage double, start long, end long"


def license_spans(docs: DataFrame, templates: Mapping[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per find: doc_id, license, coverage, start, end (code points of the text, end exclusive).

    Every copy of a template counts, also of those that follow each other. Of
    overlapping finds the best score counts, then the first, then the first
    name. Null, empty and wordless texts give no rows; null ids are kept; texts
    of any length are scanned whole; repeated rows repeat theirs. Other columns
    are ignored, whatever their names; an empty table or no templates give an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def scanned(part: Mapping[str, str], alone: bool) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(Index(part))  # most_words words at most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(2).to_pylist()
                out = []
                for n, words in enumerate(text_hashes(texts)):
                    found = index.value.finds(words, coverage)
                    found = best_apart(found) if alone else found
                    spans = _word_spans(texts[n]) if found else []
                    out += [(batch.column(0)[n].as_py(), batch.column(1)[n].as_py(), f[0], f[1], f[2], f[3], f[4], spans[f[1]][0], spans[f[2] - 1][1]) for f in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in _FINDS.split(", ")])

        return rows.mapInArrow(scan, _FINDS)

    parts = _parts(templates, most_words)
    if len(parts) == 1:
        found = scanned(parts[0], True)
    else:
        found = scanned(parts[0], False)
        for part in parts[1:]:
            found = found.union(scanned(part, False))
        found = found.groupBy("doc_id", "text_hash").applyInArrow(_resolved, _FINDS)
    return found.select("doc_id", "license", "coverage", "start", "end")


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())


def _resolved(table: pa.Table) -> pa.Table:
    """The finds of one text from all parts; repeated rows bring theirs as often as they occur."""
    rows = [tuple(r.values()) for r in table.to_pylist()]
    times = Counter(rows)
    by_find = {r[2:7]: r for r in times}
    kept = [by_find[f] for f in best_apart(list(by_find)) for _ in range(times[by_find[f]])]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), _TYPES, strict=True)], names=table.column_names)
