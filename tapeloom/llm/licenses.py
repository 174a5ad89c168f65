"""Operator 8: license scans.

Method: MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

Templates are short notices, standard headers and full texts of well-known licenses, one for each version. For each template length (in words) all
windows of that length, one at every word, are signed with 16 minima of their five-word shingles (fewer words: one shingle), in 8 bands of 2; a text shorter than
a template is one window. A window matches if it contains at least 0.8 of the template's shingles. Windows that hold fewer known shingles
match nothing and are not signed (no match is lost by this). Two bags of equal size of which one contains 0.8 of the other have a Jaccard
similarity of 0.8 / 1.2 = 0.667, at which a window is retrieved with probability 1 - (1 - 0.444)**8 = 0.991; at containment 0.9 it is 0.9998, and 1 at 1. Of overlapping matches
the best is reported (most of its shingles, then the longest, then the first). The contents of all
windows of a text are counted together, in a time that grows with its known shingles and windows, not with their product.

(Texts of a family differ in a few words, so windows over one of them also match its kin; the best one tells the version.)

Cases: null and empty texts match nothing; repeated rows repeat their matches, rows that repeat a doc_id report each its own; a null doc_id is
kept; other columns are ignored; an empty table gives an empty result; texts of any length are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, map_texts, slices
from .license_texts import TEXTS
from .shingles import SIMILARITY, WORDS, WordHashes, mix, normal_words, shingle_hashes

ROWS, BANDS = 2, 8
#: Windows that are signed at once.
STARTS = 1 << 16
#: Matches that are held against those taken at once.
TRIED = 4096

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_APACHE_HEAD = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
#: (license, name in its headers, version, sign before "either"): the standard headers differ in these only.
_GNU = (
    ("GPL-1.0", "General Public License", "1", ";"), ("GPL-2.0", "General Public License", "2", ";"), ("LGPL-2.0", "Library General Public License", "2", ";"), ("LGPL-2.1", "Lesser General Public License", "2.1", ";"),
    ("LGPL-3.0", "Lesser General Public License", "3", ","), ("AGPL-3.0", "Affero General Public License", "3", ","),
)
_CC = (("CC-BY-SA", "Attribution-ShareAlike"), ("CC-BY-ND", "Attribution-NoDerivatives"), ("CC-BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))

#: License notices, headers and texts as their publishers state them, one for each version.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("Apache-2.0", _APACHE_HEAD + _APACHE),
    *((name, f"This work is licensed under the GNU {title}, version {version}.") for name, title, version, _ in _GNU if name != "GPL-2.0" and name != "LGPL-3.0"),
    *((name, f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation{mark} either version {version} of the License") for name, title, version, mark in _GNU),
    *((name, f"This library is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation{mark} either version {version} of the License") for name, title, version, mark in _GNU if name.startswith("LGPL")),
    *((f"{name}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License.") for name, title in _CC),
    *((f"{name}-4.0", f"Licensed under {name[:2]} {name[3:]} 4.0.") for name, _ in _CC if name in ("CC-BY-ND", "CC-BY-NC-SA", "CC-BY-NC-ND")),
    *((f"{name}-3.0", f"This work is licensed under a Creative Commons {title.replace('NoDerivatives', 'NoDerivs')} 3.0 Unported License.") for name, title in (("CC-BY", "Attribution"), *_CC)),
    *TEXTS,
)


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = SIMILARITY):
        self.threshold, self.templates, self.hashes = threshold, [], WordHashes()
        seeds = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64))
        self.factors = seeds | np.uint64(1)
        for name, text in templates:
            w = self.hashes.of(normal_words(text.encode()))
            if len(w):
                self.templates.append((name, len(w), min(WORDS, len(w)), np.unique(shingle_hashes(w))))
        #: By words of a shingle: the sorted shingles of its templates, and which leading bits they have.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {t[2] for t in self.templates}:
            known = np.unique(np.concatenate([t[3] for t in self.templates if t[2] == size]))
            seen = np.zeros(1 << 20, bool)
            seen[(known >> np.uint64(44)).astype(np.int64)] = True
            self.known[size] = known, seen
        #: By (words of a shingle, window's words): the known shingles without which a window matches none of those templates.
        self.least: dict[tuple[int, int], float] = {}
        for _, words, size, h in self.templates:
            self.least[size, words] = min(self.least.get((size, words), np.inf), threshold * len(h) - 1e-9)
        #: By (words of a shingle, window's words): sorted band keys of those templates, and the template of each.
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in {(t[2], t[1]) for t in self.templates}:
            own = [k for k, t in enumerate(self.templates) if (t[2], t[1]) == kind]
            keys = np.concatenate([self.bands(self.permuted(self.templates[k][3]).min(axis=1, keepdims=True))[:, 0] for k in own])
            of = np.repeat(own, BANDS)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.index[kind] = (keys[order], of[order], seen)
        #: By (words of a shingle, window's words): which of the known shingles those templates have.
        self.members = {kind: np.isin(self.known[kind[0]][0], np.concatenate([self.templates[k][3] for k in set(of.tolist())])) for kind, (_, of, _) in self.index.items()}

    def permuted(self, h: np.ndarray) -> np.ndarray:
        p = self.factors[:, None] * h
        return p ^ (p >> np.uint64(32))

    def bands(self, minima: np.ndarray) -> np.ndarray:
        keys = minima[0::ROWS].copy()
        for r in range(1, ROWS):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + minima[r::ROWS]
        keys += np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
        return keys * np.uint64(0xBF58476D1CE4E5B9)

    def retrieved(self, h: np.ndarray, places: np.ndarray, known: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(shingles of a window, template, first shingles) of the windows of ``h`` that share a band with a template. places: where h has known shingles,
        and which ones."""
        kinds = sorted(k[1] for k in self.index if k[0] == size)
        starts_of = {}
        for words in kinds:
            n = min(words - size + 1, len(h))  # shingles of the window; a shorter text is one window
            if len(places) < self.least[size, words]:
                continue
            own = places[self.members[size, words][known]]
            if len(own) >= self.least[size, words]:
                held = np.zeros(len(h) + 1, np.int32)
                held[own + 1] = 1
                held = np.cumsum(held, dtype=np.int32)
                starts_of[words, n] = np.flatnonzero(held[n:] - held[:-n] >= self.least[size, words])
        widest = max((n for _, n in starts_of), default=0)
        for a in range(0, len(h), STARTS):
            block = h[a : a + STARTS + widest]
            low, covers = None, 1
            for (words, n), all_starts in starts_of.items():
                starts = all_starts[np.searchsorted(all_starts, a) : np.searchsorted(all_starts, a + STARTS)] - a
                if not len(starts):
                    continue
                low = self.permuted(block) if low is None else low
                while covers < n:
                    step = min(covers, n - covers)
                    low = np.minimum(low[:, :-step], low[:, step:])
                    covers += step
                keys, of, seen = self.index[size, words]
                near = np.zeros((len(self.templates), len(starts)), bool)
                for band in self.bands(low[:, starts]):
                    at = np.flatnonzero(seen[(band >> np.uint64(48)).astype(np.int64)])
                    first, behind = (np.searchsorted(keys, band[at], side) for side in ("left", "right"))
                    while len(at):  # keys that several templates have follow one another
                        more = first < behind
                        at, first, behind = at[more], first[more], behind[more]
                        near[of[first], at] = True
                        first = first + 1
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    yield n, k, a + starts[near[k]]

    def shares(self, template: int, known: np.ndarray, h: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """The part of the template's shingles that windows of n shingles hold. known: places of all known shingles in h.

        A shingle at p, last seen before at q, is new to the windows that start behind q and reach p, so a window holds as many different ones as such spans begin
        up to its start, less those that end before it: all windows together take the time of two sorted lists.
        """
        own = self.templates[template][3]
        known = known[np.searchsorted(known, starts[0]) : np.searchsorted(known, starts[-1] + n)]
        at = np.searchsorted(own, h[known])
        inside = own[np.minimum(at, len(own) - 1)] == h[known]
        places, at = known[inside], at[inside]
        order = np.argsort(at, kind="stable")
        before = np.full(len(places), -1)
        again = np.flatnonzero(np.diff(at[order]) == 0) + 1
        before[order[again]] = places[order[again - 1]]
        begins = np.sort(np.maximum(before + 1, places - n + 1))
        return (np.searchsorted(begins, starts, "right") - np.searchsorted(places, starts, "left")) / len(own)

    def scan(self, data: bytes) -> list[tuple[str, int, int, float]]:
        """(license, first word, words, containment)."""
        w = self.hashes.of(normal_words(data))
        found: list[np.ndarray] = []  # share, words, start, template
        for size in sorted({k[0] for k in self.index}):
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            known, heads = self.known[size]
            places = np.flatnonzero(heads[(h >> np.uint64(44)).astype(np.int64)])
            places = places[known[np.minimum(np.searchsorted(known, h[places]), len(known) - 1)] == h[places]]
            if not len(places):
                continue
            numbers = np.searchsorted(known, h[places])
            for n, k, starts in self.retrieved(h, places, numbers, size):
                share = self.shares(k, places, h, n, starts)
                good = share >= self.threshold
                found.append(np.stack([share[good], np.full(good.sum(), n + size - 1.0), starts[good], np.full(good.sum(), float(k))]))
        if not found:
            return []
        share, words, start, k = np.concatenate(found, axis=1)
        order = np.lexsort((k, start, -words, -share))
        rows = np.stack([start, start + words, k])[:, order].astype(np.int64)
        firsts: list[int] = []  # of those taken, in order, with what they are
        taken: list[tuple[int, int, float]] = []
        for c in range(0, len(order), TRIED):
            # most overlap one that was taken before; the rest is tried one by one
            some, score = rows[:, c : c + TRIED], share[order[c : c + TRIED]]
            at = np.searchsorted(firsts, some[0], "right")
            ends, begins = np.array([-1, *(x[0] for x in taken)]), np.array([*firsts, np.iinfo(np.int64).max])
            free = (ends[at] <= some[0]) & (begins[at] >= some[1])
            for a, z, i, s in zip(*some[:, free].tolist(), score[free].tolist()):
                at = bisect_right(firsts, a)
                if (not at or taken[at - 1][0] <= a) and (at == len(firsts) or firsts[at] >= z):
                    firsts.insert(at, a)
                    taken.insert(at, (z, i, s))
        return [(self.templates[i][0], a, z - a, s) for a, (z, i, s) in zip(firsts, taken)]


@lru_cache(maxsize=1)
def standard_scanner(threshold: float) -> Scanner:
    """The scanner of all templates, made once for each Python worker."""
    return Scanner(TEMPLATES, threshold)


def license_matches(docs: DataFrame, templates=None, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment): every notice found; no shuffle."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold) if templates else standard_scanner(threshold)
        for batch in slices(batches):
            found = [(i, *m) for i, data in enumerate(bytes_of(batch)) for m in scanner.scan(data)]
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            rest = [pa.array([f[k + 1] for f in found], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "license", "first_word", "n_words", "containment"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, license string, first_word long, n_words long, containment double")
