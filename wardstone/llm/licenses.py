"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

The index holds the fingerprints of the templates only; its size is fixed by the list of templates, and it goes to the tasks with the function.
Documents are read once, whole, and never shuffled. Hits of a template whose diagonals (place in the text minus place in the template) span no more words than may be
added or missing, ``1 - least`` of the template, form a candidate region, those with the most places of the template first. A region is aligned with the template
inside a band of that width, whatever the text's length; one whose matched words reach the least coverage is reported, from the last place where such a match can start to the
first where it can end.

Defined cases: null and empty texts match nothing. A text that holds a license several times has one row for it with all spans, in order.
Repeated documents give repeated rows. Of matches that overlap, whatever their licenses, the best is reported. Positions are code points, end
exclusive. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, slices, small_batches
from .kernel import Words, shingles, words

#: Public license notices and the statements commonly used in their place.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def winnow(doc: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the hashes that are the smallest (the last of equals) of some run of window hashes of a row; all of a shorter row's smallest."""
    n = len(h)
    if n < window or window < 2:
        return np.arange(n)
    v = np.lib.stride_tricks.sliding_window_view(h, window)
    at = window - 1 - np.argmin(v[:, ::-1], axis=1) + np.arange(len(v))
    ok = doc[: len(v)] == doc[window - 1 :]
    counts = np.bincount(doc)
    short = np.flatnonzero(counts[doc] < window)
    return np.unique(np.concatenate([at[ok], short]))


def aligned(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """The longest in-order matching of template and text words on diagonals (text minus template position) low to high: pairs of positions."""
    m, n, width = len(template), len(text), high - low + 1
    best = np.zeros((m + 1, width + 2), np.int32)  # best[i, d]: matched among the first i template words and the first i + low + d - 1 text words
    for i in range(1, m + 1):
        at = np.arange(i - 1 + low, i + high)
        hit = np.zeros(width, np.int32)
        inside = (at >= 0) & (at < n)
        hit[inside] = text[at[inside]] == template[i - 1]
        row = np.maximum(best[i - 1, 1:-1] + hit, best[i - 1, 2:])
        best[i, 1:-1] = np.maximum.accumulate(row)
    pairs, i, d = [], m, width
    while i and d:
        if best[i, d - 1] == best[i, d]:
            d -= 1
        elif best[i - 1, d + 1] == best[i, d]:
            i, d = i - 1, d + 1
        else:
            pairs.append((i - 1, i - 1 + low + d - 1))
            i -= 1
    return pairs[::-1]


def tight(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(first word, last word, matched words) of the best matching: the first place where it can end, and for that the last where it can start."""
    pairs = aligned(template, text, low, high)
    if not pairs:
        return None
    end, turn = pairs[-1][1], pairs[-1][1] - len(template) + 1
    back = aligned(template[::-1], text[: end + 1][::-1], turn - high, turn - low)
    return end - back[-1][1], end, len(pairs)


class Templates:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, k: int = 3, window: int = 2, band: int = 4):
        self.names, self.k, self.window, self.band = [n for n, _ in templates], k, window, band
        w = words(pa.array([t for _, t in templates], pa.string()), full_lower=False)
        b = w.bounds()
        self.words = [w.h[x:y] for x, y in zip(b[:-1], b[1:])]
        doc, h = shingles(w, k)
        first = np.searchsorted(doc, np.arange(len(templates)))
        order = np.argsort(h, kind="stable")
        self.h, self.template, self.at = h[order], doc[order], (np.arange(len(h)) - first[doc])[order]
        self.aligned: dict[tuple, list] = {}

    def scan(self, w: Words, least: float) -> list[tuple[int, str, float, list[tuple[int, int, float]]]]:
        """(row, license, coverage, [(first word, last word, coverage)]) of a batch."""
        n = len(w.h) - self.k + 1
        if n <= 0 or not len(self.h):
            return []
        doc, h = shingles(w, self.k)
        where = np.flatnonzero(w.doc[:n] == w.doc[self.k - 1 :])
        chosen = winnow(doc, h, self.window)
        a, z = np.searchsorted(self.h, h[chosen]), np.searchsorted(self.h, h[chosen], "right")
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in np.flatnonzero(z > a):
            at = int(where[chosen[i]])
            for j in range(a[i], z[i]):
                hits.setdefault((int(doc[chosen[i]]), int(self.template[j])), []).append((at, at - int(self.at[j])))
        found: dict[int, list[tuple[int, int, float, int, str]]] = {}
        bounds = w.bounds() if hits else None
        for (row, t), own in hits.items():
            for low, high in self._regions(own, max(self.band, int(len(self.words[t]) * (1 - least)))):
                got = self._measure(w, t, low, high, int(bounds[row]), int(bounds[row + 1]), least)
                if got and got[2] >= least:
                    found.setdefault(row, []).append((*got, self.names[t]))
        out = []
        for row, spans in sorted(found.items()):
            by: dict[str, list] = {}
            for s in self._apart(spans):
                by.setdefault(s[4], []).append(s[:3])
            out += [(row, name, max(s[2] for s in own), own) for name, own in sorted(by.items())]
        return out

    def _regions(self, hits: list[tuple[int, int]], width: int):
        """(lowest, highest) diagonal of regions of hits (place, diagonal), at most width apart: of those that overlap, the one with most places of the template, then the next among the hits that are left."""
        while hits:
            hits = sorted(hits, key=lambda x: x[1])
            count: dict[int, int] = {}
            windows, z = [], 0
            for a in range(len(hits)):
                while z < len(hits) and hits[z][1] <= hits[a][1] + width:
                    place = hits[z][0] - hits[z][1]
                    count[place] = count.get(place, 0) + 1
                    z += 1
                if not a or hits[a][1] != hits[a - 1][1]:
                    windows.append((-len(count), hits[a][1], hits[z - 1][1]))
                place = hits[a][0] - hits[a][1]
                count[place] -= 1
                if not count[place]:
                    del count[place]
            lows: list[int] = []
            taken: list[tuple[int, int]] = []
            for _, low, high in sorted(windows):
                i = bisect.bisect(lows, high)
                if not i or taken[i - 1][1] < low:
                    lows.insert(i, low)
                    taken.insert(i, (low, high))
            yield from taken
            hits = [h for h in hits if not ((i := bisect.bisect(lows, h[1])) and taken[i - 1][1] >= h[1])]

    def _measure(self, w: Words, t: int, low: int, high: int, first: int, end: int, least: float):
        template = self.words[t]
        a, z = max(first, low - self.band), min(end, high + len(template) + self.band)
        text = w.h[a:z]
        key = (t, low - a, high - a, text.tobytes())
        if key not in self.aligned:
            if len(self.aligned) > 50_000:
                self.aligned.clear()
            some = np.isin(template, text).mean() >= least  # else no alignment can reach the coverage
            self.aligned[key] = tight(template, text, low - a - self.band, high - a + self.band) if some else None
        got = self.aligned[key]
        return (a + got[0], a + got[1], got[2] / len(template), got[2]) if got else None

    @staticmethod
    def _apart(spans):
        """Of spans that overlap, those with the most matched words times coverage: a long notice before the short one it begins with, the exact version before its neighbour."""
        starts: list[int] = []
        kept: list[tuple] = []
        for s in sorted(spans, key=lambda s: (-s[2] * s[3], s[0], s[1], s[4])):
            i = bisect.bisect(starts, s[1])
            if not i or kept[i - 1][1] < s[0]:
                starts.insert(i, s[0])
                kept.insert(i, s)
        return kept


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7) -> DataFrame:
    """doc_id, license, coverage (share of the best template's words matched in order), spans (start:end:coverage, comma-joined), n_spans."""
    small_batches(docs.sparkSession)
    index = Templates(templates)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                w = words(b.column("text"), full_lower=False)
                ids, rows = b.column("doc_id"), []
                for row, name, coverage, spans in index.scan(w, least):
                    a, z = int(w.offsets[row]), int(w.offsets[row + 1])
                    points = np.cumsum((w.data[a:z] & 0xC0) != 0x80)
                    place = lambda byte: int(points[byte - a - 1]) if byte > a else 0  # noqa: B023, E731
                    rows.append((row, name, coverage, ",".join(f"{place(int(w.start[x]))}:{place(int(w.end[y]))}:{c:.4f}" for x, y, c in spans), len(spans)))
                if rows:
                    at, names, coverages, spans, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(names), pa.array(coverages), pa.array(spans), pa.array(n, pa.int64())], ["doc_id", "license", "coverage", "spans", "n_spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, license string, coverage double, spans string, n_spans long")
