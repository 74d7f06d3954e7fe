"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into shingles of three words; of every window of neighbouring shingle hashes the
least is kept (winnowing), and the kept hashes form an inverted index to (template, position). All
shingles of a text are looked up in the index, so any run of ``SHINGLE + WINDOW - 1`` words that a
text shares with a template is found. Hits that lie on close diagonals mark a region if there are as many as the
least coverage leaves a template at least, and a banded
local alignment of template and region, word by word, gives the matched words and the span. A
template is reported where at least ``least_coverage`` of its words match in one span.

Defined results: null and blank texts match nothing; repeated rows are reported each; templates of
fewer words than a shingle are refused; spans of one template in one text do not overlap, the
better one stays and ties go to the earlier; an empty table gives no rows; long texts are scanned whole; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import each_batch
from tidelog.llm.tokens import SeedTable, flat, pieces, seed_hashes, word_hashes

SHINGLE, WINDOW, BAND = 3, 2, 8

#: Notices by which licenses are granted, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

WORD = regex.compile(r"[\p{L}\p{N}]+")
SPAN = ("matched", "start_word", "stop_word", "start_char", "stop_char")


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, the last of equals; all of a shorter list's least."""
    if len(hashes) <= window:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def align(template: tuple[int, ...], region: tuple[int, ...], shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, start, stop) of the best local alignment of ``template`` with ``region``.

    Template word i may meet region words i + shift - band to i + shift + band. A match scores 2,
    a substitution or a word left out on either side -1. Cells carry (score, matches, -start, stop).
    """
    width, nil = 2 * band + 1, (0, 0, 0, 0)
    best, above = nil, [nil] * (width + 1)
    for i, word in enumerate(template):
        row = [nil] * (width + 1)
        for k in range(width):
            j = i + shift + k - band
            if not 0 <= j < len(region):
                continue
            score, matched, start, _ = above[k] if above[k][0] > 0 else (0, 0, -j, j)
            step = (score + 2, matched + 1, start, j + 1) if region[j] == word else (score - 1, matched, start, j + 1)
            up, left = above[k + 1], row[k - 1] if k else nil
            cell = max(step, (up[0] - 1, *up[1:]), (left[0] - 1, left[1], left[2], j + 1))
            row[k] = cell if cell[0] > 0 else nil
            best = max(best, row[k])
        above = row
    return best[1], -best[2], best[3]


class Scanner:
    """The templates' inverted index and the search of texts in it."""

    def __init__(self, names: list[str], words: list[np.ndarray], least_coverage: float):
        if any(len(w) < SHINGLE for w in words):
            raise ValueError(f"a template has fewer than {SHINGLE} words")
        self.names, self.words, self.least = names, [tuple(w.tolist()) for w in words], least_coverage
        self.mask, self.memo = tuple(range(SHINGLE)), {}
        prints = [seed_hashes(w, self.mask) for w in words]
        kept = [winnow(p) for p in prints]
        self.index = SeedTable(np.concatenate([p[k] for p, k in zip(prints, kept, strict=True)]), np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept))

    def scan(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple]]:
        """Row to (template, coverage, spans of (matched, start word, stop word))."""
        keys = self._regions(hashes, offsets)
        found: dict[int, dict[int, list]] = {}
        done: tuple | None = None
        for r, t, diagonal in keys:
            if done and done[:2] == (r, t) and diagonal - done[2] <= BAND:
                continue  # the band around an earlier diagonal covers this one
            done = (r, t, diagonal)
            n = len(self.words[t])
            low, high = max(diagonal - BAND, 0), min(diagonal + n + 2 * BAND, int(offsets[r + 1] - offsets[r]))
            region = tuple(hashes[offsets[r] + low : offsets[r] + high].tolist())
            for matched, start, stop in self._all_aligned(t, region, diagonal - low + BAND // 2):
                found.setdefault(r, {}).setdefault(t, []).append((matched, low + start, low + stop))
        return {r: [(t, max(s)[0] / len(self.words[t]), _apart(s)) for t, s in sorted(by.items())] for r, by in found.items()}

    def _regions(self, hashes: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """(row, template, diagonal), sorted, of the hits with enough others of their template near their diagonal.

        Each of the words that differ spoils ``SHINGLE`` shingles and ends a run; of a run of L whole ones at
        least ``L // WINDOW`` are kept in the index.
        """
        found = [np.empty((4, 0), np.int64)]
        for where, text, at in self.index.hits(seed_hashes(hashes, self.mask)):
            row = np.searchsorted(offsets, where, "right") - 1
            inside = where + SHINGLE <= offsets[row + 1]
            part, n = np.unique(np.stack((row, text, where - at - offsets[row]))[:, inside], axis=1, return_counts=True)
            found.append(np.concatenate((part, n[None])))
        both = np.concatenate(found, axis=1)
        keys, which = np.unique(both[:3], axis=1, return_inverse=True)
        if not keys.shape[1]:
            return []
        n = np.bincount(which.ravel(), both[3]).astype(np.int64)
        reach = BAND + BAND // 2
        width = int(np.ptp(keys[2])) + 2 * reach + 2
        line = (keys[0] * len(self.names) + keys[1]) * width + keys[2] - keys[2].min()
        total = np.concatenate(([0], np.cumsum(n)))
        near = total[np.searchsorted(line, line + reach, "right")] - total[np.searchsorted(line, line - reach, "left")]
        size = np.array([len(w) for w in self.words])
        differ = np.floor((1 - self.least) * size + 1e-9)
        need = np.maximum(1, np.floor((size - SHINGLE + 1 - SHINGLE * differ - (WINDOW - 1) * (differ + 1)) / WINDOW))
        return keys[:, near >= need[keys[1]]].T.tolist()

    def _all_aligned(self, t: int, region: tuple[int, ...], shift: int) -> Iterator[tuple[int, int, int]]:
        """The best alignment, and those on both sides of it, as long as they reach the coverage."""
        least, todo = self.least * len(self.words[t]), [(0, len(region))]
        while todo:
            low, high = todo.pop()
            if high - low < least:
                continue
            matched, start, stop = self._aligned(t, region[low:high], shift - low)
            if matched and matched >= least:
                yield matched, low + start, low + stop
                todo += [(low, low + start), (low + stop, high)]

    def _aligned(self, t: int, region: tuple[int, ...], shift: int) -> tuple[int, int, int]:
        """The same notice stands in many texts: a bounded number of alignments is remembered."""
        key = (t, region, shift)
        if key not in self.memo:
            if len(self.memo) >= 4096:
                self.memo.clear()
            self.memo[key] = align(self.words[t], region, shift, BAND + BAND // 2)
        return self.memo[key]


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that do not overlap, better ones first in choice, in order of their place."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(set(spans), key=lambda s: (-s[0], s[1], s[2])):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def _with_chars(text: str, spans: list[tuple[int, int, int]], n_words: int) -> list[dict]:
    """Spans with character positions; null where Python and the JVM disagree about the text's words."""
    places = [m.span() for m in WORD.finditer(text)]
    known = len(places) == n_words
    return [{"matched": m, "start_word": a, "stop_word": b, "start_char": places[a][0] if known else None, "stop_char": places[b - 1][1] if known else None} for m, a, b in spans]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", least_coverage: float = 0.8) -> DataFrame:
    """``(id, license, coverage, spans)``, one row per text and license found in it."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", word_hashes(F.col("text")).alias("words")).collect()
    scanner = Scanner([r["name"] for r in known], [np.array(r["words"], np.int64).view(np.uint64) for r in known], least_coverage)
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in SPAN])))])
    span_type = pa.list_(pa.struct([(n, pa.int32()) for n in SPAN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            hashes, offsets = flat(b.column(2))
            for first, last in pieces(offsets):
                found = scanner.scan(hashes[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                rows = [(first + r, scanner.names[t], cover, _with_chars(b.column(1)[first + r].as_py(), spans, int(offsets[first + r + 1] - offsets[first + r]))) for r, by in found.items() for t, cover, spans in by]
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], span_type)], names=[id_col, "license", "coverage", "spans"])

    return docs.select(F.col(id_col), F.col(text), word_hashes(F.col(text)).alias("words")).mapInArrow(run, schema)
