"""License texts in documents: winnowed fingerprints (Schleimer et al., 2003) find candidates, banded alignment confirms."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import ship
from corpuslake.llm._words import pieces, roll
from corpuslake.llm.decontaminate import trimmed_words

#: Public license notices, by SPDX-like name.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}

_OUT = "doc_id long, license string, matched_words int, template_words int, coverage double, start_byte long, end_byte long"


@dataclass(frozen=True)
class Config:
    """k: words in a fingerprint; window: fingerprints of which the least is kept, so any shared run of
    k + window - 1 words shares one; band: how far an alignment may leave its diagonal; coverage: the least
    share of a template's words that must match, in order."""

    k: int = 3
    window: int = 2
    band: int = 12
    coverage: float = 0.85


def winnow(hashes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window of successive fingerprints of a text; texts with fewer keep their least."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][of]
    best = np.arange(len(hashes))
    for i in range(1, window):
        nxt = np.minimum(np.arange(len(hashes)) + i, end - 1)
        best = np.where(hashes[nxt] < hashes[best], nxt, best)
    whole = np.arange(len(hashes)) + window <= end
    whole[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.unique(best[whole])


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order inside the band about text place = template place + diagonal; first and stop word matched.

    Row i holds the best chain over template[:i]; only 2 * band + 1 columns of it exist. Among equal counts the leftmost chain wins.
    """
    width = 2 * band + 1
    low = -(1 << 40)
    # score: matches; start, stop: first and last matched word of the chain
    score = np.zeros(width, np.int64)
    start = np.full(width, -1, np.int64)
    stop = np.full(width, -1, np.int64)
    n = len(text)
    for i, w in enumerate(template):
        at = i + diagonal - band + np.arange(width)
        ok = (at >= 0) & (at < n)
        same = np.zeros(width, bool)
        same[ok] = text[at[ok]] == w
        # column c of the next row is one place to the right, so skipping a template word shifts by one
        skip_s, skip_a, skip_z = np.append(score[1:], low), np.append(start[1:], -1), np.append(stop[1:], -1)
        take = np.where(same, score + 1, low)
        better = take > skip_s
        new_s = np.where(better, take, skip_s)
        new_a = np.where(better, np.where(start >= 0, start, at), skip_a)
        new_z = np.where(better, at, skip_z)
        # skipping text words: the best of the columns to the left
        top = np.maximum.accumulate(new_s)
        src = np.maximum.accumulate(np.where(new_s == top, np.arange(width), 0))
        score, start, stop = top, new_a[src], new_z[src]
    best = int(score.argmax())
    return int(score[best]), int(start[best]), int(stop[best]) + 1


class Templates:
    def __init__(self, templates: dict[str, str], cfg: Config):
        self.cfg, self.names = cfg, list(templates)
        w = trimmed_words(pa.array(list(templates.values()), pa.large_string()))
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in range(len(self.names))]
        prints, offsets = roll(w.hashes, w.first, cfg.k)
        of = np.repeat(np.arange(len(self.names)), np.diff(offsets))
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in winnow(prints, offsets, cfg.window):
            index[int(prints[p])].append((int(of[p]), int(p - offsets[of[p]])))
        self.index = dict(index)
        self.bitmap = np.zeros(1 << 20, bool)
        for h in self.index:
            self.bitmap[h >> 44] = True

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(text, license, matched, template words, start byte, end byte), non-overlapping for one license."""
        cfg = self.cfg
        w = trimmed_words(column)
        prints, offsets = roll(w.hashes, w.first, cfg.k)
        place = winnow(prints, offsets, cfg.window)
        place = place[self.bitmap[(prints[place] >> np.uint64(44)).astype(np.int64)]]
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        of = np.searchsorted(offsets, place, "right") - 1
        for p, t in zip(place, of, strict=True):
            for name, q in self.index.get(int(prints[p]), ()):
                hits[int(t), name].append(int(p - offsets[t]) - q)
        for (t, name), diagonals in sorted(hits.items()):
            text, template = w.hashes[w.first[t] : w.first[t + 1]], self.words[name]
            done = -1
            # no wider than half the template, so that copies side by side are in different clusters
            band = min(cfg.band, max(1, len(template) // 2))
            for d in _clusters(sorted(diagonals), band):
                if d + len(template) <= done:
                    continue
                matched, a, z = align(template, text, d, band)
                if matched >= cfg.coverage * len(template) and a >= done:
                    done = z
                    base = w.first[t]
                    yield t, self.names[name], matched, len(template), int(w.starts[base + a] - w.breaks[t]), int(w.ends[base + z - 1] - w.breaks[t])


def _clusters(diagonals: list[int], band: int) -> list[int]:
    """One diagonal for each group that a band about it covers."""
    out, at = [], 0
    while at < len(diagonals):
        end = at
        while end < len(diagonals) and diagonals[end] - diagonals[at] <= band:
            end += 1
        out.append((diagonals[at] + diagonals[end - 1]) // 2)
        at = end
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, cfg: Config = Config()) -> DataFrame:
    """A row for each place where a document holds a template: matched words, coverage and span in UTF-8 bytes.

    The templates are part of the program, so their index is bounded. Texts are compared by lower-cased words
    without punctuation at the edges. Null and empty texts have no rows; a license that occurs twice has two
    rows; repeated documents are each reported; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    ship(docs.sparkSession)
    known = Templates(templates or TEMPLATES, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids = part.column("doc_id")
                found = [(ids[t].as_py(), name, m, n, m / n, a, z) for t, name, m, n, a, z in known.scan(part.column("text"))]
                if found:
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
