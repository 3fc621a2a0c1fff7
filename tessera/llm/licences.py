"""Licence scan by patience alignment.

Template and text are word sequences (lower-cased A-Z, outer punctuation
stripped). A text is aligned only where it can reach the coverage asked for:
enough distinct template words in the document, and a stretch in which enough
words belong to the template. Alignment anchors on words unique to both sides,
takes the longest increasing run of them, and repeats in the gaps. What dense
stretches leave is aligned again by template words alone, whatever stands between
them; a template under PHRASE words is a phrase and only matches densely.

Defined results: null, empty and blank texts match nothing; a template found
several times gives a row each; a stretch that two templates cover counts for that
with more words aligned (an LGPL notice isn't a GPL notice); repeated rows match alike; very
long texts are scanned whole; ids are integers (null ids stay null); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import blocks, row_bounds, utf8, word_hashes, words

#: Share of a template's words that must be aligned, and words from which a template may be spread over a text.
COVERAGE, PHRASE = 0.8, 12

# Licence statements and notices, each with the words that must be among those aligned.
TEMPLATES: dict[str, tuple[str, str]] = {
    "MIT-statement": ("mit", "Released under the MIT License."),
    "Apache-2.0-statement": ("apache", "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0-statement": ("gnu", "This work is licensed under the GNU General Public License, version 3."),
    "BSD-3-Clause-statement": ("bsd", "Licensed under the BSD 3-Clause License."),
    "MPL-2.0-statement": ("mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY-4.0-statement": ("creative attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "MIT": (
        "merge sublicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    "ISC": (
        "purpose fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    "Apache-2.0": (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0-or-later": (
        "gnu general",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "BSD": (
        "redistributions binary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "CC-BY-4.0-short": ("cc by 4.0", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0-short": ("cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    "CC-BY-ND-4.0-short": ("cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-4.0-short": ("cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    "CC-BY-NC-SA-4.0-short": ("cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-NC-ND-4.0-short": ("cc by-nc-nd 4.0", "Licensed under CC BY-NC-ND 4.0."),
    "CC-BY-SA-4.0-statement": ("creative attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0-statement": ("creative attribution-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-4.0-statement": ("creative attribution-noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0-statement": ("creative attribution-noncommercial-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0-statement": ("creative attribution-noncommercial-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0-short": ("cc0", "Licensed under CC0 1.0."),
    "CC0-1.0-statement": (
        "cc0 waived",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "All-rights-reserved": ("all rights reserved", "All rights reserved."),
    "MIT-disclaimer": (
        "merchantability noninfringement dealings",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-disclaimer": (
        "merchantability exemplary consequential",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause-endorsement": (
        "neither endorse promote",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC-disclaimer": (
        "author disclaims tortious",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "0BSD": (
        "purpose fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "Zlib": (
        "misrepresented altered",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    "Unlicense": (
        "unencumbered domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "BSL-1.0": (
        "boost",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ),
    "PostgreSQL": (
        "fee paragraphs",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright "
        "notice and this paragraph and the following two paragraphs appear in all copies.",
    ),
    "WTFPL": ("verbatim changed", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    "GPL-2.0-or-later": (
        "gnu general 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL-2.1-or-later": (
        "gnu lesser 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
        "the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL-3.0-or-later": (
        "gnu lesser 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "AGPL-3.0-or-later": (
        "gnu affero",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "EPL-2.0": (
        "eclipse",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CDDL-1.0": (
        "common distribution",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    ),
    "NCSA": (
        "deal disclaimers",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    ),
    "OFL-1.1": (
        "sil font",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org",
    ),
    "LGPL-statement": ("lesser", "Licensed under the GNU Lesser General Public License."),
    "AGPL-statement": ("affero", "Licensed under the GNU Affero General Public License."),
    "Unlicense-statement": ("unlicense", "Released under the Unlicense."),
    "SPDX-tag": ("spdx-license-identifier", "SPDX-License-Identifier:"),
}

_OUTER = np.zeros(256, bool)
_OUTER[list(b".,;:!?\"'()[]{}<>*#-_/|")] = True


def bare_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word without its outer punctuation; words of punctuation alone are left out."""
    start, end, row = words(data, off)
    while True:
        cut = np.flatnonzero(_OUTER[data[np.minimum(start, len(data) - 1)]] & (start < end)) if len(start) else start
        if not len(cut):
            break
        start[cut] += 1
    while True:
        cut = np.flatnonzero((end > start) & _OUTER[data[end - 1]]) if len(start) else start
        if not len(cut):
            break
        end[cut] -= 1
    some = end > start
    start, end, row = start[some], end[some], row[some]
    return word_hashes(data, start, end), start, end, row


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(ends[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[p], ends[p] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list[int]] = {}
        for i in range(a0, a1):
            once.setdefault(a[i], []).append(i)
        there: dict[int, list[int]] = {}
        for j in range(b0, b1):
            if a and b[j] in once:
                there.setdefault(b[j], []).append(j)
        both = sorted((once[w][0], js[0]) for w, js in there.items() if len(js) == 1 and len(once[w]) == 1)
        anchors = [both[k] for k in _increasing([j for _, j in both])]
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


@dataclass(frozen=True)
class Catalogue:
    """Templates as places in one sorted vocabulary."""

    names: list[str]
    vocabulary: np.ndarray
    sequences: list[list[int]]
    member: np.ndarray
    must: list[set[int]]

    @staticmethod
    def of(templates: dict[str, tuple[str, str]]) -> Catalogue:
        def hashed(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode(), np.uint8)
            return bare_words(raw, np.array([0, len(raw)]))[0]

        found = {name: (hashed(key), hashed(text)) for name, (key, text) in templates.items()}
        vocabulary = np.unique(np.concatenate([t for _, t in found.values()]))
        place = lambda h: np.searchsorted(vocabulary, h)
        member = np.zeros((len(found), len(vocabulary)), bool)
        for k, (_, t) in enumerate(found.values()):
            member[k, place(t)] = True
        return Catalogue(list(found), vocabulary, [place(t).tolist() for _, t in found.values()], member, [set(place(m).tolist()) for m, _ in found.values()])


Find = tuple[int, int, int, int]


class Scan:
    """Looks for one template in one document's vocabulary places (-1: in no template)."""

    def __init__(self, catalogue: Catalogue, k: int, word: np.ndarray, coverage: float) -> None:
        self.k, self.word = k, word
        self.sequence, self.must = catalogue.sequences[k], catalogue.must[k]
        self.size, self.need = len(self.sequence), least_aligned(len(self.sequence), coverage)
        self.own = (word >= 0) & catalogue.member[k][word]
        self.often = np.bincount(self.sequence, minlength=len(catalogue.vocabulary))

    def aligned(self, places: np.ndarray) -> Find | None:
        """The alignment with the words at these places, if it covers enough."""
        pairs = patience(self.sequence, self.word[places].tolist())
        if len(pairs) < self.need or not self.must <= {self.sequence[i] for i, _ in pairs}:
            return None
        return self.k, int(places[pairs[0][1]]), int(places[pairs[-1][1]]), len(pairs)

    def dense(self) -> list[Find]:
        """Finds with few foreign words; of the starts inside a find the one that aligns most counts, the first among equals."""
        width = self.size + max(2, self.size // 4)
        inside = np.concatenate([[0], np.cumsum(self.own)])
        last = np.minimum(np.arange(len(self.word)) + width, len(self.word))
        out: list[Find] = []
        for s in np.flatnonzero((inside[last] - inside[:-1] >= self.need) & self.own).tolist():
            if not out or s > out[-1][2]:
                hit = self.aligned(np.arange(s, last[s]))
                if hit:
                    out.append(hit)
            elif out[-1][3] < self.size and s > out[-1][1] and (len(out) < 2 or s > out[-2][2]):
                hit = self.aligned(np.arange(s, last[s]))
                if hit and hit[3] > out[-1][3]:
                    out[-1] = hit
        return out

    def spread(self, lo: int, hi: int) -> list[Find]:
        """Finds among words [lo, hi) whatever stands between: template words around the rarest required one, ever farther out."""
        places = lo + np.flatnonzero(self.own[lo:hi])
        words = self.word[places]
        count = np.bincount(words, minlength=len(self.often))
        if np.minimum(count, self.often).sum() < self.need or any(not count[m] for m in self.must):
            return []
        centres = np.flatnonzero(words == min(self.must, key=lambda m: (count[m], m)))
        reach = 2 * self.size
        while True:
            tried = -reach
            for c in centres.tolist():
                if c - tried < reach // 2 and tried >= 0:
                    continue  # the window before holds most of this one
                tried = c
                hit = self.aligned(places[max(0, c - reach) : c + reach])
                if hit:
                    return [*self.spread(lo, hit[1]), hit, *self.spread(hit[2] + 1, hi)]
            if reach >= 2 * len(places):
                return []
            reach *= 4


def least_aligned(size: int, coverage: float) -> int:
    """Words of a template that must be aligned."""
    return -(-int(coverage * 1000) * size // 1000)


def find(catalogue: Catalogue, word: np.ndarray, coverage: float) -> list[Find]:
    """(template, first word, last word, words aligned) of every template in one document's vocabulary places (-1: in no template).

    Where finds of two templates share most of the shorter one, that with more words aligned counts.
    """
    have = np.zeros(catalogue.member.shape[1], bool)
    have[word[word >= 0]] = True
    found: list[Find] = []
    for k, own in enumerate(catalogue.member):
        size = len(catalogue.sequences[k])
        if (have & own).sum() < own.sum() - (size - least_aligned(size, coverage)):
            continue
        scan = Scan(catalogue, k, word, coverage)
        dense = scan.dense()
        found += dense
        if size >= PHRASE:
            gaps = zip([0, *(e + 1 for _, _, e, _ in dense)], [*(s for _, s, _, _ in dense), len(word)], strict=True)
            found += [hit for lo, hi in gaps if lo < hi for hit in scan.spread(lo, hi)]
    kept: list[Find] = []
    for k, s, e, n in sorted(found, key=lambda f: (-f[3], -f[3] / len(catalogue.sequences[f[0]]), f)):
        if all(2 * (min(e, f) - max(s, t) + 1) <= min(e - s, f - t) + 1 for _, t, f, _ in kept):
            kept.append((k, s, e, n))
    return sorted(kept)


def licence_regions(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, licence, start, end (characters), words_aligned, template_words, span_words (from the first to the last aligned), coverage of every licence found."""
    catalogue = Catalogue.of(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, off = utf8(b.column("text"))
            h, start, end, row = bare_words(data, off)
            at = np.minimum(np.searchsorted(catalogue.vocabulary, h), len(catalogue.vocabulary) - 1)
            place = np.where(catalogue.vocabulary[at] == h, at, -1)
            bounds = row_bounds(row, b.num_rows)
            # Documents short of every template's distinct words are passed over together.
            hit = place >= 0
            seen = np.zeros((b.num_rows, len(catalogue.vocabulary)), np.float32)
            seen[row[hit], place[hit]] = 1
            least = np.array([m.sum() - (len(s) - least_aligned(len(s), coverage)) for m, s in zip(catalogue.member, catalogue.sequences, strict=True)])
            able = (seen @ catalogue.member.T.astype(np.float32) >= least).any(axis=1)
            out = [(r, k, int(start[bounds[r] + i]), int(end[bounds[r] + j]), n, j - i + 1) for r in np.flatnonzero(able).tolist() for k, i, j, n in find(catalogue, place[bounds[r] : bounds[r + 1]], coverage)]
            if out:
                r, k, s, e, n, w = (np.array(x) for x in zip(*out, strict=True))
                runes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                size = np.array([len(x) for x in catalogue.sequences])[k]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").take(pa.array(r)), "licence": [catalogue.names[i] for i in k.tolist()], "start": runes[s] - runes[off[r]], "end": runes[e] - runes[off[r]],
                    "words_aligned": n.astype(np.int32), "template_words": size.astype(np.int32), "span_words": w.astype(np.int32), "coverage": np.round(n / size, 6),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licence string, start long, end long, words_aligned int, template_words int, span_words int, coverage double")
