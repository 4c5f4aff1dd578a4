"""Operator 8: licence scans by the Dice coefficient over word bigrams.

Every run of words of a text, over ends of lines and blocks, is a window that is compared with the licence templates. The
Dice coefficient of two bigram sets of sizes a and b is at most 2 min(a, b) / (a + b), so a template is compared with
windows of those sizes alone that allow the threshold, and only where enough of its bigrams lie together. A window that
doesn't begin and end with a bigram of the template is never better than a shorter one, so it is left out. Of windows
that overlap, the one whose shared bigrams most outnumber the others stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import arrow_map, texts

THRESHOLD = 0.8

#: The disclaimers that end whole texts of these licences.
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Notices and grants of common public licences, as their texts state them; whole texts follow from these.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("proprietary", "All rights reserved."),
)
#: Licences whose whole text is their grant, the longest template of that name, and a disclaimer.
_ENDS = {"MIT": _MIT_END, "BSD-3-Clause": _BSD_END, "BSD-2-Clause": _BSD_END, "ISC": _ISC_END}
TEMPLATES += tuple((n, f"{max((t for m, t in TEMPLATES if m == n), key=len)} {end}") for n, end in _ENDS.items())

#: A reservation is the licence of a text only if no grant is found.
RESERVED = "proprietary"
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Bigrams of the normalised text: lower case, runs of letters or digits, with a start and an end mark."""
    words = ["", *_WORD.findall(text.lower()), ""]
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    """Templates by bigram, with the sizes that the threshold allows."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        self.sets = [bigrams(t) for _, t in templates]
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for i, s in enumerate(self.sets):
            for b in s:
                self.by_bigram.setdefault(b, []).append(i)
        sizes = [len(s) for s in self.sets]
        self.least = min(sizes) * threshold / (2 - threshold)
        self.most = max(sizes) * (2 - threshold) / threshold

    def best(self, unit: str) -> tuple[float, int] | None:
        """(Dice, template) of the best template at or over the threshold; ties go to the earlier template."""
        found = bigrams(unit)
        a = len(found)
        if not self.least <= a <= self.most:
            return None
        shared: Counter[int] = Counter()
        for b in found & self.by_bigram.keys():
            shared.update(self.by_bigram[b])
        top = max(((2 * n / (a + len(self.sets[i])), -i) for i, n in shared.items()), default=(0.0, 0))
        return (top[0], -top[1]) if top[0] >= self.threshold else None

    def windows(self, words: list[str], template: int, hits: list[int]) -> list[tuple[int, int, int, float, float]]:
        """(start, end, template, Dice, margin) of the best window from each start; ``hits`` are the places of the
        template's bigrams, that of the first word's mark being its own."""
        own, size = self.sets[template], len(self.sets[template])
        most, least = int(size * (2 - self.threshold) / self.threshold), size * self.threshold / (2 - self.threshold)
        out = []
        for i in hits:
            if bisect_left(hits, i + most) - bisect_left(hits, i) < least - 2:  # the marks may be the two others
                continue
            seen, shared, best = {("", words[i])}, int(("", words[i]) in own), None
            for j in range(i, min(len(words), i + most)):
                if j > i and (pair := (words[j - 1], words[j])) not in seen:
                    seen.add(pair)
                    shared += pair in own
                n = shared + ((words[j], "") in own)
                dice = 2 * n / (len(seen) + 1 + size)
                if dice >= self.threshold and (best is None or dice > best[3]):
                    best = (i, j + 1, template, dice, 3 * n - len(seen) - 1 - size)
            if best:
                out.append(best)
        return out

    def scan(self, text: str) -> list[tuple[int, int, int, float]]:
        """(first word, end, template, Dice) of matching windows that don't overlap."""
        words = _WORD.findall(text.lower())
        if not words:
            return []
        known = self.by_bigram
        shared: Counter[int] = Counter()
        for pair in set(zip(words, words[1:])) & known.keys():
            shared.update(known[pair])
        for i, s in enumerate(self.sets):
            if len(s) <= 3:  # a template of one or two words may match by its marks
                shared[i] += 2
        found = []
        for i, n in shared.items():
            own = self.sets[i]
            if n >= len(own) * self.threshold / (2 - self.threshold) - 2:
                hits = [k for k, pair in enumerate(zip(words, [*words[1:], ""])) if pair in own or ("", pair[0]) in own]
                found += self.windows(words, i, hits)
        chosen: list[tuple[int, int, int, float]] = []  # in order; they don't overlap, so only the neighbours can be in the way
        for start, end, i, dice, _ in sorted(found, key=lambda f: (-f[4], -f[3], f[0], f[2])):
            k = bisect_left(chosen, (start,))
            if (k == 0 or chosen[k - 1][1] <= start) and (k == len(chosen) or end <= chosen[k][0]):
                chosen.insert(k, (start, end, i, dice))
        return chosen


def scan_licences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each row of ``df``: doc_id, licence (of the best match, ties to the first, grants before reservations; null if none), dice,
    n_matches, licences (distinct, sorted).

    Whole texts; null, empty and wordless texts match nothing. Repeated rows give equal rows; an empty table none. Other
    columns, whatever their names, are left out; rows of a null id are scanned like any other. Of windows that overlap the
    one of the greatest margin stays; a long text costs its matches times their logarithm.
    """

    def make(part: pa.RecordBatch) -> dict:
        scanner = Scanner(templates, threshold)
        out: dict = {"licence": [], "dice": [], "n_matches": [], "licences": []}
        for text in part.column("text").to_pylist():
            found = scanner.scan(text)
            top = max(found, key=lambda f: (scanner.names[f[2]] != RESERVED, f[3], -f[0]), default=None)
            out["licence"].append(scanner.names[top[2]] if top else None)
            out["dice"].append(top[3] if top else 0.0)
            out["n_matches"].append(len(found))
            out["licences"].append(sorted({scanner.names[f[2]] for f in found}))
        return out | {"doc_id": part.column("doc_id")}

    return arrow_map(texts(df, id_col, text_col), make, "doc_id long, licence string, dice double, n_matches long, licences array<string>")
