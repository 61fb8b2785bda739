"""License scans: patience alignment of license templates against texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from cairn.functions.ship import ship

WORD = re.compile(r"\w+(?:[.\-]\w+)*")

#: Wording of public licenses and notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "reserved-rights-line": "All rights reserved.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-2.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

RESULT = "array<struct<license:string, coverage:double, first_word:int, last_word:int, matched:int>>"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain that rises in both places; pairs come sorted by the first, all places distinct."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        tails[k : k + 1] = [y]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both lists, by patience alignment.

    Equal ends are matched first; between them, words that occur once in both lists anchor the alignment by their longest
    rising chain, and each gap is aligned the same way. A gap without such words stays unmatched. No recursion in depth:
    gaps wait on a stack.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        once = {w: y for y, w in enumerate(b[k:m], k) if cb[w] == 1 and ca.get(w) == 1}
        chain = _rising([(x, once[w]) for x, w in enumerate(a[i:j], i) if w in once])
        if not chain:
            continue
        out += chain
        for (x0, y0), (x1, y1) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class Scanner:
    """Templates ready for scanning; words are compared lower-cased."""

    def __init__(self, templates: Mapping[str, str], least: float = 0.8, stretch: float = 1.5):
        self.least, self.stretch = least, stretch
        self.templates = {k: [w.lower() for w in WORD.findall(v)] for k, v in sorted(templates.items())}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        alike = lambda a, b: (self.counts[a] & self.counts[b]).total() >= least * max(len(self.templates[a]), len(self.templates[b]))
        self.siblings = {(a, b) for a in self.templates for b in self.templates if a != b and alike(a, b)}
        self.vocabulary = {w for v in self.templates.values() for w in v}

    def _regions(self, words: list[str], counts: Counter, size: int) -> list[tuple[int, int]]:
        """Stretches of the text that could hold the template: each window of stretch x size words in them has enough of its words."""
        spots = [i for i, w in enumerate(words) if w in counts]
        need, reach = self.least * size, int(self.stretch * size)
        out: list[tuple[int, int]] = []
        lo, have = 0, Counter()
        total = 0
        for i in spots:
            w = words[i]
            have[w] += 1
            total += have[w] <= counts[w]
            while i - spots[lo] >= reach:
                v = words[spots[lo]]
                total -= have[v] <= counts[v]
                have[v] -= 1
                lo += 1
            if total >= need:
                if out and spots[lo] <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((spots[lo], i + 1))
        return out

    def _found(self, words: list[str], template: list[str], region: tuple[int, int]) -> list[tuple[float, int, int, int]]:
        """Matches in a region. Every place that can start one is aligned, so a match needs no particular first word.

        A start is skipped only if the words in its window are too few for a match in any order. Of the starts inside the
        first window that matches, that with the most matched words is taken; the search goes on behind it.
        """
        lo, hi = region
        out = []
        need, reach, counts = self.least * len(template), int(self.stretch * len(template)), Counter(template)
        best: list[tuple[int, int]] = []
        until = hi
        while lo < hi and (best or hi - lo >= need):
            if best and lo >= until:
                out.append((len(best) / len(template), best[0][0], best[-1][0], len(best)))
                lo, best, until = best[-1][0] + 1, [], hi
                continue
            window = words[lo : lo + reach] if lo + reach <= hi else words[lo:hi]
            if window and window[0] in counts and (counts & Counter(window)).total() >= max(need, len(best) + 1):
                pairs = [(lo + x, y) for x, y in align(window, template)]
                if len(pairs) >= need and len(pairs) > len(best):
                    until = until if best else pairs[0][0] + reach - int(need) + 1
                    best = pairs
                    if len(best) == len(template):
                        until = lo
            lo += 1
        if best:
            out.append((len(best) / len(template), best[0][0], best[-1][0], len(best)))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word, matched words) of each match, in text order.

        Of matches in one place by templates that differ in few words, only the best stays: these are variants of one text.
        """
        if not text:
            return []
        words = [w.lower() for w in WORD.findall(text)]
        there = self.vocabulary.intersection(words)
        out = []
        for name, template in self.templates.items():
            counts, size = self.counts[name], len(template)
            if sum(n for w, n in counts.items() if w in there) < self.least * size:
                continue  # bounds the coverage from above
            for region in self._regions(words, counts, size):
                out += [(name, c, first, last, n) for c, first, last, n in self._found(words, template, region)]
        better = lambda r, s: (s[0], r[0]) in self.siblings and s[2] <= r[3] and r[2] <= s[3] and (s[1], s[4]) > (r[1], r[4])
        return sorted((r for r in out if not any(better(r, s) for s in out)), key=lambda r: (r[2], r[3], r[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """doc_id, licenses (array of license, coverage, first_word, last_word, matched), top_license, top_coverage, n_licenses.

    Every document is scanned whole. A license is found where at least `least` of its template's words align within
    `stretch` times its length; of variants of one license in one place only the best counts. Null and empty texts and texts without a match: empty array, null top, coverage 0. top is
    the best coverage, then most words, then name. Repeated rows are alike; other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    scanner = Scanner(templates, least, stretch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [scanner.scan(t) for t in pdf["text"]]
            best = [min(f, key=lambda r: (-r[1], -r[4], r[0])) if f else None for f in found]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "licenses": [[dict(zip(("license", "coverage", "first_word", "last_word", "matched"), r, strict=True)) for r in f] for f in found],
                "top_license": [b[0] if b else None for b in best],
                "top_coverage": [b[1] if b else 0.0 for b in best],
                "n_licenses": [len(f) for f in found],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, licenses {RESULT}, top_license string, top_coverage double, n_licenses int")
