"""License scans: units of a text compared with licence templates by Dice's coefficient over word bigrams.

Texts are normalised (lower case, every run of other characters than letters and digits one space). Units are the
whole text, its paragraphs (blocks between blank lines) and its lines. A unit of n bigrams can reach the threshold t
against a template of m only if ``t / (2 - t) <= n / m <= (2 - t) / t``; that bound leaves few templates for a unit, and
none for most. One pass in Arrow batches, no shuffle; the templates are a fixed list.

Licences that span paragraphs or are a part of a line are found by windows of words: at least ``t / (2 - t) * m`` of a
template's bigrams must be in the text, which few texts meet. For those, windows from one shared bigram to another, up
to ``(2 - t) / t`` times as long as the template, are compared. Of windows that overlap the best one counts. Windows of
templates of more than 400 words start at every 200th part of the template at least, not at every word. Texts may say
another version next to a short notice, so its window must hold all of the template's terms with digits.

Defined results: null and empty texts match nothing. Texts of any length are compared whole, one at a time. Equal scores go to the template named first by code point.
Repeated rows get equal results. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import license_texts as full
from tidemark.llm.common import text_of
from tidemark.shipping import ship

# Public licence texts and the notices by which works name a licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""
_GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program; if not, write to the
Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
#: The same with the last sentence of newer headers.
_GPL_2_NEW = _GPL.replace("version 3", "version 2")
_LGPL = _GPL.replace("GNU General", "GNU Lesser General")
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [full.APACHE_2, _APACHE, "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "BSD-2-Clause": [full.BSD_2, "Released under the BSD 2-Clause License.", "Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": [full.BSD_3, "Released under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [full.CC0_1, "Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": [full.GPL_2, _GPL_2, _GPL_2_NEW, "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [full.GPL_3, _GPL, "This work is licensed under the GNU General Public License, version 3."],
    "ISC": [_ISC, "Released under the ISC License."],
    "LGPL-3.0": [full.LGPL_3, _LGPL, "This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [_MIT, "Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": [full.MPL_2, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
_TERM = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")

FOUND = "doc_id {}, n_units long, n_matches long, license string, dice double, licenses string"


def bigrams(text: str) -> set[tuple[str, str]]:
    terms = _TERM.findall(text.lower())
    return set(zip(terms, terms[1:]))


def _terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """The best template for a unit, by set Dice over bigrams, if it reaches the threshold."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        known = [(name, bigrams(t)) for name, texts in sorted(templates.items()) for t in texts]
        texts = [_terms(t) for _, ts in sorted(templates.items()) for t in ts]
        #: Name, bigrams, length in bigrams with repeats, and the terms that a window must hold.
        self.windowed = [(name, own, len(t) - 1, {x for x in t if len(t) <= 30 and any(c.isdigit() for c in x)}) for (name, own), t in zip(known, texts, strict=True) if own]
        self.having: dict[tuple[str, str], list[int]] = {}
        for k, (_, own, _, _) in enumerate(self.windowed):
            for b in own:
                self.having.setdefault(b, []).append(k)
        self.bigrams = frozenset(self.having)
        self.by_size: dict[int, list[tuple[str, set]]] = {}
        reach = (2 - threshold) / threshold
        for name, own in known:
            for n in range(int(len(own) / reach), int(len(own) * reach) + 2):
                if 2 * min(n, len(own)) >= threshold * (n + len(own)) - 1e-12:
                    self.by_size.setdefault(n, []).append((name, own))

    def best(self, unit: str) -> tuple[str, float] | None:
        own = bigrams(unit)
        if len(own) not in self.by_size:
            return None
        scored = [(dice(own, t), name) for name, t in self.by_size.get(len(own), ())]
        top = max((s for s, _ in scored), default=0.0)
        return (min(name for s, name in scored if s == top), top) if top >= self.threshold else None


    def windows(self, text: str) -> list[tuple[str, float]]:
        """(name, score) of the windows of words that reach the threshold, the best of those that overlap."""
        terms = _terms(text)
        sequence = list(zip(terms, terms[1:]))
        shared = Counter(k for b in self.bigrams.intersection(sequence) for k in self.having[b])
        found = []
        for k, n in shared.items():
            name, own, length, must = self.windowed[k]
            if n >= self.least(own):
                found += [(-score, first - last, name, first, last) for score, first, last in self._reaching(terms, sequence, own, length, must)]
        taken, out = bytearray(len(sequence)), []
        for score, _, name, first, last in sorted(found):
            if taken.find(1, first, last + 1) < 0:
                taken[first : last + 1] = b"\1" * (last + 1 - first)
                out.append((name, -score))
        return out

    def least(self, own: set) -> float:
        return self.threshold / (2 - self.threshold) * len(own) - 1e-9

    def _reaching(self, terms: list[str], sequence: list[tuple[str, str]], own: set, length: int, must: set) -> Iterator[tuple[float, int, int]]:
        """The best window of each start, if it reaches the threshold: score, first and last bigram."""
        hits = [i for i, b in enumerate(sequence) if b in own]
        reach, least, stride, after = int(length * (2 - self.threshold) / self.threshold) + 1, self.least(own), length // 200, -1
        for a, first in enumerate(hits):
            b = bisect_left(hits, first + reach)
            if b - a < least or first < after:
                continue
            after = first + stride
            seen: set = set()
            common, at, best = 0, first, (0.0, first)
            for last in hits[a:b]:
                # of the bigrams from at to last only the last one is in the template
                common += sequence[last] not in seen
                seen.update(sequence[at : last + 1])
                at = last + 1
                if (score := 2 * common / (len(seen) + len(own))) > best[0]:
                    best = score, last
            if best[0] >= self.threshold and must.issubset(terms[first : best[1] + 2]):
                yield best[0], first, best[1]


def units(text: str) -> list[str]:
    """The whole text, its paragraphs and its lines, without repeats and units that have no letter or digit."""
    return [u for u in dict.fromkeys([text, *_BLANK.split(text), *text.split("\n")]) if u and not u.isspace()]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """A row for each document, see FOUND: its best licence and all licences that some unit or window matches.

    n_matches counts units that match, and windows of licences that no unit matches.
    """
    ship(docs.sparkSession)
    known = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known, threshold)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                own = units(text)
                hits = [b for u in own if (b := matcher.best(u))]
                n_matches, wider = len(hits), matcher.windows(text)
                n_matches += sum(n not in {m for m, _ in hits} for n, _ in wider)
                hits += wider
                names = sorted({n for n, _ in hits})
                top = max((s for _, s in hits), default=None)
                out.append((doc, len(own), n_matches, min((n for n, s in hits if s == top), default=None), top, ",".join(names)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, FOUND.format(docs.schema["doc_id"].dataType.simpleString()))
