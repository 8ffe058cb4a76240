"""License scans by patience alignment.

A template is aligned with a text word by word: equal words at both ends match; of the rest, words that occur
exactly once on both sides are anchors, the longest increasing run of them is kept, and the gaps between
anchors are aligned the same way. The share of the template's words that are matched is its coverage.

A text can hold a template anywhere, several times, and a long text repeats its words; so the alignment runs
in windows. A passage that covers at least ``least`` of a template holds at least one of any set of template
words that makes up more than the rest; the words of such a set that are rarest in the text mark the
windows. No passage of that coverage is missed unless more foreign words than a quarter of the template
lie inside it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_encoder import by_size
from .common import texts

WORD = re.compile(r"[^\W_]+")

# One-line notices (-line), the headers that publishers give for source files (-header), and whole texts of
# short licenses, without title and copyright line. The long texts (Apache, GPL family, MPL, CC) are not templates.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Affero General Public License for more details.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU Lesser General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0-header": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
        rights to this software to the public domain worldwide. This software is distributed without any warranty. You
        should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
        http://creativecommons.org/publicdomain/zero/1.0/.""",
    "MIT-line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

#: What sets a template apart from its neighbours: each phrase must be matched as a whole, with no word between.
PHRASES = {
    "Apache-2.0-line": ("apache license version 2 0",),
    "Apache-2.0-header": ("apache license", "2 0"),
    "CC-BY-4.0-line": ("cc by 4 0",),
    "CC-BY-NC-4.0-line": ("cc by nc 4 0",),
    "CC-BY-ND-4.0-line": ("cc by nd 4 0",),
    "CC-BY-NC-ND-4.0-line": ("cc by nc nd 4 0",),
    "CC-BY-NC-SA-4.0-line": ("cc by nc sa 4 0",),
    "CC-BY-SA-4.0-line": ("cc by sa 4 0",),
    "GPL-3.0-line": ("gnu general public license version 3",),
    "GPL-3.0-header": ("gnu general public license as", "version 3 of"),
    "GPL-2.0-header": ("gnu general public license as", "version 2 of"),
    "AGPL-3.0-header": ("gnu affero general public license as", "version 3 of"),
    "LGPL-3.0-header": ("gnu lesser general public license as", "version 3 of"),
    "LGPL-2.1-header": ("gnu lesser general public license as", "version 2 1 of"),
    "MPL-2.0-header": ("mozilla public license", "2 0"),
    "BSD-3-Clause": ("promote products derived from",),
    "MIT-line": ("mit license",),
}
#: A template of fewer words must be matched whole: a share of it would let its only telling word go.
SHORT = 10


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending in the first) that ascends in the second: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[pile], piles[pile] = b, i
        before[i] = piles[pile - 1] if pile else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned places (template, text), ascending in both.

    Equal words are matched from a gap's ends inwards, but not from the outer ends of the text, which is wider
    than the passage -- unless it has no anchor at all.
    """
    out, todo = [], [(0, len(template), 0, len(text), False, False)]
    while todo:
        a, b, c, d, left, right = todo.pop()  # left, right: whether that end touches a match
        while left and a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while right and a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(template[a:b]), Counter(text[c:d])
        place = {w: c + i for i, w in enumerate(text[c:d]) if theirs[w] == 1}
        anchors = longest_increasing([(i, place[w]) for i, w in enumerate(template[a:b], a) if ours[w] == 1 and w in place])
        if not anchors and not left and not right:
            todo.append((a, b, c, d, True, True))
        for n, (i, j) in enumerate(anchors):
            out.append((i, j))
            todo.append((a, i, c, j, left or n > 0, True))
            a, c = i + 1, j + 1
        if anchors:
            todo.append((a, b, c, d, True, right))
    return sorted(out)


@dataclass(frozen=True)
class Match:
    matched: int
    first_word: int
    last_word: int
    passages: int = 1


def holds(template: list[str], pairs: list[tuple[int, int]], phrase: list[str]) -> bool:
    """Whether the alignment matches ``phrase``, at any of its places in the template, word next to word."""
    at, n = dict(pairs), len(phrase)
    return any(i in at and all(at.get(i + d) == at[i] + d for d in range(n))
               for i in range(len(template) - n + 1) if template[i:i + n] == phrase)


def passages(template: list[str], text: list[str], places: dict[str, list[int]], least: float,
             phrases: tuple[str, ...] = ()) -> list[Match]:
    """All passages of ``text`` that cover ``least`` of the template (all of a short one) and hold its ``phrases``; they may
    overlap. A passage is looked for in a window a quarter longer than the template on either side (four words at
    least), round each place of the template's rarest words. ``places``: where in the text each word lies."""
    size, count = len(template), Counter(template)
    need = (least if size >= SHORT else 1.0) * size - 1e-9
    cut = [words_of(x) for x in phrases]
    if any(w not in places for phrase in cut for w in phrase):
        return []
    if sum(min(n, len(places.get(w, ()))) for w, n in count.items()) < need:
        return []  # not even without regard to order
    marks, spare = [], 0
    for w in sorted(count, key=lambda w: (len(places.get(w, ())), w)):
        marks.append(w)
        spare += count[w]
        if spare > size - need:
            break
    slack = max(4, size // 4)
    found: dict[tuple[int, int], int] = {}
    for start in sorted({p - i for i, w in enumerate(template) if w in marks for p in places.get(w, ())}):
        if start >= 0 and text[start:start + size] == template:  # a whole one, whatever stands beside it
            found[start, start + size - 1] = size
            continue
        a = max(0, start - slack)
        part = text[a:start + size + slack]
        if sum((Counter(part) & count).values()) < need:
            continue
        pairs = patience(template, part)
        if len(pairs) >= need and all(holds(template, pairs, x) for x in cut):
            span = a + pairs[0][1], a + pairs[-1][1]
            found[span] = max(len(pairs), found.get(span, 0))
    return [Match(n, *span) for span, n in found.items()]


def apart(found: list[tuple[str, Match]], sizes: dict[str, int]) -> list[tuple[str, Match]]:
    """Of passages that overlap, the one with more words matched (then the larger share, the name, the first)."""
    out: list[tuple[str, Match]] = []
    starts: list[int] = []
    ends: list[int] = []  # of the passages taken, in order of their places
    for name, m in sorted(found, key=lambda x: (-x[1].matched, -x[1].matched / sizes[x[0]], x[0], x[1].first_word)):
        at = bisect_left(starts, m.first_word)
        if (at == 0 or ends[at - 1] < m.first_word) and (at == len(starts) or starts[at] > m.last_word):
            starts.insert(at, m.first_word)
            ends.insert(at, m.last_word)
            out.append((name, m))
    return out


def scan_text(text: str, templates: dict[str, list[str]], vocabulary: set[str], least: float,
              phrases: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, Match]]:
    """Each template's best passage of those that are left when overlaps are settled, and how many these are."""
    words = words_of(text)
    places: dict[str, list[int]] = {}
    if vocabulary.isdisjoint(words):
        return []
    for i, w in enumerate(words):
        if w in vocabulary:
            places.setdefault(w, []).append(i)
    phrases = PHRASES if phrases is None else phrases
    found = [(name, m) for name, t in templates.items() for m in passages(t, words, places, least, phrases.get(name, ()))]
    best: dict[str, Match] = {}
    for name, m in apart(found, {name: len(t) for name, t in templates.items()}):  # the best of each come first
        best[name] = replace(best[name], passages=best[name].passages + 1) if name in best else m
    return sorted(best.items())


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8,
                  id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row for each document and template that it holds with a coverage of at least ``least``: doc_id, license,
    coverage, matched_words, template_words, first_word, last_word (places of the best passage, from 0), passages (how
    many there are). Of passages that overlap, the one with more words matched counts, wherever others stand. Templates
    of fewer than ``SHORT`` words must be covered whole, and a template's ``phrases`` must be among the matched words
    (``PHRASES``, for the own templates; none, unless given, for a caller's).

    Null and empty texts hold nothing; a text is read whole, however long. Ties between passages go to the larger share
    of a template, then to the name, then to the first. Repeated rows repeat, null ids stay null; an empty table, or no
    template, gives no rows. Other columns are not read.
    """
    if phrases is None:
        phrases = PHRASES if templates is None else {}
    cut = {name: words_of(t) for name, t in sorted((TEMPLATES if templates is None else templates).items())}
    cut = {name: t for name, t in cut.items() if t}
    vocabulary = {w for t in cut.values() for w in t}

    def run(batches):
        for batch in by_size(batches):
            rows = [(doc_id, name, m.matched / len(cut[name]), m.matched, len(cut[name]), m.first_word, m.last_word, m.passages)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for name, m in scan_text(text, cut, vocabulary, least, phrases)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 5))],
                ["doc_id", "license", "coverage", "matched_words", "template_words", "first_word", "last_word", "passages"])
    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, coverage double, matched_words int, template_words int, first_word int, last_word int, "
             "passages int")
