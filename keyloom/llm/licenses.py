"""License scans (operator 4): a generalised suffix automaton of licence words.

The automaton of all templates is walked once with the words of a file. At
each word it gives the longest template passage that ends there (matching
statistics). Phrases are found through the suffix links of that state; long
passages are chained, in order in file and template, into spans, and a
template whose words are covered well enough gives its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Phrases that always count, with their labels (fixed values).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Templates: label and text, notices and whole licences, from the published texts (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
    IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
    ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
    "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
    OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
    use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
    liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
    restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
    software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
    software. 3. This notice may not be removed or altered from any source distribution."""),
]

#: Passages of fewer words are not chained, unless they are a whole template.
LONG = 4
#: Words that two passages of a chain may lie apart, in file and template.
GAP = 12
#: Covered share of a template's words from which its label is given.
COVER = 0.75
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

#: Upper-case to lower-case letters, and every other ASCII character that is no letter or digit to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[bytes]:
    """Words of a UTF-8 text, in turn: runs of a-z (after lower-casing A-Z), 0-9 and characters beyond ASCII."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(WORDS)
        found = piece.split()
        rest = found.pop() if found and not piece.endswith(b" ") else b""
        yield from found
    if rest:
        yield rest


@dataclass
class Automaton:
    """Suffix automaton of several word sequences.

    For each state: longest passage, suffix link, next states, and for each
    template that holds it the ends of all its places there, in order;
    ``ends`` lists the phrases that end wherever the state is reached.
    """

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    places: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    ends: list[tuple[tuple[int, int], ...]] = field(default_factory=list)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.places.append({})
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the passage of p and word, made apart where it shares a state with longer ones."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = new
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = new
            p = self.link[p]
        return new

    def add(self, last: int, word: int) -> int:
        """Extend the sequence that ends in state ``last``."""
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new


class Scanner:
    """Automaton of phrases and templates, and the scan of one text."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        self.labels = [*phrases.values(), *(k for k, _ in templates)]
        texts = [[*words(t.encode())] for t in [*phrases, *(t for _, t in templates)]]
        self.size = [len(t) for t in texts]
        self.base = len(phrases)
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts]
        m = self.machine = Automaton()
        for t in coded:
            last = 0
            for w in t:
                last = m.add(last, w)
        for k, t in enumerate(coded):
            at = 0
            for i, w in enumerate(t):
                at = s = m.step[at][w]
                while s > 0:
                    m.places[s].setdefault(k, []).append(i)
                    s = m.link[s]
        whole = {}
        for k in range(self.base):
            at = 0
            for w in coded[k]:
                at = m.step[at][w]
            whole.setdefault(at, []).append((k, self.size[k]))
        m.ends = [()] * len(m.length)
        for s in sorted(range(1, len(m.length)), key=m.length.__getitem__):
            m.ends[s] = (*whole.get(s, ()), *m.ends[m.link[s]])

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], dict[int, tuple[float, int, int]]]:
        """Number of words, phrase places (start, phrase), and for each covered template share, first and last word."""
        m = self.machine
        step, link, length, ends = m.step, m.link, m.length, m.ends
        hits: list[tuple[int, int]] = []
        passages: list[tuple[int, int, int]] = []
        state = size = 0
        i = -1
        for i, w in enumerate(map(self.vocabulary.get, words(text))):
            if w is None:
                if size:
                    passages.append((i, size, state))
                    state = size = 0
                continue
            if w not in step[state]:
                if size:
                    passages.append((i, size, state))
                while state and w not in step[state]:
                    state = link[state]
                    size = length[state]
            if w in step[state]:
                state = step[state][w]
                size += 1
                for k, n in ends[state]:
                    if size >= n:
                        hits.append((i - n + 1, k))
        if size:
            passages.append((i + 1, size, state))
        return i + 1, hits, self._chains(passages)

    def _chains(self, passages: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Best chain of long passages for each template that is covered well enough.

        A passage goes on the chain before it, in text and template, that
        covers most, from every one of its places in the template. Chains that
        ended over GAP words ago can't go on and are let go.
        """
        best: dict[int, tuple[float, int, int]] = {}
        live: dict[int, dict[int, tuple[int, int, int]]] = {}  # by template and end there: first word, end, words covered
        for end, size, state in passages:
            for k, places in self.machine.places[state].items():
                if k < self.base or size < min(LONG, self.size[k]):
                    continue
                start = end - size
                chains = live[k] = {at: c for at, c in live.get(k, {}).items() if start - c[1] <= GAP}
                new = {}
                for at in places:
                    own = at - size + 1
                    first, covered = start, size
                    for place, (began, _, so_far) in chains.items():
                        if place < at and own - place <= GAP and so_far + min(size, at - place) > covered:
                            first, covered = began, so_far + min(size, at - place)
                    new[at] = (first, end, covered)
                    share = min(1.0, covered / self.size[k])
                    if share >= COVER and share > best.get(k, (0.0,))[0]:
                        best[k] = (share, first, end - 1)
                chains |= {at: c for at, c in new.items() if at not in chains or c[2] >= chains[at][2]}
        return best


_scanners: dict[int, Scanner] = {}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text for phrases and licence notices.

    Returns one row for each input row: ``doc_id``, ``n_words``, ``n_base``
    (all places of phrases), ``first_word`` and ``last_word`` (least and
    largest start of such a place, else null), ``base_labels``, ``labels``
    (with those of covered templates; both distinct, sorted, joined by
    commas), ``score`` (1 with a phrase, else the largest covered share of a
    template, 0 without) and ``spans`` (label, first and last word, share).
    A null text counts as empty: no words, empty labels. Repeated rows give
    repeated results; other columns are not read.
    """
    phrases, templates = dict(phrases or PHRASES), list(templates or TEMPLATES)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        key = hash((tuple(phrases.items()), tuple(templates)))
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(phrases, templates)
        s = _scanners[key]
        for doc, text in it:
            n, hits, covered = s.scan(text)
            base = {s.labels[k] for _, k in hits}
            spans = [{"label": s.labels[k], "first": a, "last": b, "share": x} for k, (x, a, b) in sorted(covered.items(), key=lambda y: (y[1][1], y[0]))]
            starts = [a for a, _ in hits]
            yield doc, n, len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in spans})), 1.0 if hits else max((x["share"] for x in spans), default=0.0), spans

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"
    return map_rows(kept, rows, schema, arrow, binary=("text",))
