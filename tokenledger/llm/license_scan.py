"""License scan: patience alignment of license texts with whole documents.

For each template, spans of a document that may hold one copy of it are found
by one pass over the word codes; each span is then aligned with the template by
patience: words unique to both sides anchor the alignment, the longest
increasing subsequence of the anchors is kept, equal words next to the anchors
extend them, and the gaps between are aligned recursively.  Coverage is the
share of the template's words that are aligned; matches of at least ``least``
coverage with the template's name and version words (``NAMES``) in one piece
are reported.  Where they overlap the one with the most aligned words,
less half the other words in its span, comes first, and what it leaves of the
other spans is aligned again.

Cases: words are runs of letters and digits, A-Z lower-cased; a null, empty or
wordless text has no matches; every match in a text is reported, repeated
notices too; repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from dataclasses import dataclass, field
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tokenledger.llm import arrow_text as at

#: fixed values: notices of licenses and sentences as authors write them, by SPDX id (with a variant name); the whole
#: texts are in the folder licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause:conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    "ISC:permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT:permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0:notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
BSD_CONDITIONS = TEMPLATES["BSD-2-Clause:conditions"]
BSD_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission.")
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES |= {
    "BSD-2-Clause:text": f"{BSD_CONDITIONS} {BSD_DISCLAIMER}",
    "BSD-3-Clause:conditions": f"{BSD_CONDITIONS} {BSD_THIRD}",
    "BSD-3-Clause:text": f"{BSD_CONDITIONS} {BSD_THIRD} {BSD_DISCLAIMER}",
    "ISC:text": TEMPLATES["ISC:permission"] + " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    "MIT:text": TEMPLATES["MIT:permission"] + " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: phrases of a template that a match has, word behind word: its name and version, and what its siblings lack
NAMES = {
    "Apache-2.0": ["apache license version 2 0"], "Apache-2.0:notice": ["apache license version 2 0"],
    "BSD-3-Clause:conditions": ["neither the name"], "BSD-3-Clause:text": ["neither the name"],
    "CC0-1.0": ["waived all copyright"], "ISC:permission": ["provided that the above"], "ISC:text": ["provided that the above"],
    "MIT": ["mit license"], "MPL-2.0:notice": ["mozilla public license v 2 0"],
    "Apache-2.0:text": ["apache license version 2 0 january 2004"], "Artistic-1.0:text": ["the artistic license"],
    "CC0-1.0:text": ["cc0 1 0 universal"], "GPL-1.0:text": ["gnu general public license version 1 february 1989"],
    "GPL-2.0:text": ["gnu general public license version 2 june 1991"],
    "GPL-3.0:text": ["gnu general public license version 3 29 june 2007"],
    "LGPL-2.0:text": ["gnu library general public license version 2 june 1991"],
    "LGPL-2.1:text": ["gnu lesser general public license version 2 1 february 1999"],
    "LGPL-3.0:text": ["gnu lesser general public license version 3 29 june 2007"],
    "MPL-1.1:text": ["mozilla public license version 1 1"], "MPL-2.0:text": ["mozilla public license version 2 0"],
    "Unlicense:text": ["free and unencumbered software"],
}
for _id, _name, _version in [("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"),
                             ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]:
    _phrases = [f"gnu {_name}general public license".lower(), f"version {_version}".replace(".", " ")]
    TEMPLATES[_id] = f"This work is licensed under the GNU {_name}General Public License, version {_version}."
    TEMPLATES[f"{_id}:notice"] = (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name}General Public "
        f"License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later "
        "version.")
    NAMES[_id] = NAMES[f"{_id}:notice"] = _phrases
for _version in ("1.0", "2.0"):
    TEMPLATES[f"EPL-{_version}:notice"] = ("This program and the accompanying materials are made available under the terms of the Eclipse "
                                           f"Public License v{_version}")
    TEMPLATES[f"EPL-{_version}:notice v."] = TEMPLATES[f"EPL-{_version}:notice"].replace(f"v{_version}", _version)
    NAMES[f"EPL-{_version}:notice"] = [f"eclipse public license v{_version}".replace(".", " ")]
    NAMES[f"EPL-{_version}:notice v."] = [f"eclipse public license {_version}".replace(".", " ")]
for _parts, _title in {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
                       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
                       "BY-SA": "Attribution-ShareAlike"}.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _id = f"CC-{_parts}-{_version}"
        TEMPLATES[_id] = f"Licensed under CC {_parts} {_version}."
        TEMPLATES[f"{_id}:name"] = f"licensed under a Creative Commons {_title} {_version} License"
        for _key, _phrase in ((_id, f"cc {_parts} {_version}"), (f"{_id}:name", f"Creative Commons {_title} {_version}")):
            NAMES[_key] = [_phrase.lower().replace("-", " ").replace(".", " ")]


def whole_texts() -> dict[str, str]:
    """The whole license texts, by SPDX id."""
    folder = resources.files("tokenledger.llm") / "licenses"
    return {f"{f.name[:-4]}:text": f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name)}


#: words too common in prose to find a window by
COMMON = frozenset("a all an and any are as at be by can for from if in is it not of on one or that the this to under was with you "
                   "your 0 2 3 4".split())

SHORT = 16  # words of a template whose every word tells its place


@dataclass
class Template:
    name: str
    words: np.ndarray       # codes
    telling: frozenset      # codes of its telling words
    names: list             # phrases that a match has: the places of each in the template
    place: np.ndarray = field(init=False)  # by code: its place if it occurs once; -1 if never or repeated

    def __post_init__(self) -> None:
        size = int(self.words.max(initial=0)) + 1
        count = np.bincount(self.words, minlength=size)
        self.place = np.full(size, -1)
        self.place[self.words] = np.arange(len(self.words))
        if (count == 1).any():
            self.place[count > 1] = -1

    def need(self, least: float) -> int:
        """Kinds of telling words that any match has."""
        return max(1, len(self.telling) - int((1 - least) * len(self.words) + 1e-9))

    def place_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < len(self.place), self.place[np.minimum(codes, len(self.place) - 1)], -1)

    def places_of_phrase(self, codes: np.ndarray, start: int, n: int) -> np.ndarray:
        """Where the ``n`` words from ``start`` on stand behind one another in the text."""
        p = np.flatnonzero(codes[:max(0, len(codes) - n + 1)] == self.words[start])
        for k in range(1, n):
            p = p[codes[p + k] == self.words[start + k]]
        return p

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether every phrase is aligned, its words behind one another."""
        at_ = {j: i for i, j in pairs}
        return all(any(p in at_ and all(at_.get(p + k) == at_[p] + k for k in range(1, n)) for p in starts)
                   for starts, n in self.names)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        return np.isin(codes, self.words)


class Templates:
    def __init__(self, texts: dict[str, str]) -> None:
        offsets, values = at.words(at.texts_of(pa.array(list(texts.values()))), at.LOWER_ALNUM)
        coded = values.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64) + 1
        code = {w: k + 1 for k, w in enumerate(coded.dictionary.to_pylist())}
        plain = {code[w] for w in COMMON if w in code}
        self.all = []
        self.counts = np.zeros((len(texts), len(code) + 1), np.int32)
        for k, name in enumerate(texts):
            own = codes[offsets[k]:offsets[k + 1]]
            self.counts[k] = np.bincount(own, minlength=len(code) + 1)
            names = []
            for phrase in NAMES.get(name, ()):
                p = [code.get(w, 0) for w in phrase.split()]
                starts = [s for s in range(len(own) - len(p) + 1) if own[s:s + len(p)].tolist() == p]
                if not starts:
                    raise ValueError(f"{name} has no {phrase!r}")
                names.append((starts, len(p)))
            self.all.append(Template(name, own, frozenset(set(own.tolist()) - plain) or frozenset(own.tolist()), names))
        self.lengths = self.counts.sum(axis=1)

    def possible(self, codes: np.ndarray, least: float) -> list[int]:
        """Templates of which the text has enough words, each as often."""
        kinds, n = np.unique(codes[codes > 0], return_counts=True)
        return np.flatnonzero(np.minimum(self.counts[:, kinds], n).sum(axis=1) >= np.maximum(least * self.lengths - 1e-9, 1)).tolist()


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: increasing (text place, template place) pairs."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # equal ends of the gap
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            out.append((a1 - 1, b1 - 1))
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        anchors = longest_increasing(unique_to_both(text[a0:a1], template[b0:b1]))
        if not anchors:
            continue
        at_a, at_b = a0, b0
        for i, j in anchors:
            out.append((a0 + i, b0 + j))
            todo.append((at_a, a0 + i, at_b, b0 + j))
            at_a, at_b = a0 + i + 1, b0 + j + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def unique_to_both(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(place in a, place in b) of words that occur once in each, by a."""
    def once(x):
        seen: dict[int, int] = {}
        for k, w in enumerate(x):
            seen[w] = -1 if w in seen else k
        return seen
    there = once(b)
    return [(k, there[w]) for w, k in once(a).items() if k >= 0 and w and there.get(w, -1) >= 0]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increase on both sides (patience sorting)."""
    pairs = sorted(pairs)
    tops, piles, back = [], [], {}
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p:p + 1] = [j]
        piles[p:p + 1] = [k]
        back[k] = piles[p - 1] if p else None
    out, k = [], piles[-1] if piles else None
    while k is not None:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def spans(codes: np.ndarray, telling: np.ndarray, t: Template, least: float) -> list[tuple[int, int]]:
    """Spans of words, at most twice the template's length, that may hold one copy.

    Each word of the template tells where the copy around it begins.  A copy's first words tell its first place and,
    as words put in or left out move the places told, its last words its end; so every pair of told places gives a
    span.  In templates of over SHORT words only words that occur once tell (with an eighth of the length before and
    behind), and in those of over 64 words near places are taken as one."""
    m = len(t.words)
    need, lacking = t.need(least), int((1 - least) * m + 1e-9)
    phrases = [(t.places_of_phrase(codes, starts[0], n), n) for starts, n in t.names]
    if len(telling) < need or any(not len(p) for p, _ in phrases):
        return []
    near = np.flatnonzero(telling[need - 1:] - telling[:len(telling) - need + 1] < 2 * m)
    if not len(near):
        return []
    # the runs of words around them, and the places told there
    low, high = telling[near] - 2 * m, telling[near + need - 1] + 2 * m
    grain, out = max(1, m // 64), []
    cut = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1]) + 1
    counted = np.concatenate([[0], np.cumsum(t.holds(codes))])
    for lo, hi in zip(np.split(low, cut), np.split(high, cut)):
        at_ = np.arange(max(0, int(lo[0])), min(len(codes), int(hi[-1]) + 1))
        if m <= SHORT:
            told = np.unique(np.subtract.outer(at_, np.arange(m))[codes[at_][:, None] == t.words])
        else:
            at_ = at_[t.place_of(codes[at_]) >= 0]
            told = np.unique(at_ - t.place_of(codes[at_]))
            told = np.unique(np.concatenate([told - m // 8, told, told + m // 8]))
        first = told[np.unique(told // grain, return_index=True)[1]]
        last = told[np.append(np.flatnonzero(np.diff(told // grain)), len(told) - 1)] if len(told) else told
        # a span holds each phrase
        least_end = np.zeros(len(first), np.int64)
        for p, n in phrases:
            k = np.searchsorted(p, np.maximum(first, 0))
            least_end = np.maximum(least_end, np.append(p, len(codes) + 2 * m)[k] + n)
        on = least_end <= np.minimum(first + 2 * m, len(codes))
        for s, low_end in zip(first[on].tolist(), least_end[on].tolist()):
            ends = last[np.searchsorted(last, s - lacking):np.searchsorted(last, s + m, "right")] + m
            begin = max(0, s)
            for e in np.unique(np.minimum(ends, len(codes))).tolist():
                if e >= low_end and begin < e and counted[e] - counted[begin] >= least * m - 1e-9:
                    out.append((begin, e))
    return out


def matches(codes: np.ndarray, known: Templates, least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, template, coverage) by word places, not overlapping."""
    inside = np.flatnonzero(codes)
    if not len(inside):
        return []
    queue: list[tuple] = []

    def look(t: Template, s: int, e: int) -> None:
        pairs = align(codes[s:e].tolist(), t.words.tolist())
        m, n = len(t.words), len(pairs)
        if n and n >= least * m - 1e-9 and t.named(pairs):
            a, b = s + pairs[0][0], s + pairs[-1][0] + 1
            # words of the text that are not the template's count against a span, so that it keeps to one copy
            heapq.heappush(queue, ((b - a - n) / 2 - n, -n / m, t.name, a, b, s, e, t))

    for k in known.possible(codes, least):
        t, own = known.all[k], known.counts[k]
        telling = inside[np.isin(codes[inside], list(t.telling))]
        for s, e in spans(codes, telling, t, least):
            if len(t.words) <= SHORT or np.minimum(np.bincount(codes[s:e], minlength=len(own)), own)[1:].sum() >= least * len(t.words) - 1e-9:
                look(t, s, e)
    out: list[tuple] = []
    seen = set()
    while queue:
        _, coverage, name, a, b, s, e, t = heapq.heappop(queue)
        over = [o for o in out if o[0] < b and o[1] > a]
        if not over:
            insort(out, (a, b, name, -coverage))
            continue
        # what the better matches leave of the span may still hold one
        for lo, hi in zip([s] + [o[1] for o in over], [o[0] for o in over] + [e]):
            lo, hi = max(lo, s), min(hi, e)
            if hi - lo >= least * len(t.words) - 1e-9 and (lo, hi, name) not in seen:
                seen.add((lo, hi, name))
                look(t, lo, hi)
    return out


MATCH = "array<struct<start:bigint,end:bigint,license:string,coverage:double>>"
_MATCH = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))


def find_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None,
                  least: float = 0.8) -> DataFrame:
    """doc_id, n_words and matches (word places, template, coverage); by default of all notices and whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES | whole_texts() if templates is None else templates))

    def run(batches):
        known = shared.value
        vocabulary = known.vocabulary.cast(pa.large_string())
        for batch in at.slices(batches, text):
            offsets, values = at.words(at.texts_of(batch.column(text)), at.LOWER_ALNUM)
            code = pc.fill_null(pc.index_in(values, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            rows = [[dict(zip(("start", "end", "license", "coverage"), m))
                     for m in matches(code[offsets[k]:offsets[k + 1]], known, least)] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(np.diff(offsets), pa.int64()), pa.array(rows, _MATCH)],
                                             ["doc_id", "n_words", "matches"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_words long, matches {MATCH}")
