"""Operator 5: license notices by patience alignment.

Each template is compared with windows of a text, word by word: words that occur once in
both are anchors, the longest increasing subsequence of their places is kept, and the
gaps between anchors are aligned in the same way; a gap without such words matches equal
words from its two ends inwards.  Coverage is the share of the template's words that are
aligned; a window of at least ``coverage`` is a match.

A match is a run of words of a text, at most ``1 + stretch`` times as long as the template,
in which at least ``coverage`` of the template's words are aligned, and among them the words
that tell the license from others (``NAMES``); beside these there is none of the words by which
other licenses of the family differ (``FOREIGN``).  Only places where at least that share of the
template's length are words of the template, counted as often as the template has them at
most, are aligned; an alignment cannot match more words than that, so no match is lost.
Along a stretch of such places the one with the most words is aligned, and places after its
end are looked at again, so that repeated notices are found one by one.

Of matches that overlap, that with the most aligned words stays, so that a text is reported as the
license that it fits best.

Defined results: null and empty texts have no matches; of templates with equally many aligned
words the one that is covered best, then the first by name, stays; repeated rows give a row each per match; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .codec import text_runs
from .common import WordCache, batched, read_table, texts_of

#: Notices as their licenses give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Notices of licenses that are easily taken for those above.
TEMPLATES |= {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "NCSA-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Whole license texts, but for their copyright lines.
TEMPLATES |= {
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

_CLAUSES = TEMPLATES["BSD-3-Clause-text"].split("\n")
TEMPLATES["BSD-2-Clause-text"] = "\n".join(line for line in _CLAUSES if not line.startswith("3."))

#: Words of a template without which it is another license's.
NAMES = {
    "AGPL-3.0": "gnu affero general public 3",
    "AGPL-3.0-header": "gnu affero general public 3",
    "BSD-3-Clause-text": "endorse promote",
    "BSL-1.0": "boost software 1",
    "CC-BY-SA-4.0": "creative commons attribution sharealike 4",
    "CC0-1.0": "dedicated public domain waiving",
    "EPL-2.0": "eclipse public 2",
    "GPL-2.0-header": "gnu general public 2",
    "LGPL-3.0": "gnu lesser general public 3",
    "LGPL-3.0-header": "gnu lesser general public 3",
    "NCSA-grant": "deal with redistributions disclaimers",
    "Unlicense": "unencumbered public domain",
    "Apache-2.0": "apache 2",
    "Apache-2.0-header": "apache 2",
    "CC-BY-4.0": "creative commons attribution 4",
    "CC-BY-NC-4.0": "by nc 4",
    "GPL-3.0": "gnu general public 3",
    "GPL-3.0-header": "gnu general public 3",
    "MIT": "mit",
    "MPL-2.0": "mozilla public 2",
}

#: Words that make another license of a template's, where they stand beside its ``NAMES``.
_GNU, _CC = "lesser affero library", "sharealike noncommercial noderivatives noderivs nc nd sa"
FOREIGN = {name: _GNU for name in NAMES if "GPL" in name} | {name: _CC for name in NAMES if name.startswith("CC-BY")}

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence: piles of cards, with the pile before noted."""
    tops, at, before = [], [], []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[pile], at[pile] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [unique[k] for k in increasing([j for _, j in unique])]
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k > i + 1 and m > j + 1]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, stretch: float):
        self.names, self.stretch = sorted(templates), stretch
        self.words = [words_of(templates[n]) for n in self.names]
        self.least = [max(1, int(np.ceil(coverage * len(w) - 1e-9))) for w in self.words]
        self.times = [Counter(w) for w in self.words]
        self.own = [set(NAMES.get(n, "").split()) for n in self.names]
        self.foreign = [set(FOREIGN.get(n, "").split()) - set(w) for n, w in zip(self.names, self.words, strict=True)]
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.none = len(vocabulary)
        self.of = np.zeros((len(self.names), self.none + 1), bool)
        for t, own in enumerate(self.words):
            self.of[t, [vocabulary[w] for w in own]] = True
        self.known = WordCache(lambda w: vocabulary.get(w, self.none))

    def windows(self, ids: np.ndarray, t: int) -> np.ndarray:
        """Template words in each window as long as a match can be."""
        sums = np.concatenate([[0], np.cumsum(self.of[t, ids])])
        first = np.arange(len(ids))
        return sums[np.minimum(first + self.reach(t), len(ids))] - sums[first]

    def reach(self, t: int) -> int:
        return len(self.words[t]) + int(self.stretch * len(self.words[t]))

    def another(self, t: int, words: list[str], at: int, best: list[tuple[int, int]]) -> bool:
        """Whether a foreign word stands beside a name that is aligned, or in a run of such words there."""
        aligned = {at + j: self.words[t][i] in self.own[t] for i, j in best}
        for j, name in aligned.items():
            for step in (-1, 1) if name else ():
                k = j + step
                if 0 <= k < len(words) and k not in aligned and words[k] in self.foreign[t]:
                    return True
        return False

    def fitting(self, words: list[str], ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """``matches`` without those that overlap one with more aligned words, in the order of their places."""
        rank = lambda m: (-round(m[3] * len(self.words[m[0]])), -m[3], m[0], m[1])
        kept: list[tuple[int, int, int, float]] = []
        for m in sorted(self.matches(words, ids), key=rank):
            if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[1])

    def matches(self, words: list[str], ids: np.ndarray):
        """(template, first word, past-last word, coverage) of the matches in a text."""
        for t, own in enumerate(self.words):
            counts = self.windows(ids, t)
            at = 0
            for start in np.flatnonzero(counts >= self.least[t]).tolist():
                if start < at or not self.of[t, ids[start]]:  # a match may start at a word of the template
                    continue
                window = words[start : start + self.reach(t)]
                if sum(min(n, self.times[t][w]) for w, n in Counter(window).items() if w in self.times[t]) < self.least[t]:
                    continue
                # the window may start before the notice: of its template words within reach, the start
                # with the most words aligned counts, and of several that with the shortest span
                best, shift, rank = [], 0, (0, 0)
                for k in range(self.reach(t) - len(own) + 1):
                    if start + k < len(ids) and self.of[t, ids[start + k]]:
                        other = align(own, words[start + k : start + k + self.reach(t)])
                        places = [j for _, j in other] or [0]
                        if (len(other), min(places) - max(places)) > rank:
                            best, shift, rank = other, k, (len(other), min(places) - max(places))
                if len(best) >= self.least[t] and self.own[t] <= {own[i] for i, _ in best} and not self.another(t, words, start + shift, best):
                    places = [j for _, j in best]
                    yield t, start + shift + min(places), start + shift + max(places) + 1, len(best) / len(own)
                    at = start + shift + max(places) + 1


_MATCH = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())])


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8, stretch: float = 0.5) -> DataFrame:
    """``doc_id, license, start, end, n_words, coverage`` per match; places are code points."""

    def scan(batches):
        scanner = Scanner(templates, coverage, stretch)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, texts in text_runs(batch.column("text")):
                words = [words_of(t) for t in texts]
                lengths = [len(w) for w in words]
                ids = np.fromiter((scanner.known[w] for own in words for w in own), np.int64, sum(lengths))
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(texts)), lengths)
                hopeful = set()
                for t in range(len(scanner.names)):
                    hopeful.update(np.unique(owner[scanner.windows(ids, t) >= scanner.least[t]]).tolist())
                for d in sorted(hopeful):
                    found = scanner.fitting(words[d], ids[ends[d] - lengths[d] : ends[d]])
                    if found:
                        places = [m.span() for m in _WORD.finditer(texts[d].lower())]
                        if len(texts[d].lower()) != len(texts[d]):  # lower case changed the length: count words as they are
                            places = [m.span() for m in _WORD.finditer(texts[d])]
                            places += [(len(texts[d]), len(texts[d]))] * (len(words[d]) - len(places))
                        for t, first, past, share in found:
                            yield doc_ids[start + d], scanner.names[t], places[first][0], places[past - 1][1], past - first, share

    return texts_of(docs).mapInArrow(lambda b: batched(scan(b), _MATCH), "doc_id long, license string, start long, end long, n_words long, coverage double")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read_table(spark, sf_dir, "documents"))
