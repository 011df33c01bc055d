"""License scans with a generalised suffix automaton of licence tokens.

The automaton of all templates is built once (its size is bounded by the templates, some thousand tokens)
and each file streams through it: at every word the automaton's state is the longest suffix of what was
read that occurs in a template. Where that length stops growing stands a maximal match. Long matches are
chained in order of file and template, template by template, and a template whose covered share is high
enough names its licence."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimeter.llm.common import small_batches

# Licence notices by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
)
# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of the shortest match that is chained; words two chained matches may lie apart in a file.
LEAST_MATCH, MOST_GAP = 4, 40
#: Covered share of a template that names its licence: whole notices, or large parts of long texts.
LEAST_COVER, LONG_COVER, LONG_WORDS = 0.8, 0.5, 30

#: Bytes that part words become spaces, A-Z lower case; bytes of other characters stay.
FOLD = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of token lists, with all places where each state's strings end, by template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, tokens in enumerate(templates):
            last = 0
            for i, c in enumerate(tokens):
                last = self._extend(last, c)
                self.ends[last].setdefault(t, set()).add(i + 1)
        # A state's strings also end wherever those of the states that link to it do.
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s]:  # the empty string ends everywhere
                for t, e in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(t, set()).update(e)

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            q = self.next[p][c]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        new = self._add(self.length[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches (start, length, state) of at least `least` tokens; token -1 is in no template."""
        out = []
        state = length = 0
        for i, c in enumerate(tokens):
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
                continue
            if length >= least:
                out.append((i - length, length, state))
            while state and c not in self.next[state]:
                state = self.link[state]
            length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                state = length = 0
        if length >= least:
            out.append((len(tokens) - length, length, state))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES):
        words = [words_of_text(t) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in words]
        self.sizes = [len(t) for t in coded]
        self.automaton = Automaton(coded)

    def covers(self, words: list[bytes]) -> dict[int, tuple[int, int, int]]:
        """By template: most of its words covered by a chain, and the chain's first and end word."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        by_template = defaultdict(list)
        for start, length, state in self.automaton.matches(ids, LEAST_MATCH):
            for t, ends in self.automaton.ends[state].items():
                by_template[t] += [(start, end - length, length) for end in sorted(ends)]
        best = {}
        for t, found in by_template.items():
            # Chains: matches in the order of the file, onward in the template, not far apart.
            chains: list[tuple[int, int, int, int]] = []
            top = (0, 0, 0)
            for start, at, length in found:
                covered, first = length, start
                for k in range(len(chains) - 1, -1, -1):
                    end, t_end, c, f = chains[k]
                    if start - end > MOST_GAP:
                        break
                    lost = max(0, t_end - at, end - start)
                    if lost < length and at >= t_end - lost and at + length > t_end and c + length - lost > covered:
                        covered, first = c + length - lost, f
                chains.append((start + length, at + length, covered, first))
                top = max(top, (covered, -first, start + length))
            best[t] = (top[0], -top[1], top[2])
        return best

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans."""
        words = words_of_text(text)
        places, base = [], set()
        for i, w in enumerate(words):
            if w == b"license" and i:
                for phrase, label in PHRASES:
                    p = phrase.encode().split()
                    if words[max(0, i + 1 - len(p)) : i + 1] == p:
                        places.append(i + 1 - len(p))
                        base.add(label)
        labels, score, spans = set(base), 0.0, []
        for t, (covered, first, end) in self.covers(words).items():
            share = covered / self.sizes[t]
            score = max(score, share)
            if share >= LEAST_COVER or covered >= LONG_WORDS and share >= LONG_COVER:
                labels.add(self.labels[t])
                spans.append((self.labels[t], first, end))
        ends = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), sorted(spans)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = scanner().scan
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column(1)]
        rows = [(*r[:-1], ";".join(f"{k}:{a}:{b}" for k, a, b in r[-1])) for r in rows]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.record_batch({"doc_id": batch.column(0)} | {n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=True)})


def license_scan(df: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans are label:first word:end word of covered templates, semicolon-joined. Null and empty texts have
    no words, empty labels, null places and score 0. Of chains covering equally many words the earliest
    counts. Rows are scanned one by one, so keys may be null or repeat; an empty table gives no rows and
    other columns are not read."""
    small_batches(df.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema)
