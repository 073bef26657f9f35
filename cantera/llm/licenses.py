"""Licence texts in documents: matching statistics from a generalised suffix automaton.

The words of all templates form one automaton. Each text is streamed through it: after every
word, the automaton knows the longest run of words ending there that occurs in any template.
Phrases are read off those runs; long runs are chained, in order, into spans of a template,
and a template whose words are covered well enough gives its label.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.runs import Runs, blocks, byte_class, changes

# Fixed values of the task: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public licence texts and the notices that point at them.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

# A run of fewer words is no evidence for a template.
LONG_MATCH = 5
# Words of other text that may lie between two runs of one span.
MAX_GAP = 12
COVERAGE = 0.7

WORD_BYTE = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """Generalised suffix automaton of token lists, with the places where each state occurs."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(lists):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token, ends)
                ends[last].append((number, at))
        # A state occurs where any state below it in the tree of links does: places in the order of
        # a walk through the tree, of which every state has a stretch.
        below: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            below[self.link[state]].append(state)
        self.order: list[tuple[int, int]] = []
        self.stretch = [(0, 0)] * len(self.link)
        begin, path = [0] * len(self.link), [(0, False)]
        while path:
            state, done = path.pop()
            if done:
                self.stretch[state] = (begin[state], len(self.order))
                continue
            begin[state] = len(self.order)
            self.order.extend(ends[state])
            path.append((state, True))
            path.extend((child, False) for child in below[state])

    def places(self, state: int) -> list[tuple[int, int]]:
        """(list, place) of the last token wherever the state occurs."""
        return self.order[slice(*self.stretch[state])]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _split(self, before: int, token: int, old: int, ends: list) -> int:
        """A copy of `old` for the shorter strings that come by way of `before`."""
        copy = self._state(self.length[before] + 1, ends)
        self.next[copy], self.link[copy] = dict(self.next[old]), self.link[old]
        self.link[old] = copy
        while before >= 0 and self.next[before].get(token) == old:
            self.next[before][token] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, token: int, ends: list) -> int:
        there = self.next[last].get(token)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, token, there, ends)
        new, state = self._state(self.length[last] + 1, ends), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][token]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._split(state, token, old, ends)
        return new

    def state_of(self, tokens: list[int]) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state


class Scanner:
    """Labels and spans of streams of word numbers."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, long_match=LONG_MATCH, max_gap=MAX_GAP, coverage=COVERAGE):
        texts = [words_of(text) for _, text in templates] + [words_of(text) for text, _ in phrases]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        lists = [[self.vocabulary[w] for w in t] for t in texts]
        self.automaton = Automaton(lists)
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in lists[: len(templates)]]
        self.long_match, self.max_gap, self.coverage = long_match, max_gap, coverage
        # Phrases that end in a state, its own and those of its suffixes.
        own: dict[int, list[tuple[int, str]]] = {}
        for tokens, (_, label) in zip(lists[len(templates) :], phrases):
            own.setdefault(self.automaton.state_of(tokens), []).append((len(tokens), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = own.get(state, []) + self.phrases[self.automaton.link[state]]
        self.shortest = min([len(t) for t in lists[len(templates) :]] + [long_match])

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        follow, link, lengths = self.automaton.next, self.automaton.link, self.automaton.length
        state = matched = 0
        for token in tokens:
            while state and token not in follow[state]:
                state = link[state]
                matched = lengths[state]
            if token in follow[state]:
                state, matched = follow[state][token], matched + 1
            yield state, matched

    def scan(self, segments: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(phrase starts with labels, spans (label, first word, last word, coverage)) of one text.

        `segments` are its runs of template words, each with the number of its first word.
        """
        found, anchors = [], []
        for first, tokens in segments:
            before = (0, 0)
            for i, now in enumerate(self.statistics(tokens)):
                for size, label in self.phrases[now[0]]:
                    if now[1] >= size:
                        found.append((first + i - size + 1, label))
                # A match that the next word doesn't extend is maximal.
                if before[1] >= self.long_match and now[1] <= before[1]:
                    anchors.append((first + i - 1, *before))
                before = now
            if before[1] >= self.long_match:
                anchors.append((first + len(tokens) - 1, *before))
        return found, self.chained(anchors)

    def chained(self, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of templates: matches in order, near each other in the text and going forward in the template.

        For each template, dynamic programming over its matches (last word, state, words) finds
        for every one the chain that ends there and covers most words; words that two matches
        share count once. Chains are taken from the one that covers most down, each match and
        each stretch of the text once.
        """
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, size in anchors:
            for template, at in self.automaton.places(state):
                if template < len(self.labels):
                    matches.setdefault(template, []).append((end, at, size))
        spans = []
        for template, own in sorted(matches.items()):
            spans += [(self.labels[template], first, last, covered / self.sizes[template]) for first, last, covered in chains(own, self.max_gap)]
        return spans


def chains(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of the chains of one template's matches, in order of the text.

    `matches` are (last word in the text, last word in the template, words), ends ascending.
    """
    best, before = [], []
    low, longest = 0, max((size for _, _, size in matches), default=0)
    for i, (end, at, size) in enumerate(matches):
        # Only matches that end near enough can go before.
        while low < i and end - matches[low][0] > max_gap + longest:
            low += 1
        top, via = size, -1
        for j in range(low, i):
            there, place, _ = matches[j]
            if there < end and place < at and end - size + 1 - there <= max_gap:
                total = best[j] + size - max(0, there - (end - size), place - (at - size))
                if total > top:
                    top, via = total, j
        best.append(top)
        before.append(via)
    taken: list[tuple[int, int, int]] = []
    used: set[int] = set()
    ranges = Ranges()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        at, chain = i, []
        while at >= 0 and at not in used and ranges.free(matches[at][0] - matches[at][2] + 1, matches[at][0]):
            chain.append(at)
            at = before[at]
        if not chain:
            continue
        # A chain that runs into one that is taken keeps what it covers after that.
        first = matches[chain[-1]]
        covered = best[i] - best[chain[-1]] + first[2]
        used.update(chain)
        span = (min(matches[c][0] - matches[c][2] + 1 for c in chain), matches[i][0])
        ranges.take(*span)
        taken.append((*span, covered))
    return sorted(taken)


class Ranges:
    """Stretches of words that are taken, none of which touch."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def free(self, first: int, last: int) -> bool:
        at = bisect_right(self.begins, last)
        return not at or self.ends[at - 1] < first

    def take(self, first: int, last: int) -> None:
        low, high = bisect_left(self.ends, first), bisect_right(self.begins, last)
        if low < high:
            first, last = min(first, self.begins[low]), max(last, self.ends[high - 1])
        self.begins[low:high], self.ends[low:high] = [first], [last]


SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: `key`, counts, first and last place, labels, score and spans.

    Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z, numbered from
    0; null is empty. `spans` are all chained template matches with their coverage; those of
    `COVERAGE` and more add their label. The score is 1 with a phrase, else the best coverage,
    0 if there is none. Whole texts are streamed, and memory holds a block of them. Other
    columns of `docs` are left out.
    """
    scanner = Scanner(**options)
    schema = T.StructType([docs.schema[key], *RESULT])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w.encode() for w in scanner.vocabulary], pa.binary())
        for block in blocks(batches, "text"):
            lower = pc.ascii_lower(pc.fill_null(block.column("text"), ""))
            runs = Runs(lower, changes(WORD_BYTE), keep=WORD_BYTE)
            number = pc.fill_null(pc.index_in(runs.words, known), -1).to_numpy(zero_copy_only=False)[runs.codes]
            # Runs of words that templates have; no match crosses another word.
            inside = np.concatenate([[False], number >= 0, [False]])
            same = np.concatenate([[False], runs.text_of[1:] == runs.text_of[:-1], [False]]) if len(number) else np.array([False])
            begins = np.flatnonzero(inside[1:-1] & ~(inside[:-2] & same[:-1]))
            ends = np.flatnonzero(inside[1:-1] & ~(inside[2:] & same[1:])) + 1
            enough = ends - begins >= scanner.shortest
            segments: dict[int, list] = {}
            for a, b in zip(begins[enough].tolist(), ends[enough].tolist()):
                row = int(runs.text_of[a])
                segments.setdefault(row, []).append((a - int(runs.first[row]), number[a:b].tolist()))
            rows = []
            for row, n in enumerate(np.diff(runs.first).tolist()):
                found, spans = scanner.scan(segments[row]) if row in segments else ([], [])
                base = sorted({label for _, label in found})
                more = {label for label, _, _, covered in spans if covered >= scanner.coverage}
                starts = [at for at, _ in found]
                rows.append(
                    {
                        "n_words": n,
                        "n_base": len(found),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(base),
                        "labels": ",".join(sorted(more | set(base))),
                        "score": 1.0 if found else min(1.0, max((s[3] for s in spans), default=0.0)),
                        "spans": [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans],
                    }
                )
            result = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([block.column("key"), *result.columns], names=schema.names)

    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    arrow = pa.schema([(f.name, kinds.get(f.dataType, pa.list_(span))) for f in RESULT])
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(scan, schema)
