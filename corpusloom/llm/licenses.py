"""Licence scan: a generalised suffix automaton of licence words reads the documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. The automaton holds every part of
every template and of the base phrases; reading a text, it gives at each word the longest part that
ends there (matching statistics). Longest matches of MIN_MATCH words at least are chained along one
template (gaps up to MAX_GAP words); a chain that covers MIN_SHARE of its template labels the span.
A base phrase labels wherever its words stand consecutively. Words outside windows that some
template holds can end no match of two words, so the automaton skips them.

Null and empty texts have no words, no labels, score 0. Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM, Words, per_text, words_of

MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.6

#: Phrases that label by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Standard notices of public licences.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "mit": (
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}

FOUND = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())]))),
    ]
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])


class SuffixAutomaton:
    """All parts of several word sequences, with the sequences and places where each part ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], no: int) -> None:
        last = 0
        for place, word in enumerate(words):
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
                last = new
            self.ends[last].add((no, place))

    def close(self) -> None:
        """Hand the places of longer parts down to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def read(self, words: list[int]):
        """(state, length of the longest part) after each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state, length = 0, 0
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        named = [(label, t, False) for label, ts in templates.items() for t in ts] + [(label, p, True) for p, label in phrases.items()]
        self.labels = [x[0] for x in named]
        self.is_phrase = [x[2] for x in named]
        w = words_of(pa.array([x[1] for x in named]), ALNUM, True)
        self.sizes = w.count().tolist()
        self.codes = {int(h): i + 1 for i, h in enumerate(np.unique(w.hash))}
        self.automaton = SuffixAutomaton()
        for no in range(len(named)):
            self.automaton.add([self.codes[int(h)] for h in w.hash[w.first[no] : w.first[no + 1]]], no)
        self.automaton.close()
        #: state -> phrases that end what it stands for: its own and those of its suffixes
        self.phrase_ends: list[list[int]] = [[] for _ in self.automaton.next]
        for no in range(len(named)):
            if self.is_phrase[no]:
                *_, (state, _) = self.automaton.read([self.codes[int(h)] for h in w.hash[w.first[no] : w.first[no + 1]]])
                self.phrase_ends[state].append(no)
        for state in sorted(range(1, len(self.automaton.next)), key=lambda s: self.automaton.length[s]):
            self.phrase_ends[state] += self.phrase_ends[self.automaton.link[state]]
        shortest = min(self.sizes)
        self.seed = min(shortest, MIN_MATCH)
        self.seeds = np.unique(w.windows(self.seed)[1])
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def runs(self, w: Words) -> list[tuple[int, int]]:
        """Stretches of words in which every window of `seed` words is part of a template."""
        at, h = w.windows(self.seed)
        some = np.flatnonzero(self.near[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.seeds, h[some]), len(self.seeds) - 1)
        at = at[some[self.seeds[place] == h[some]]]
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        return list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut - 1, len(at) - 1]] + self.seed).tolist(), strict=True))

    def found(self, texts: pa.Array) -> list[pa.Array]:
        w = words_of(texts, ALNUM, True)
        base: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        matches: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for start, end in self.runs(w):
            k = int(w.text[start])
            if int(w.text[end - 1]) != k:  # stretches of neighbouring texts touch
                cuts = [start, *(w.first[k + 1 : int(w.text[end - 1]) + 1].tolist()), end]
            else:
                cuts = [start, end]
            for a, b in zip(cuts, cuts[1:], strict=False):
                k = int(w.text[a])
                self._read(w, a, b, int(w.first[k]), base[k], matches[k])
        out = [self._chains(m, b) for m, b in zip(matches, base, strict=True)]
        starts = [[i for i, _ in b] for b in base]
        base_labels = [sorted({self.labels[no] for _, no in b}) for b in base]
        return [
            pa.array(w.count(), pa.int64()),
            pa.array([len(s) for s in starts], pa.int64()),
            pa.array([min(s, default=None) for s in starts], pa.int64()),
            pa.array([max(s, default=None) for s in starts], pa.int64()),
            pa.array(base_labels, pa.list_(pa.string())),
            pa.array([sorted({*b, *(x["label"] for x in o)}) for b, o in zip(base_labels, out, strict=True)], pa.list_(pa.string())),
            pa.array([max((x["share"] for x in o), default=0.0) for o in out], pa.float64()),
            pa.array(out, pa.list_(_SPAN)),
        ]

    def _read(self, w: Words, start: int, end: int, first: int, base: list, matches: list) -> None:
        codes = [self.codes.get(int(h), 0) for h in w.hash[start:end]]
        last: tuple[int, int] = (0, 0)
        for i, (state, length) in enumerate([*self.automaton.read(codes), (0, 0)]):
            for no in self.phrase_ends[state]:
                if length >= self.sizes[no]:
                    base.append((start - first + i - self.sizes[no] + 1, no))
            # a match is longest where the next word does not lengthen it
            if last[1] >= MIN_MATCH and length != last[1] + 1:
                matches += [(no, start - first + i - last[1], last[1], place - last[1] + 1) for no, place in self.automaton.ends[last[0]] if not self.is_phrase[no]]
            last = (state, length)

    def _chains(self, matches: list, base: list) -> list[dict]:
        """Matches (template, start, words, place in the template) as chains, and the base phrases."""
        spans = [{"label": self.labels[no], "start": i, "end": i + self.sizes[no], "share": 1.0} for i, no in base]
        open_: dict[int, list[int]] = {}
        done: list[tuple[int, list[int]]] = []
        for no, start, length, place in sorted(matches, key=lambda m: (m[1], m[0], m[3])):
            chain = open_.get(no)
            if chain and start + length > chain[1] and start <= chain[1] + MAX_GAP and place + length > chain[2]:
                new = min(length, start + length - chain[1], place + length - chain[2])
                open_[no] = [chain[0], start + length, place + length, chain[3] + new]
            elif not chain or start >= chain[1]:
                if chain:
                    done.append((no, chain))
                open_[no] = [start, start + length, place + length, length]
        best: dict[tuple[str, int], dict] = {}
        for no, (start, end, _, covered) in [*done, *open_.items()]:
            share = min(1.0, covered / self.sizes[no])
            if share >= MIN_SHARE and share > best.get((self.labels[no], start), {"share": 0})["share"]:
                best[self.labels[no], start] = {"label": self.labels[no], "start": start, "end": end, "share": share}
        return sorted([*spans, *best.values()], key=lambda x: (x["start"], x["label"], x["end"]))


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, templates: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """`row` and `found`: n_words, base phrases, labels, score and the labelled word spans."""
    given = (templates or TEMPLATES, phrases or PHRASES)

    def make():
        scanner = Scanner(*given)
        return scanner.found

    return per_text(docs, text, keep, FOUND, make)
