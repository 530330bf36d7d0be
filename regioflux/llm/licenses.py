"""Licence scans: base phrases, and template spans chained from a generalised suffix automaton's matching statistics.

The automaton holds all token substrings of the templates. A document's tokens are streamed through it: after every token
it knows the longest suffix that occurs in a template. Matches of at least LEAST tokens that cannot be extended are chained per
template over the whole document, forwards in document and template with small gaps; where two overlap, the later one
counts without what the earlier one has. Disjoint chains that cover at least COVERED of the template are spans, the fullest
first, and give the template's label. Words of a longer match in another template count for that one alone. Tokens outside the
templates' vocabulary only reset the automaton, so only runs of vocabulary tokens are walked one by one.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regioflux.llm import textbytes
from regioflux.llm.arrow import add_columns, text_column

#: The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Usual notices of public licences, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

LEAST = 3
GAP = 3
COVERED = 0.75


class SuffixAutomaton:
    """All substrings of several token sequences, with for each state every (sequence, end place) of its longest substring."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.places[last].append((number, at))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] = sorted({*self.places[self.link[state]], *self.places[state]})

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, parent: int, token: int) -> int:
        """The state of the parent's substring plus the token, taken apart from longer ones if needed."""
        child = self.next[parent][token]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, token)
        return new

    def matches(self, tokens: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) of every match that the next token does not extend."""
        out: list[tuple[int, int, int]] = []
        state = length = 0
        for at, token in enumerate(tokens):
            if token not in self.next[state]:
                if length >= LEAST:
                    out.append((at, length, state))
                while state > 0 and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
        if length >= LEAST:
            out.append((len(tokens), length, state))
        return out


def chains(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(start, end, covered tokens) of disjoint chains of matches (start, end, start in the template; by end) that reach COVERED of
    the template's size, the fullest first; no chain that reaches it is left beside them."""
    # For each match: the most tokens covered by a chain that ends with it, by where the chain began.
    best: list[dict[int, int]] = []
    for i, (start, end, at) in enumerate(found):
        own = {start: end - start}
        for j in range(i - 1, -1, -1):
            s, e, a = found[j]
            if e < start - GAP:
                break
            both = max(0, e - start, a + e - s - at)
            if both < end - start and start + both - e <= GAP and at + both - (a + e - s) <= GAP:
                for begin, covered in best[j].items():
                    own[begin] = max(own.get(begin, 0), covered + end - start - both)
        best.append(own)
    full = sorted(((c, b, end) for own, (_, end, _) in zip(best, found, strict=True) for b, c in own.items() if c >= COVERED * size), reverse=True)
    begins: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for covered, begin, end in full:
        i = bisect_left(begins, begin)
        if (i == 0 or taken[i - 1][1] <= begin) and (i == len(begins) or end <= begins[i]):
            begins.insert(i, begin)
            taken.insert(i, (begin, end, covered))
    return taken


class _Scanner:
    def __init__(self) -> None:
        phrases = textbytes.fingerprints_of([p for p, _ in PHRASES], textbytes.ALNUM)
        templates = textbytes.fingerprints_of([t for _, t in TEMPLATES], textbytes.ALNUM)
        vocabulary = np.unique(np.concatenate(phrases + templates))
        self.lookup = textbytes.Lookup(vocabulary)
        self.phrases = [self.lookup(x) for x in phrases]
        self.templates = [self.lookup(x).tolist() for x in templates]
        self.automaton = SuffixAutomaton(self.templates)

    def spans(self, by_template: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, covered share) of a document's matches."""
        out = []
        for template, found in sorted(by_template.items()):
            size = len(self.templates[template])
            if sum(end - start for start, end, _ in found) >= COVERED * size:
                out += [(template, begin, end, covered / size) for begin, end, covered in chains(found, size)]
        return out

    def scan(self, part: textbytes.Slice) -> list[tuple]:
        n = part.last - part.first
        found = textbytes.words(part, inside=textbytes.ALNUM)
        ids = self.lookup(textbytes.fingerprints(found))
        counts = np.diff(found.first)
        owner = np.repeat(np.arange(n), counts)
        place = np.arange(len(ids)) - np.repeat(found.first[:-1], counts)
        places: list[list[int]] = [[] for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        for phrase, (_, label) in zip(self.phrases, PHRASES, strict=True):
            k = len(phrase)
            hit = np.ones(max(len(ids) - k + 1, 0), dtype=bool)
            for j, token in enumerate(phrase.tolist()):
                hit &= ids[j : j + len(hit)] == token
            for i in np.flatnonzero(hit).tolist():
                if owner[i] == owner[i + k - 1]:
                    places[owner[i]].append(int(place[i]))
                    labels[owner[i]].add(label)
        matches: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(n)]
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1).ravel() >= LEAST].tolist():
            for d in range(owner[a], owner[b - 1] + 1):  # a run may go on into the next document
                low, high = max(a, int(found.first[d])), min(b, int(found.first[d + 1]))
                if high - low >= LEAST:
                    first = low - int(found.first[d])
                    for end, length, state in self.automaton.matches(ids[low:high].tolist()):
                        for template, last in self.automaton.places[state]:
                            matches[d].setdefault(template, []).append((first + end - length, first + end, last + 1 - length))
        return list(zip(counts.tolist(), places, labels, map(self.spans, matches), strict=True))


_scanner: list[_Scanner] = []

_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())]))
SCANNED = (
    "n_words long, base_places array<long>, base_names array<string>, spans array<struct<label:string,first:long,stop:long,covered:double>>"
)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the documents, n_words, the base phrases' places and labels, and the template spans in words."""

    def make(batch: pa.RecordBatch) -> list:
        if not _scanner:
            _scanner.append(_Scanner())
        rows = [row for part in textbytes.slices(text_column(batch, text)) for row in _scanner[0].scan(part)]
        spans = [[{"label": TEMPLATES[t][0], "first": a, "stop": b, "covered": c} for t, a, b, c in sorted(r[3], key=lambda x: (x[1], x[2], x[0]))] for r in rows]
        return [
            pa.array([r[0] for r in rows], type=pa.int64()),
            pa.array([sorted(r[1]) for r in rows], type=pa.list_(pa.int64())),
            pa.array([sorted(r[2]) for r in rows], type=pa.list_(pa.string())),
            pa.array(spans, type=_SPANS),
        ]

    return add_columns(docs, SCANNED, make)
