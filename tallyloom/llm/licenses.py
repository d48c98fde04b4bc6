"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of words, half overlapping, of a longer line or
of the whole text, its line breaks ignored, so that a notice wrapped over lines
is met too.  Windows are twice as long as a template at least: templates go by
classes of length, each with its own windows.  A template T meets a block B when
|T & B| >= percent/100 * |T| over distinct words.

Template words are ordered by how often they occur in all documents, rarest
first, and a block is its distinct template words in that order.  A block that
meets T has `need` words at least (length filter), and one of them is among the
first |T| - need + 1 of T (prefix filter).  At the r-th word of T and the q-th
of B no more than what both have left can still be common; with those found so
far this must reach `need` (positional filter; as T's prefix ends in time, it is
B's words that may be too few).  Only what is left then is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X

# Phrases that name a license, and notices in use with each license.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under the Creative Commons Attribution 4.0 International License"),
)

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,containment:double>>"

_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _sets(templates: tuple[tuple[str, str], ...]) -> list[np.ndarray]:
    w = X.words(pa.array([t for _, t in templates]), X.ALNUM, lower=True)
    return [np.unique(w.hash[w.of(i)]) for i in range(len(templates))]


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word hash of the sorted vocabulary occurs in all texts; a task sends one row for each."""

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in X.pieces(batch):
                h = X.words(part.column("text"), X.ALNUM, lower=True).hash
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                n += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.word] = r.n
    return out


class Matcher:
    """The templates, ready to scan texts with."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], percent: int, window: int, vocabulary: np.ndarray, counts: np.ndarray):
        self.labels, self.vocabulary = [label for label, _ in templates], vocabulary
        rank = np.lexsort((vocabulary, counts))
        self.place = np.empty(len(rank), np.int64)
        self.place[rank] = np.arange(len(rank))
        sizes = np.diff(X.words(pa.array([t for _, t in templates]), X.ALNUM, lower=True).first)
        self.words = [np.sort(self.place[np.searchsorted(vocabulary, s)]) for s in _sets(templates)]
        self.need = [-(-percent * len(s) // 100) for s in self.words]
        #: By window: the templates that begin with a word, and how many of theirs come before it.
        self.classes: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, (s, need) in enumerate(zip(self.words, self.need, strict=True)):
            wide = window
            while wide < 2 * sizes[t]:
                wide *= 2
            own = self.classes.setdefault(wide, {})
            for r, k in enumerate(s[: len(s) - need + 1] if len(s) else []):
                own.setdefault(int(k), []).append((t, r))
        self.pruned = 0
        self.phrases = [([X.hash_of(x) for x in p.split()], label) for p, label in phrases]

    def scan(self, texts: pa.Array) -> list[tuple]:
        w = X.words(texts, X.ALNUM, lower=True)
        lines = X.words(texts, _LINE)
        line_first = np.searchsorted(w.start, lines.start)
        places: dict[int, list[tuple[int, str]]] = {}
        for hashes, label in self.phrases:
            k = len(hashes)
            at = np.flatnonzero(w.hash[: max(0, len(w.hash) - k + 1)] == hashes[0])
            for j in range(1, k):
                at = at[w.hash[at + j] == hashes[j]]
            for i in at[w.row[at] == w.row[at + k - 1]]:
                places.setdefault(int(w.row[i]), []).append((int(i - w.first[w.row[i]]), label))
        met = self._blocks(w, line_first)
        out = []
        for r in range(len(w.offsets) - 1):
            base, spans = places.get(r, []), met.get(r, [])
            named = sorted({label for _, label in base})
            at = [a for a, _ in base]
            out.append((int(w.first[r + 1] - w.first[r]), len(base), min(at) if at else None, max(at) if at else None, ",".join(named), ",".join(sorted({*named, *(s[0] for s in spans)})), 1.0 if base else max((s[3] for s in spans), default=0.0), spans))
        return out

    def _blocks(self, w: X.Words, line_first: np.ndarray) -> dict[int, list[tuple[str, int, int, float]]]:
        """By row: (label, first word, last word, containment) of each block that meets a template."""
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        place = np.where(self.vocabulary[at] == w.hash, self.place[at], -1)
        edges = np.append(line_first, len(w.hash))
        out: dict[int, list] = {}
        for window, prefix in self.classes.items():
            begins = np.zeros(len(self.place) + 1, bool)
            begins[list(prefix)] = True
            for a, z in sorted(self._around(w, np.flatnonzero(begins[place]), edges, window)):
                row = int(w.row[a])
                for t, common in self._met(np.unique(place[a:z]), prefix):
                    out.setdefault(row, []).append((self.labels[t], int(a - w.first[row]), int(z - 1 - w.first[row]), common / len(self.words[t])))
        return out

    @staticmethod
    def _around(w: X.Words, at: np.ndarray, edges: np.ndarray, window: int) -> set[tuple[int, int]]:
        """(first, end) of the blocks that hold one of these words."""
        found, half = set(), window // 2
        for i in at.tolist():
            line, row = int(np.searchsorted(edges, i, "right")) - 1, int(w.row[i])
            for lo, hi in {(int(edges[line]), int(edges[line + 1])), (int(w.first[row]), int(w.first[row + 1]))}:
                last = 0 if hi - lo <= window else -(-(hi - lo - window) // half)
                for b in range(max(0, (i - lo - window) // half + 1), min(last, (i - lo) // half) + 1):
                    found.add((lo + b * half, min(hi, lo + b * half + window)))
        return found

    def _met(self, block: np.ndarray, prefix: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(template, words in common) of each template that a block meets; block: places of its words, ascending, -1 for any other."""
        block = block[block >= 0].tolist()
        shared: dict[int, int] = {}
        for q, k in enumerate(block):
            for t, r in prefix.get(k, ()):
                if len(block) < self.need[t]:
                    continue
                so_far = shared.get(t, 0)
                if so_far < 0 or so_far + 1 + min(len(self.words[t]) - r - 1, len(block) - q - 1) < self.need[t]:
                    self.pruned += so_far >= 0
                    shared[t] = -1
                else:
                    shared[t] = so_far + 1
        out = []
        for t, so_far in sorted(shared.items()):
            if so_far > 0 and (common := len(set(block) & set(self.words[t].tolist()))) >= self.need[t]:
                out.append((t, common))
        return out


def scan(docs: DataFrame, percent: int = 90, window: int = 64, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """A row for each row of docs: words, places of phrases, labels, score (the largest containment; 1 at a phrase) and the blocks met, `spans`.

    A null or empty text has no words, no labels ('') and score 0.  doc_id may be
    null or repeat; other columns are not read; an empty table gives no rows.
    templates: (label, text); window: words of the shortest windows.  Templates
    without words are met by nothing.
    """
    templates = tuple(t for t, s in zip(templates, _sets(templates), strict=True) if len(s))
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(templates)]))
    matcher = Matcher(templates, phrases, percent, window, vocabulary, frequencies(docs, vocabulary))

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SCAN.split(", ")]
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            for part in X.pieces(batch):
                *cols, spans = zip(*matcher.scan(part.column("text")), strict=True)
                spans = [[dict(zip(("label", "first_word", "last_word", "containment"), s, strict=True)) for s in row] for row in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(spans, span)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)
