"""License scans: normalised text against license templates by Dice over word bigrams.

Windows of words at any place and of any size, so also within a line, over line ends and
in texts without them, are compared with every template: twice the shared word bigrams
(with repeats) over the bigrams of both. A window of a bigrams can reach the threshold t
with a template of b only if a / b lies between t / (2 - t) and its inverse, and only if it
shares that part of b; both bounds prune before a window is looked at. The best windows
begin and end with a shared bigram, so no others are. ``Templates.match`` compares only
lines, paragraphs and the whole. Runs in the tasks of the scan; no row moves.

Marks of list points (bullets, letters, numbers) are no words. Words that tell licenses apart
(Affero, NC, SA, ..., and numbers behind a word such as "version" or "license") must occur in
a window as often as in the template, or to a fifth of it in whole texts. Of windows that overlap the
most alike one stands, of equal ones that of the longer template, so a notice names one
license.

Defined results: a null or empty text, and a window of fewer than two words, matches
nothing; a null id stays null; repeated rows are scanned each; an empty table gives an
empty result; of equal Dice the earliest, then shortest window is reported. Other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetstats.llm.common import id_text, in_tasks, text_slices
from fleetstats.llm.license_texts import TEXTS

THRESHOLD = 0.8
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”«»…©"

# Notices by which works state their license, (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_PROGRAM = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public "
            "License as published by the Free Software Foundation; either version {} of the License, or (at your option) "
            "any later version.")
_OPENING = "GNU {} PUBLIC LICENSE Version {}, {} Copyright (C) {} Free Software Foundation, Inc."
_CREATIVE = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike",
             "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
             "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_KINDS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}
#: Neighbours of the notices above: other versions and kinds.
TEMPLATES += tuple(
    (name, text.format(kind, version)) for name, kind, version in (
        ("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("LGPL-2.0", "Library General", "2"),
        ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"))
    for text in ("This work is licensed under the GNU {} Public License, version {}.", _PROGRAM))
TEMPLATES += tuple(
    (f"CC-{code}-{version}", text) for version, kind in _KINDS.items() for code, name in _CREATIVE.items()
    for text in (f"Licensed under CC {code} {version}.",
                 f"This work is licensed under a Creative Commons {name} {version} {kind} License.")
    if (f"CC-{code}-{version}", text) not in TEMPLATES)
TEMPLATES += (
    ("AGPL-3.0", _OPENING.format("AFFERO GENERAL", "3", "19 November 2007", "2007")),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                "not use this file except in compliance with the License."),
)

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.")
_BSD_NAMES = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
#: What the scan looks for: the notices, license conditions and whole license texts.
ALL = TEMPLATES + (
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _BSD_NAMES),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
) + TEXTS

#: SPDX identifiers of the names above; each stands in a line of its own form.
SPDX_FORMS = ("{}", "{}-only", "{}-or-later", "{}+")
#: Lines that name a license by its SPDX identifier, and notices that leave out "Version".
ALL += tuple((name, "SPDX-License-Identifier: " + form.format(name)) for name in sorted({name for name, _ in ALL})
             for form in (SPDX_FORMS if "GPL" in name else SPDX_FORMS[:1]))
ALL += tuple(("Apache-2.0", f"{verb} under the Apache License 2.0.") for verb in ("Licensed", "Released"))

#: Words that tell licenses apart, and those of them that count just before a window too.
MARK = re.compile(r"[1-9]-clause|by(-(nc|sa|nd))+|affero|lesser|library|.*(noncommercial|sharealike|noderiv).*")
BEFORE = ("affero", "lesser", "library")
#: A number tells licenses apart only as a version: behind one of these words.
VERSION = re.compile(r"v?[0-9](\.[0-9])*")
VERSIONED = re.compile(r"version|v|licen[sc]e|cc|[al]?gpl|mpl|by(-(nc|sa|nd))*|attribution.*")
#: Marks of a list's points; behind a word of VERSIONED it is a version that ends a sentence.
POINT = re.compile(r"\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[•·‣◦–—]")
#: Part of a mark's count by which a window may differ from its template.
MARK_SLACK = 0.2


def normal_words(text: str) -> list[str]:
    """Lower-case white-space words without punctuation at their ends; marks of list points are left out."""
    out: list[str] = []
    for w in text.lower().split():
        if len(w) < 7 and POINT.fullmatch(w) and not (out and VERSIONED.fullmatch(out[-1])):
            continue
        w = w.strip(TRIM)
        if w:
            out.append(w)
    return out


def is_mark(word: str, before: str) -> bool:
    """Whether a word, with the one before it, tells licenses apart."""
    if word[0].isdigit() or word[0] == "v":
        if VERSION.fullmatch(word):
            return VERSIONED.fullmatch(before) is not None
    return MARK.fullmatch(word) is not None


class Templates:
    """Templates as bigram counts, with the bounds that prune; ``marks``: windows must have theirs."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD, marks: bool = False) -> None:
        self.threshold = threshold
        worded = [(name, normal_words(text)) for name, text in templates]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, words in worded for w in words}))}
        self.base = len(self.number) + 1
        self.names, self.counts, self.sizes = [], [], []
        for name, words in worded:
            if len(words) > 1:
                ids = [self.number[w] for w in words]
                self.names.append(name)
                self.counts.append(Counter(a * self.base + b for a, b in zip(ids, ids[1:])))
                self.sizes.append(len(ids) - 1)
        self.bigrams = np.array(sorted({key for c in self.counts for key in c}) or [-1], dtype=np.int64)
        self.low = threshold / (2 - threshold)
        self.caps = np.array([[c[key] for key in self.bigrams.tolist()] for c in self.counts],
                             dtype=np.int64).reshape(len(self.counts), len(self.bigrams))
        self.marks = [Counter(w for w, before in zip(words, ["", *words]) if is_mark(w, before))
                      for _, words in worded if len(words) > 1] if marks else None
        self.least = self.low * np.array(self.sizes, dtype=np.float64) - 1e-9

    def segments(self, ids: np.ndarray, lines: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the lines, paragraphs (runs of lines that have words) and the whole."""
        ends = np.cumsum(lines)
        starts = ends - lines
        filled = np.array(lines) > 0
        before = np.concatenate(([False], filled[:-1]))
        after = np.concatenate((filled[1:], [False]))
        pairs = np.concatenate([np.stack([starts, ends], axis=1)[filled],
                                np.stack([starts[filled & ~before], ends[filled & ~after]], axis=1),
                                np.array([[0, len(ids)]])])
        pairs = np.unique(pairs, axis=0)
        pairs = pairs[pairs[:, 1] - pairs[:, 0] > 1]
        return pairs[:, 0], pairs[:, 1]

    def match(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, dice, first word, words) of the best segment for each license."""
        get = self.number.get
        ids_list, lines = [], []
        for line in text.split("\n"):
            words = [get(w, 0) for w in normal_words(line)]
            lines.append(len(words))
            ids_list += words
        ids = np.array(ids_list, dtype=np.int64)
        if len(ids) < 2:
            return []
        keys = ids[:-1] * self.base + ids[1:]
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        hit = np.zeros(len(keys), dtype=np.int64)
        hit[both] = np.isin(keys[both], self.bigrams)
        if not hit.any():
            return []
        total = np.concatenate(([0], np.cumsum(hit)))
        start, end = self.segments(ids, lines)
        size = end - start - 1
        fits = np.zeros(len(size), dtype=bool)
        for b in set(self.sizes):
            fits |= (size >= self.low * b) & (size * self.low <= b)
        fits &= total[end - 1] - total[start] >= self.low * size - 1e-9
        best: dict[str, tuple[float, int, int]] = {}
        for k in np.nonzero(fits)[0].tolist():
            a = Counter(keys[start[k]:end[k] - 1][both[start[k]:end[k] - 1]].tolist())
            for name, c, b in zip(self.names, self.counts, self.sizes):
                n = int(size[k])
                if not self.low * b <= n <= b / self.low:
                    continue
                dice = 2 * sum((a & c).values()) / (n + b)
                value = (-dice, int(start[k]), n + 1)
                if dice >= self.threshold and (name not in best or value < best[name]):
                    best[name] = value
        return [(name, -v[0], v[1], v[2]) for name, v in sorted(best.items())]

    def windows(self, words: list[str]) -> Iterator[tuple[int, float, int, int]]:
        """(template, dice, first word, words): of each first word, its most alike window if alike enough."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int64)
        if len(ids) < 2 or not len(self.caps):
            return
        # A bigram with an unknown word has no template's key.
        keys = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], -2)
        code = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
        places = np.nonzero(self.bigrams[code] == keys)[0]
        code = code[places]
        held, often = np.unique(code, return_counts=True)
        shared = np.minimum(self.caps[:, held], often).sum(axis=1)
        marked: dict[str, np.ndarray] | None = None
        for t in np.nonzero(shared >= self.least)[0].tolist():
            b, widest = self.sizes[t], int(self.sizes[t] / self.low + 1e-9)
            mine = self.caps[t, code] > 0
            p, c = places[mine], code[mine]
            # Where the same bigram stood, as often before as the template has it: windows
            # that begin at or before that place do not count this one.
            order = np.argsort(c, kind="stable")
            back = np.arange(len(c)) - self.caps[t, c[order]]
            old = np.empty(len(c), dtype=np.int64)
            old[order] = np.where((back >= 0) & (c[order][back] == c[order]), p[order][back], -1)
            most = np.zeros(len(p) + 1, dtype=np.int64)
            np.add.at(most, np.searchsorted(p, np.maximum(old + 1, p - widest + 1)), 1)
            most[1:] -= 1
            stop = np.searchsorted(p, p + widest)
            for i in np.nonzero(np.cumsum(most)[:-1] >= self.least[t])[0].tolist():
                part = slice(i, int(stop[i]))
                size = p[part] - p[i] + 1
                dice = 2 * np.cumsum(old[part] < p[i]) / (size + b)
                if dice.max() < self.threshold:
                    continue
                if self.marks is not None:
                    marked = _mark_counts(words) if marked is None else marked
                    dice = np.where(_marks_fit(marked, self.marks[t], int(p[i]), p[part] + 2), dice, 0)
                k = int(dice.argmax())
                if dice[k] >= self.threshold:
                    yield t, float(dice[k]), int(p[i]), int(size[k]) + 1

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, dice, first word, words) of the best window for each license.

        Windows are taken by Dice, then the template's length, then place; one that overlaps
        one taken before is left out.
        """
        best: dict[str, tuple[str, float, int, int]] = {}
        starts, ends = [], []  # of the windows taken, in order
        for less, _, start, n, name in sorted((-dice, -self.sizes[t], start, n, self.names[t])
                                              for t, dice, start, n in self.windows(normal_words(text))):
            k = bisect_left(starts, start + n)
            if not k or ends[k - 1] <= start:
                starts.insert(k, start)
                ends.insert(k, start + n)
                best.setdefault(name, (name, -less, start, n))
        return [best[name] for name in sorted(best)]


def _mark_counts(words: list[str]) -> dict[str, np.ndarray]:
    """Of every mark in ``words``, how often it stands before each place."""
    where: dict[str, list[int]] = {}
    for k, (w, before) in enumerate(zip(words, ["", *words])):
        if is_mark(w, before):
            where.setdefault(w, []).append(k)
    return {w: np.searchsorted(at, np.arange(len(words) + 1)) for w, at in where.items()}


def _marks_fit(counts: dict[str, np.ndarray], wanted: Counter, start: int, ends: np.ndarray) -> np.ndarray:
    """Whether the windows from ``start`` to each of ``ends`` have the template's marks."""
    fits = np.ones(len(ends), dtype=bool)
    for w in wanted.keys() | counts.keys():
        if w not in counts:
            return np.zeros(len(ends), dtype=bool)
        begin = max(0, start - 1) if w in BEFORE else start
        fits &= np.abs(counts[w][ends] - counts[w][begin] - wanted[w]) <= MARK_SLACK * wanted[w]
    return fits


SCHEMA = "id long, license string, dice double, start_word long, n_words long"


def scan(docs: DataFrame, templates=ALL, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """SCHEMA: one row for each document and license found in it, its most alike window.

    ``start_word`` counts the document's normalised words from 0.
    """
    ready = Templates(templates, threshold, marks=True)

    def run(batches):
        for ids, texts in text_slices(batches):
            rows = [(i, *found) for i, text in zip(ids, texts) for found in ready.find(text)]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.float64()),
                     pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())],
                    names=["id", "license", "dice", "start_word", "n_words"])

    return in_tasks(id_text(docs, id_col, text_col), run, SCHEMA)
