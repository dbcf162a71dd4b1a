"""License texts in documents: winnowed fingerprints, then banded alignment.

The templates' runs of words are hashed, the least hash of each window of runs is
kept, and an inverted index leads from it to templates and places. Documents are
winnowed alike, so a passage that a document shares with a template has a common
fingerprint if it is long enough. Fingerprints on nearby diagonals make a
candidate, and an alignment inside a band around them tells which words match:
how much of the template is covered, and where in the document.
"""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 3  # words of a fingerprint
WINDOW = 3  # runs of which the least is kept: a shared passage of five words is found
BAND = 8  # words that a passage may be shifted by gaps
COVERAGE = 0.7  # of a template's words that must match
LONG = 40  # words, from which on the ends of a template may be missing
_MATCH, _OTHER, _GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Words that tell a license from its relatives, as numbers do. In a passage
# they must be those of the template: none missing, none besides.
_TELLING = frozenset("affero lesser noncommercial noderivatives noderivs sharealike nc nd sa".split())

# Notices and texts of public licenses, shortened where they name people.
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
_OR_LATER = " as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_COMMONS = "This work is licensed under a Creative Commons {} 4.0 International License."
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
TEMPLATES = {
    "AGPL-3.0-header": _FREE + "Affero General Public License" + _OR_LATER.format("3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause": _TWO_CLAUSES,
    "BSD-3-Clause": _TWO_CLAUSES + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": _COMMONS.format("Attribution"),
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-text": _COMMONS.format("Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-text": _COMMONS.format("Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-text": _COMMONS.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-text": _COMMONS.format("Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-text": _COMMONS.format("Attribution-ShareAlike"),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0-header": _FREE + "General Public License" + _OR_LATER.format("2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _FREE + "General Public License" + _OR_LATER.format("3"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-header": _FREE + "Lesser General Public License" + _OR_LATER.format("2.1"),
    "LGPL-3.0-header": _FREE + "Lesser General Public License" + _OR_LATER.format("3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
}


def tells(word: str) -> bool:
    """Whether a word tells a license from its relatives."""
    return word in _TELLING or word.isdigit()


def winnow(ids: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints kept of a sequence of word numbers, and their hashes."""
    if len(ids) < run:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(ids) - run + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(run):
        hashes = (hashes ^ ids[i : i + n].astype(np.uint64)) * _MIX
        hashes ^= hashes >> np.uint64(29)
    if n <= window:
        places = np.array([int(hashes.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(hashes, window)
        places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return places, hashes[places]


class Index:
    """Templates as word numbers, and their fingerprints by hash."""

    def __init__(self, templates: dict[str, str]):
        words = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
        self.numbers = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws}), start=1)}
        self.templates = {name: np.array([self.numbers[w] for w in ws]) for name, ws in words.items()}
        self.places = defaultdict(list)
        for name, ids in self.templates.items():
            for place, value in zip(*winnow(ids), strict=True):
                self.places[int(value)].append((name, int(place)))
        self.known = np.array(sorted(self.places), dtype=np.uint64)
        # Words that tell a license from others have numbers of their own, also where no template has them.
        for word in sorted(_TELLING):
            self.numbers.setdefault(word, len(self.numbers) + 1)
        self.telling = {n for w, n in self.numbers.items() if tells(w)}

    def number(self, word: str) -> int:
        """A word's number: 0 if it is in no template, -1 if it still tells a license from others."""
        return self.numbers.get(word) or -int(word.isdigit())

    def candidates(self, ids: np.ndarray) -> list[tuple[str, int, int]]:
        """(template, least and largest diagonal) of fingerprints that lie together.

        A diagonal is a place in the document less the place in the template.
        """
        found = defaultdict(set)
        places, hashes = winnow(ids)
        shared = np.isin(hashes, self.known)
        for place, value in zip(places[shared].tolist(), hashes[shared].tolist(), strict=True):
            for name, at in self.places[value]:
                found[name].add(place - at)
        out = []
        for name, diagonals in found.items():
            first = last = None
            for d in sorted(diagonals):
                if last is not None and d - first <= BAND:
                    last = d
                    continue
                if last is not None:
                    out.append((name, first, last))
                first = last = d
            out.append((name, first, last))
        return out


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]] | None:
    """Best local alignment with document places within diagonals low to high.

    Returns the places of matched words in the template and in the document, in order,
    None if no word matches. Of equal scores the one that ends first is taken.
    """
    width = high - low + 1
    offsets = np.arange(width)
    above, steps, best, end = np.zeros(width + 1, dtype=np.int64), [], 0, None
    for i in range(len(template)):
        at = i + low + offsets  # the document places that are compared
        inside = (at >= 0) & (at < len(ids))
        same = np.zeros(width, dtype=bool)
        same[inside] = ids[at[inside]] == template[i]
        both = np.where(inside, above[:width] + np.where(same, _MATCH, _OTHER), -1)
        skipped = np.append(above[1:width] + _GAP, 0)  # a word of the template without a partner
        score = np.maximum(np.maximum(both, skipped), 0)
        # A word of the document without a partner comes from the cell before, as often as pays.
        run = np.maximum.accumulate(score - _GAP * offsets) + _GAP * offsets
        score = np.where(inside, run, score)
        steps.append(np.where(score <= 0, 0, np.where(score == both, 1, np.where(score == skipped, 2, 3))).astype(np.int8))
        if score.max(initial=0) > best:
            best, end = int(score.max()), (i, int(score.argmax()))
        above = np.append(score, 0)
    if end is None:
        return None
    i, k = end
    ours, theirs = [], []
    while i >= 0 and steps[i][k]:
        if steps[i][k] == 1:
            if template[i] == ids[i + low + k]:
                ours.append(i)
                theirs.append(i + low + k)
            i -= 1
        elif steps[i][k] == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return (ours[::-1], theirs[::-1]) if ours else None


def _telling_alike(template: np.ndarray, part: np.ndarray, ours: list[int], theirs: list[int], telling: set[int]) -> bool:
    """Whether the passage has the words that tell its license from others, all of them and no other.

    The ends of a long template may be missing from the passage.
    """
    first, last = (0, len(template) - 1) if len(template) < LONG else (ours[0], ours[-1])
    matched = set(ours)
    if any(int(template[i]) in telling and i not in matched for i in range(first, last + 1)):
        return False
    known = set(theirs)
    return not any((int(part[j]) in telling or part[j] < 0) and j not in known for j in range(theirs[0], theirs[-1] + 1))


def scan(text: str | None, index: Index, coverage: float = COVERAGE, find=None) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and end character) of the passages found,
    in order of their place. A passage must have the words and numbers that tell its
    license from its relatives, and no others of them. Of passages that overlap, the one
    with more matched words stays, then the better covered, then the first by name."""
    if not text:
        return []
    lower = text.lower()
    ids = np.array([index.number(w) for w in _WORD.findall(lower)])
    aligned = set()
    for name, low, high in (find or index.candidates)(ids):
        template = index.templates[name]
        start = max(0, low - BAND)
        part = ids[start : max(0, high + len(template) + BAND)].copy()
        # A candidate may hold the template more than once.
        while (hit := align(template, part, low - BAND - start, high + BAND - start)) and len(hit[0]) >= coverage * len(template):
            ours, theirs = hit
            if _telling_alike(template, part, ours, theirs, index.telling):
                aligned.add((-len(ours), -len(ours) / len(template), name, start + theirs[0], start + theirs[-1]))
            part[theirs[0] : theirs[-1] + 1] = 0
    kept = []
    for matched, share, name, first, last in sorted(aligned):
        if all(last < other[3] or first > other[4] for other in kept):
            kept.append((name, -share, -matched, first, last))
    if not kept:
        return []
    # Lower case can be longer than the text, so places come from the text itself.
    spans = [m.span() for m in _WORD.finditer(text if len(lower) == len(text) else lower)]
    return [(name, share, matched, spans[first][0], spans[last][1]) for name, share, matched, first, last in sorted(kept, key=lambda x: x[3])]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, span_start, span_end), one row per passage.

    Spans are characters of the whole text, the end excluded. Documents without a
    license, NULL and empty texts have no row; repeated rows are scanned each; other
    columns are left out; an empty table gives an empty result.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        index = Index(known)
        for batch in batches:
            rows = [(k, *hit) for k, t in zip(batch["k"], batch["t"], strict=True) for hit in scan(t, index, coverage)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "matched_words", "span_start", "span_end"])

    schema = "doc_id long, license string, coverage double, matched_words int, span_start long, span_end long"
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)
