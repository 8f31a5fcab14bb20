"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are short, so their index is a table of some hundred fingerprints that every task holds.
Texts are scanned whole: each run of ``K`` words is looked up in the index (of ``SHORT_K`` words for notices so short that a changed word
may leave no longer run); the hits of a template on close diagonals are one candidate. Where the words around it can reach
the coverage at all, they are aligned to the template inside a band around the diagonals. A candidate's window is as long as the
template and three bands, whatever the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .arrowtext import Words, slices, split_words, windows

#: Words in a fingerprint; fingerprints of which one is kept; half width of the band, in words.
K, WINNOW, BAND = 3, 4, 8
#: Words in a fingerprint of templates of at most SHORT words, and hits that make a candidate of one.
SHORT, SHORT_K, SHORT_HITS = 5, 2, 2
MIN_COVERAGE = 0.8
SIGNS = ".,;:()[]\"'*#/-"

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
# License notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-text": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. " + _BSD_END,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Licensed under the ISC License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
}
for _kind, _long in (
    ("", "Attribution"), ("-SA", "Attribution-ShareAlike"), ("-NC", "Attribution-NonCommercial"), ("-ND", "Attribution-NoDerivatives"),
    ("-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _v in ("2.0", "3.0", "4.0"):
        TEMPLATES[f"CC-BY{_kind}-{_v}"] = f"Licensed under CC BY{_kind} {_v}."
        TEMPLATES[f"CC-BY{_kind}-{_v}-notice"] = f"This work is licensed under a Creative Commons {_long} {_v} International License."
for _name, _long, _versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
    for _v in _versions:
        _id = f"{_name}-{_v}" if "." in _v else f"{_name}-{_v}.0"
        TEMPLATES[_id] = f"This work is licensed under the GNU {_long}General Public License, version {_v}."
        TEMPLATES[f"{_id}-notice"] = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_long}General Public License as published by "
            f"the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        )

#: Words that tell licenses apart; a number tells versions apart if it follows one of AFTER or has a point.
DECIDING = re.compile(r"lesser|library|affero|gnu|apache|mozilla|boost|eclipse|mit|isc|bsd|[23]-clause|cc0|by(?:-(?:nc|sa|nd))*|attribution[a-z-]*|non-?commercial|share-?alike|no-?derivatives")
NUMBER, AFTER = re.compile(r"v?\d+(?:\.\d+)*"), frozenset(["version", "v", "license", "by", "cc0"])


def _plain(words: Words) -> Words:
    """Words without signs at their ends."""
    return Words(words.offsets, words.codes, pc.utf8_trim(words.vocab, SIGNS))


def _texts(words: Words, doc: int = 0, start: int = 0, end: int | None = None) -> list[str]:
    return words.vocab.take(pa.array(words.codes[words.offsets[doc] : words.offsets[doc + 1]][start:end])).to_pylist()


def winnow(h: np.ndarray, window: int) -> list[int]:
    """Positions of the rightmost smallest hash of each run of ``window``; all if there are fewer."""
    if len(h) <= window:
        return list(range(len(h)))
    return sorted({i + window - 1 - int(np.argmin(h[i : i + window][::-1])) for i in range(len(h) - window + 1)})


@dataclass(frozen=True)
class Index:
    """Templates and, for each length of fingerprints, their sorted distinct values with the (template, position) of each."""

    names: list[str]
    hashes: list[np.ndarray]
    wanted: list[set[str]]
    prints: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(maxsize=8)
def template_index(items: tuple[tuple[str, str], ...]) -> Index:
    words = _plain(split_words(pa.array([t for _, t in items], pa.string()), lower=True))
    each, prints = words.hashes(), {}
    for k in (SHORT_K, K):
        owner, at, h = windows(words, k)
        found = []
        for t in np.flatnonzero((words.counts <= SHORT) == (k == SHORT_K)):
            mine = np.flatnonzero(owner == t)
            window = WINNOW if len(mine) > 3 * WINNOW else 1  # short notices keep every fingerprint
            found += [(int(h[mine[i]]), int(t), int(at[mine[i]] - words.offsets[t])) for i in winnow(h[mine], window)]
        found.sort()
        value = np.array([x for x, *_ in found], np.uint64)
        distinct, first = np.unique(value, return_index=True)
        prints[k] = (distinct, np.append(first, len(value)), np.array([t for _, t, _ in found], int), np.array([p for *_, p in found], int))
    hashes = [each[words.offsets[t] : words.offsets[t + 1]] for t in range(len(items))]
    return Index([n for n, _ in items], hashes, [deciding(_texts(words, t)) for t in range(len(items))], prints)


def deciding(words: list[str]) -> set[str]:
    """The deciding words and version numbers (as 3 for 3.0) among plain words."""
    out = set()
    for before, w in zip(["", *words], words, strict=False):
        if NUMBER.fullmatch(w) and ("." in w or w[0] == "v" or before in AFTER):
            out.add(re.sub(r"(\.0)+$", "", w.removeprefix("v")))
        elif DECIDING.fullmatch(w) and not (w == "by" and before != "cc"):
            out.add(w)
    return out


def best_aligned(found: list[tuple[int, str, int, int, int, int]]) -> list[tuple[int, str, int, int, int, int]]:
    """Of matches that overlap in a text, the one with most matched words over missing ones."""
    kept: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out = []
    for m in sorted(found, key=lambda m: (m[0], m[3] - 2 * m[2], m[1], m[4])):
        if all(m[5] <= a or m[4] >= b for a, b in kept[m[0]]):
            kept[m[0]].append((m[4], m[5]))
            out.append(m)
    return sorted(out)


def align(template: np.ndarray, text: np.ndarray, band: int = BAND) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best alignment of a template to a part of ``text``.

    Text before and after is free; a match scores 1, a replaced, missing or added word -1. Cells further
    than ``band`` from the diagonal, counted from any start in the text's slack, aren't computed. A row of cells is computed at once.
    """
    n, m = len(template), len(text)
    slack, place = max(0, m - n) + band, np.arange(m + 1)
    score, start, hits = np.zeros(m + 1, int), place, np.zeros(m + 1, int)
    for i in range(1, n + 1):
        same = np.concatenate(([False], text == template[i - 1]))
        across = np.concatenate(([-n - m], score[:-1])) + np.where(same, 1, -1)
        take = across >= score - 1
        best = np.where(take, across, score - 1)
        s = np.where(take, np.concatenate(([0], start[:-1])), start)
        k = np.where(take, np.concatenate(([0], hits[:-1])) + same, hits)
        best[(place < i - band) | (place > i + slack)] = -2 * (n + m)
        # added words: the best cell to the left, one less for each word between
        left = np.maximum.accumulate(best + place)
        source = np.maximum.accumulate(np.where(best + place == left, place, 0))
        score, start, hits = left - place, s[source], k[source]
    end = int(np.argmax(score))
    return int(score[end]), int(hits[end]), int(start[end]), end


def _seeds(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, template, diagonal) of each place where a fingerprint of a template occurs, in this order."""
    out = [(np.zeros(0, int),) * 3]
    for k, (prints, first, template, place) in index.prints.items():
        owner, at, h = windows(words, k)
        if not len(prints) or not len(h):
            continue
        where = np.minimum(np.searchsorted(prints, h), len(prints) - 1)
        hit = np.flatnonzero(prints[where] == h)
        lo, n = first[where[hit]], np.diff(first)[where[hit]]
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hit = np.repeat(hit, n)
        out.append((owner[hit], template[entry], at[hit] - words.offsets[owner[hit]] - place[entry]))
    doc, t, diagonal = map(np.concatenate, zip(*out, strict=True))
    order = np.lexsort((diagonal, t, doc))
    return doc[order], t[order], diagonal[order]


def scan(words: Words, templates: dict[str, str], min_coverage: float) -> list[tuple[int, str, int, int, int, int]]:
    """(text, license, matched words, template words, first word, word after the last) of each match."""
    index = template_index(tuple(sorted(templates.items())))
    words = _plain(words)
    doc, template, diagonal = _seeds(words, index)
    if not len(doc):
        return []
    each, out = words.hashes(), set()
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]))))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
        t, d = int(template[a]), int(doc[a])
        size = len(index.hashes[t])
        need, least = min_coverage * size, SHORT_HITS if SHORT_K < size <= SHORT else 1
        if b - a < least:
            continue
        body = each[words.offsets[d] : words.offsets[d + 1]]
        distinct, count = np.unique(index.hashes[t], return_counts=True)
        local = np.minimum(np.searchsorted(distinct, body), len(distinct) - 1)
        local = np.where(distinct[local] == body, local, len(distinct))
        inside = np.concatenate(([0], np.cumsum(local < len(distinct))))
        band = min(BAND, max(1, size // 3))  # so a short notice twice in a row is two matches
        i, diagonals = a, diagonal[a:b]
        while i < b:
            j = a + int(np.searchsorted(diagonals, diagonal[i] + band, "right"))  # no wider than the band
            lo, hi = max(0, int(diagonal[i]) - band), min(len(body), int(diagonal[j - 1]) + size + band)
            enough = j - i >= least and inside[hi] - inside[lo] >= need
            # no alignment matches more than the words that both have, as often as both have them
            if enough and np.minimum(np.bincount(local[lo:hi], minlength=len(distinct) + 1)[:-1], count).sum() >= need:
                _, matched, x, y = align(index.hashes[t], body[lo:hi], band)
                if matched >= need and deciding(_texts(words, d, lo + x, lo + y)) == index.wanted[t]:
                    out.add((d, index.names[t], matched, size, lo + x, lo + y))
            i = j
    return best_aligned(sorted(out))


def _scan_batches(templates: dict[str, str], min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            rows = []
            found = scan(split_words(part.column("text"), lower=True), templates, min_coverage)
            spans: dict[int, list[tuple[int, int]]] = {}
            for doc, name, matched, size, a, b in found:
                if doc not in spans:
                    spans[doc] = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", part.column("text")[doc].as_py())]
                rows.append((part.column("doc_id")[doc].as_py(), name, matched / size, matched, spans[doc][a][0], spans[doc][b - 1][1]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "coverage", "n_matched", "start", "end"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Return a row per match: doc_id, license, coverage (matched share of the template's words), n_matched, and the
    span [start, end) in code points.

    Case of A-Z and signs around words don't count. A null or empty text matches nothing; a text may match many
    templates, and one template in many places; where matches overlap the best-aligned one is left, and deciding words (names,
    versions) of the template and of the span must be the same; matches of one place on diagonals within the band are one. Repeated rows give repeated matches. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan_batches(templates or TEMPLATES, min_coverage), "doc_id long, license string, coverage double, n_matched long, start long, end long"
    )
