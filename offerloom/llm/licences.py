"""Licence scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Hits near one diagonal are aligned in a band around it. Where words were put in or cut out, the hits of one copy
lie on several diagonals: these are chained in text order, and one alignment follows the band from diagonal to
diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import digest, query, share, small, table, worker_value
from offerloom.llm.words import slices, windows, words

GRAM = 3  # words of a fingerprint
WINNOW = 3  # of so many neighbouring fingerprints the least is kept: a shared run of GRAM + WINNOW - 1 words is always seen
BAND = 8  # words that a match may shift by insertions and deletions, a quarter of the template at most
LEAST_SHARE = 0.1  # share of a template's fingerprints that a candidate place has at least
COVERAGE = 0.8  # share of the template's words that must match
BLOCK_WORDS = 200_000  # words of templates that a pass over the documents holds; more templates take more passes
MATCH, MISS, GAP = 2, -1, -1
JUMP = -8  # a longer insertion or cut costs this once
LONGEST_INSERT = 32  # words between two parts of a copy: so many, or as many as the template has

# Notices and grants of public licences.
LICENCES = [
    ("MIT-notice", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0-head", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0-head", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MIT-spdx", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


def winnow(values: np.ndarray, doc: np.ndarray, gram: int = GRAM, window: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, first word) of the kept word grams: the least of every *window* neighbours of a text, the
    later one of equals; all grams of texts with fewer."""
    h, at = windows(values, doc, gram)
    n = len(h)
    if not n:
        return h, at
    owner = doc[at]
    keep = np.bincount(owner)[owner] < window
    if n >= window:
        whole = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        stack = np.stack([h[whole + k] for k in reversed(range(window))], 1)
        keep[whole + window - 1 - stack.argmin(1)] = True
    return h[keep], at[keep]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1 word of the text) of the best local alignment of the two sequences near
    the diagonal text = template + *shift*."""
    rows, width = len(template), 2 * band + 1
    offsets = np.arange(width)
    score = np.zeros((rows + 1, width), np.int32)
    for i in range(rows):
        place = i + shift - band + offsets
        inside = (place >= 0) & (place < len(text))
        same = inside & (text[np.clip(place, 0, max(0, len(text) - 1))] == template[i]) if len(text) else inside
        row = score[i] + np.where(same, MATCH, MISS)
        row[:-1] = np.maximum(row[:-1], score[i, 1:] + GAP)
        row = np.where(inside, np.maximum(row, 0), 0)
        score[i + 1] = np.maximum(row, np.maximum.accumulate(row - GAP * offsets) + GAP * offsets) * inside
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    matched, first, last = 0, 0, 0
    while i > 0 and score[i, j] > 0:
        place = i - 1 + shift - band + j
        same = text[place] == template[i - 1]
        if score[i, j] == score[i - 1, j] + (MATCH if same else MISS):
            if same:
                matched, first, last = matched + 1, place, last or place + 1
            i -= 1
        elif j + 1 < width and score[i, j] == score[i - 1, j + 1] + GAP:
            i, j = i - 1, j + 1
        elif j > 0 and score[i, j] == score[i, j - 1] + GAP:
            j -= 1
        else:
            break
    return matched, int(first), int(last)


def covered(word: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words lie in one of the spans (first, last + 1), given in order."""
    if not spans:
        return np.zeros(len(word), bool)
    ends = np.maximum.accumulate([b for _, b in spans])
    at = np.searchsorted([a for a, _ in spans], word, side="right") - 1
    return (at >= 0) & (word < ends[at])


def align_chain(template: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, last + 1 word of the text) of the best local alignment in which word i of the template
    stands at places i + low[i] to i + high[i] of the text. A gap costs GAP a word, JUMP at most."""
    rows, n = len(template), len(text)
    places = np.arange(n + 1)
    score = np.zeros((rows + 1, n + 1), np.int32)  # score[i, p]: an alignment that ends before word i and place p
    above = np.zeros(n + 1, np.int32)  # best of all rows so far
    for i in range(rows):
        row = np.maximum(0, np.maximum(score[i] + GAP, above + JUMP))
        row[1:] = np.maximum(row[1:], score[i, :-1] + np.where(text == template[i], MATCH, MISS))
        row *= (places > i + low[i]) & (places <= i + high[i] + 1)
        row = np.maximum(np.maximum.accumulate(row - GAP * places) + GAP * places, np.maximum.accumulate(row) + JUMP)
        score[i + 1] = np.maximum(row, 0)
        above = np.maximum(above, score[i + 1])
    i, p = np.unravel_index(int(score.argmax()), score.shape)
    matched, first, last = 0, 0, 0
    while i > 0 and score[i, p] > 0:
        here = score[i, p]
        inside = i - 1 + low[i - 1] < p <= i + high[i - 1]
        if inside and p > 0 and here == score[i - 1, p - 1] + (MATCH if text[p - 1] == template[i - 1] else MISS):
            if text[p - 1] == template[i - 1]:
                matched, first, last = matched + 1, p - 1, last or p
            i, p = i - 1, p - 1
            continue
        up = np.flatnonzero(score[:i, p] + np.maximum(GAP * (i - np.arange(i)), JUMP) == here) if inside else ()
        if len(up):
            i = int(up[-1])
            continue
        left = np.flatnonzero(score[i, :p] + np.maximum(GAP * (p - np.arange(p)), JUMP) == here)
        if not len(left):
            break
        p = int(left[-1])
    return matched, int(first), int(last)


def chains(place: np.ndarray, word: np.ndarray, rows: int) -> list[np.ndarray]:
    """Chains of fingerprint hits (place in the template, word of the text), as indices of hits in text order.

    A hit follows the one that gives it the best chain among those before it in the template of *rows* words and in
    the text, with at most LONGEST_INSERT or *rows* words put in; a change of diagonal costs up to one hit. A hit is in one chain at most: chains are
    taken in descending worth.
    """
    order = np.lexsort((place, word))
    place, word = place[order], word[order]
    shift, n, longest = word - place, len(word), max(LONGEST_INSERT, rows)
    low = np.searchsorted(word, word - longest - rows)
    worth, before = np.ones(n), np.full(n, -1)
    for k in range(n):
        near = slice(low[k], k)
        gain = np.where((place[near] < place[k]) & (word[near] < word[k]) & (shift[k] - shift[near] <= longest), worth[near] - np.minimum(abs(shift[near] - shift[k]), -JUMP) / -JUMP, 0)
        if len(gain) and gain.max() > 0:
            before[k] = low[k] + len(gain) - 1 - gain[::-1].argmax()
            worth[k] = 1 + gain.max()
    used, out = np.zeros(n, bool), []
    for k in np.argsort(-worth, kind="stable").tolist():
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = before[k]
        if len(chain) > 1:
            out.append(order[chain[::-1]])
    return out


def chain_band(place: np.ndarray, shift: np.ndarray, rows: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest shift of every word of a template: the band around the diagonals of the two hits it lies
    between, or of the first or last hit."""
    after = np.searchsorted(place, np.arange(rows), side="right")
    one, two = shift[np.maximum(after - 1, 0)], shift[np.minimum(after, len(shift) - 1)]
    return np.minimum(one, two) - band, np.maximum(one, two) + band


class Index:
    """Inverted index from fingerprints to (template, word)."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        w = words([text for _, text in templates])
        bounds = np.searchsorted(w.doc, np.arange(len(templates) + 1))
        self.names = [name for name, _ in templates]
        self.values = [w.value[a:b] for a, b in zip(bounds, bounds[1:])]
        self.band = np.clip(np.array([len(v) for v in self.values]) // 4, 1, BAND)
        h, at = winnow(w.value, w.doc)
        order = np.argsort(h, kind="stable")
        self.h, at = h[order], at[order]
        self.template = w.doc[at]
        self.place = at - bounds[self.template]
        self.least = np.maximum(1, np.ceil(LEAST_SHARE * np.bincount(self.template, minlength=len(templates)))).astype(np.int64)

    def matches(self, texts: list[str], coverage: float = COVERAGE) -> list[tuple[int, str, int, int, int, int]]:
        """(text, licence, start, end, matched words, template words) of every matched span, in code points."""
        w = words(texts)
        h, at = winnow(w.value, w.doc)
        low, high = np.searchsorted(self.h, h, side="left"), np.searchsorted(self.h, h, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        count = (high - low)[hit]
        entry = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        word = np.repeat(at[hit], count)
        template = self.template[entry]
        shift = word - self.place[entry]  # where the template's first word would stand, among all words
        order = np.lexsort((shift, template, w.doc[word]))
        doc, template, shift, word = w.doc[word][order], template[order], shift[order], word[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (np.diff(shift) > self.band[template[1:]])])
        starts = np.flatnonzero(new)
        found, spans = set(), {}
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(new)).tolist()):
            t, d = int(template[s]), int(doc[s])
            if e - s < self.least[t]:
                continue
            a, b = np.searchsorted(w.doc, [d, d + 1])
            own, band = self.values[t], int(self.band[t])
            middle = int(shift[(s + e) // 2])
            begin = max(int(a), middle - band)
            matched, first, last = align(own, w.value[begin : min(int(b), middle + len(own) + band + 1)], middle - begin, band)
            if matched >= coverage * len(own):
                found.add((d, self.names[t], int(w.start[begin + first]), int(w.end[begin + last - 1]), matched, len(own)))
                spans.setdefault((d, t), []).append((begin + first, begin + last))
        pairs = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])]))
        for s, e in zip(pairs.tolist(), np.append(pairs[1:], len(doc)).tolist()):
            t, d = int(template[s]), int(doc[s])
            held = sorted(spans.get((d, t), []))
            left = s + np.flatnonzero(~covered(word[s:e], held))
            least = max(2, int(self.least[t]))
            if len(left) < least:
                continue
            own, band = self.values[t], int(self.band[t])
            a, b = (int(x) for x in np.searchsorted(w.doc, [d, d + 1]))
            place = word[left] - shift[left]
            for chain in chains(place, word[left], len(own)):
                if len(chain) < least or covered(word[left][chain], held).all():
                    continue
                low, high = chain_band(place[chain], shift[left][chain], len(own), band)
                begin, end = max(a, int(low[0])), min(b, len(own) + int(high[-1]))
                matched, first, last = align_chain(own, w.value[begin:end], low - begin, high - begin)
                if matched >= coverage * len(own):
                    found.add((d, self.names[t], int(w.start[begin + first]), int(w.end[begin + last - 1]), matched, len(own)))
                    held = sorted([*held, (begin + first, begin + last)])
        return sorted(found)


SCHEMA = "doc_id long, licence string, start long, end long, matched_words int, template_words int, coverage double"


def _scan(shared, key: str, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_value("licences", key, lambda: Index(shared.value))
        for batch in small(batches):
            ids, texts = batch.columns
            for begin, part in slices(texts.to_pylist()):
                found = index.matches(part, coverage)
                if found:
                    doc, name, start, end, matched, size = zip(*found)
                    columns = [ids.take(pa.array(np.array(doc) + begin)), pa.array(name), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(matched, pa.int32()), pa.array(size, pa.int32()), pa.array(np.array(matched) / np.array(size))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return run


def licence_spans(docs: DataFrame, templates: Sequence[tuple[str, str]] = LICENCES, coverage: float = COVERAGE) -> DataFrame:
    """One row per span of a document of (doc_id, text) that matches a template's words at *coverage* or more.

    A copy may have words put in, up to LONGEST_INSERT or the template's length at one place, or cut out. Words are compared without case and punctuation. Templates of fewer than GRAM words have no fingerprint and
    are refused. The templates are a stated set, dealt to passes of BLOCK_WORDS words, so a worker's index is
    bounded. Null and empty texts have no span; repeated rows and null ids have rows of their own. A span that
    several templates share is reported for each. An empty table gives an empty result.
    """
    blocks, held = [[]], 0
    for name, text in templates:
        size = len(words([text]).doc)
        if size < GRAM:
            raise ValueError(f"template {name!r} is shorter than {GRAM} words")
        if held + size > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((name, text))
        held += size
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return reduce(DataFrame.unionAll, [plain.mapInArrow(_scan(share(docs.sparkSession, b), digest(b), coverage), SCHEMA) for b in blocks])


@query("op2_licence_scan")
def op2(spark, sf_dir):
    return licence_spans(table(spark, sf_dir, "documents"))
