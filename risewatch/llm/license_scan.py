"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment confirms.

Texts and templates are words without case and punctuation. Every run of ``GRAM`` words is hashed; of every ``WINDOW``
consecutive hashes the least (the rightmost of equals) is a fingerprint. The inverted index maps a template's
fingerprints to template and place. A template with enough fingerprints in a text near one diagonal is aligned there,
within ``BAND`` words to either side: matches count 2, replaced or missing words -1. Coverage is the share of the
template's words that match; the span runs from the first to the last matching word, in code points.

The templates are a parameter of bounded size and travel with the task; texts are not shuffled. Null and empty texts
have no match. Overlapping matches of one template keep the better, then the earlier. Repeated rows get equal matches.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from risewatch.llm.common import hash_words, map_texts, shingles, spare

GRAM, WINDOW, BAND = 3, 3, 8
MATCH = T.StructType(
    [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)

# Public notices and statements of licenses, name -> text.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
    "one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def winnow(grams: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Flat places of the fingerprints: least of each window within a list, all of a list shorter than a window."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    best, value = np.arange(n), grams.copy()
    end = np.repeat(off[1:], np.diff(off))
    for step in range(1, window):
        ahead = np.minimum(np.arange(n) + step, n - 1)
        inside = np.arange(n) + step < end
        less = inside & (grams[ahead] <= value)
        best[less], value[less] = ahead[less], grams[ahead[less]]
    start = np.repeat(off[:-1], np.diff(off))
    full = (np.arange(n) + window <= end) | (end - start < window)
    return np.unique(best[full])


class Index:
    """Fingerprint -> (template, place) lists of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        lists = [_WORD.findall(templates[n].lower()) for n in self.names]
        flat, off = hash_words(lists)
        self.words = [flat[a:b] for a, b in zip(off[:-1], off[1:])]
        grams, goff, gown = _grams(flat, off)
        at = winnow(grams, goff)
        self.count = np.bincount(gown[at], minlength=len(self.names))
        order = np.argsort(grams[at], kind="stable")
        self.keys, self.template = grams[at][order], gown[at][order]
        self.place = (at - goff[gown[at]])[order]


def _grams(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole ``GRAM``-word runs, offsets by list, and owners."""
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    place = np.arange(len(flat)) - off[:-1][own]
    whole = place >= GRAM - 1
    own = own[whole]
    counts = np.bincount(own, minlength=len(off) - 1)
    return shingles(flat, off, GRAM)[whole], np.concatenate([[0], np.cumsum(counts)]), own


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matches, first, last + 1 matching word of the text) of the best alignment of the whole template near ``diagonal``."""
    m, width = len(template), 2 * band + 1
    score = np.zeros(width, np.int64)
    step = np.zeros((m, width), np.int8)
    shift = np.arange(width) - band + diagonal
    gaps = np.arange(width)
    for i in range(m):
        at = shift + i
        known = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[known] = text[at[known]] == template[i]
        diag = score + np.where(same, 2, -1)
        down = np.concatenate([score[1:], [-(10**6)]]) - 1  # a template word without a counterpart
        best = np.maximum(diag, down)
        reach = np.maximum.accumulate(best + gaps) - gaps  # words of the text without a counterpart
        step[i] = np.where(reach > best, 3, np.where(diag >= down, np.where(same, 1, 0), 2))
        score = reach
    j, i, matches, first, last = int(score.argmax()), m - 1, 0, -1, -1
    while i >= 0:
        kind = step[i, j]
        if kind == 3:
            j -= 1
            continue
        if kind == 1:
            matches += 1
            first = shift[j] + i
            last = max(last, first + 1)
        j += kind == 2
        i -= 1
    return matches, int(first), int(last)


def scan(texts: list[str], index: Index, least: float, share: float) -> list[list[tuple]]:
    """(template, coverage, matching words, start, end) of every text, given in lower case."""
    out: list[list[tuple]] = [[] for _ in texts]
    flat, off = hash_words([_WORD.findall(t) for t in texts])
    grams, goff, gown = _grams(flat, off)
    if not len(grams) or not len(index.keys):
        return out
    lo = np.searchsorted(index.keys, grams, "left")
    seen = np.flatnonzero(index.keys[np.minimum(lo, len(index.keys) - 1)] == grams)
    if not len(seen):
        return out
    # winnowing looks only at texts in which a key occurs
    some = np.unique(gown[seen])
    for doc in some.tolist():
        own = grams[goff[doc] : goff[doc + 1]]
        at = winnow(own, np.array([0, len(own)]))
        a, b = np.searchsorted(index.keys, own[at], "left"), np.searchsorted(index.keys, own[at], "right")
        found = defaultdict(list)
        for p, x, y in zip(at.tolist(), a.tolist(), b.tolist()):
            for k in range(x, y):
                found[int(index.template[k])].append(p - int(index.place[k]))
        spots = None
        for name, diagonals in sorted(found.items()):
            diagonals.sort()
            groups = [[diagonals[0]]]
            for d in diagonals[1:]:
                if d - groups[-1][0] <= BAND:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            kept: list[tuple] = []
            for group in groups:
                if len(group) < share * index.count[name]:
                    continue
                matches, first, last = align(flat[off[doc] : off[doc + 1]], index.words[name], sorted(group)[len(group) // 2])
                coverage = matches / len(index.words[name])
                if coverage < least:
                    continue
                if kept and first < kept[-1][3]:
                    if coverage > kept[-1][0]:
                        kept[-1] = (coverage, matches, first, last)
                else:
                    kept.append((coverage, matches, first, last))
            for coverage, matches, first, last in kept:
                if spots is None:
                    spots = [m.span() for m in _WORD.finditer(texts[doc])]
                out[doc].append((index.names[name], coverage, matches, spots[first][0], spots[last - 1][1]))
        out[doc].sort(key=lambda r: (r[3], r[0]))
    return out


def _lower(text: str) -> str:
    """Lower case of the same length, so that places stay: the few letters that grow are kept as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan_licenses(df: DataFrame, text: str, templates: dict[str, str] | None = None, least: float = 0.8, share: float = 0.3) -> DataFrame:
    """Adds ``licenses``: template, coverage, matching words and span of each match, by start, then name."""
    name = spare(df.columns, "licenses")[0]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(MATCH), False)])
    templates = TEMPLATES if templates is None else templates
    index: list[Index] = []

    def work(part, texts):
        if not index:
            index.append(Index(templates))
        found = [[dict(zip(MATCH.names, r)) for r in x] for x in scan([_lower(t) for t in texts], index[0], least, share)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, name])

    return map_texts(df, text, work, schema)
