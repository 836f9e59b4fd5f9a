"""License scans.

Templates are winnowed into an inverted index: of every ``W`` consecutive hashes of ``K`` words
the smallest, rightmost, is kept with its place. A text's own winnowed hashes that the index has
pick candidates: a template and a diagonal. Around the diagonal a banded alignment finds the
most template words that follow in order, and a match is reported with its share of the
template's words and its characters in the text.

Templates are notices, and the full texts in ``licenses/``. Of a notice, which names its license
and version in a few words, every word must be there, with few between them; so a notice of another license isn't taken
for it, and where one notice contains another the one with more words wins. What winnowing guarantees
is a run of ``K + W - 1`` words, which notices may not have: all their grams are indexed, and looked
up wherever they stand. Of a long template those diagonals are aligned around which enough of its
selected hashes lie, the fullest first and none near another, so that the work grows with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

K, W = 3, 2
#: Words to both sides of a diagonal, and one more for each so many of the template.
BAND, PER_BAND = 6, 50
#: Share of a template's words that a match must have; of a notice of at most so many words, all.
COVERAGE, NOTICE = 0.8, 30
#: A template of more words is aligned where a text has at least this share of its selected hashes.
LONG, ANCHORED = 200, 0.1
WORD = re.compile(r"\w+(?:\.\d+)*")

#: Notices by which licenses are granted, as their stewards word them, and short forms.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "GNU GPL v3",
        "GNU GPL version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "GNU GPL v2",
        "GNU GPL version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LGPL v3", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LGPL v2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AGPL v3", "This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "proprietary": ["All rights reserved."],
}
MATCH = "array<struct<license:string,template:int,coverage:double,start:int,end:int>>"


#: Spellings that count as another.
SPELLINGS = {"licence": "license", "licenced": "licensed"}


def words_of(text: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in WORD.findall(text.lower())]


def all_templates() -> dict[str, list[str]]:
    """``TEMPLATES``, the tag of each license, and the full texts after them."""
    found = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name in found:
        if name != "proprietary":
            found[name].append(f"SPDX-License-Identifier: {name}")
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        found.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return found


class Index:
    """The templates' words, numbered from 1, and where their selected hashes stand."""

    def __init__(self, templates: dict[str, list[str]]):
        self.vocabulary: dict[str, int] = {}
        self.templates: list[tuple[str, int, np.ndarray]] = []
        self.places: dict[int, list[tuple[int, int]]] = {}
        always: set[int] = set()
        for name, texts in templates.items():
            for number, text in enumerate(texts):
                words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], "i8")
                self.templates.append((name, number, words))
        self.chosen = []
        for t, (_, _, words) in enumerate(self.templates):
            hashes = self.grams(words)
            notice = len(words) <= NOTICE
            selected = np.arange(len(hashes)) if notice else self.select(hashes)
            if notice:
                always.update(hashes.tolist())
            self.chosen.append(len(selected))
            for at in selected:
                self.places.setdefault(int(hashes[at]), []).append((t, int(at)))
        self.always = np.array(sorted(always), "u8")

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Hashes of ``K`` words; the largest where a word is in no template."""
        if len(words) < K:
            return np.zeros(0, "u8")
        runs = np.lib.stride_tricks.sliding_window_view(words, K)
        code = runs[:, 0].astype("u8")
        for i in range(1, K):
            code = code * np.uint64(len(self.vocabulary) + 1) + runs[:, i].astype("u8")
        code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return np.where((runs > 0).all(axis=1), code ^ (code >> np.uint64(31)), np.uint64(2**64 - 1))

    def select(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the smallest hash of each window, rightmost of several."""
        if not len(hashes):
            return np.zeros(0, "i8")
        span = min(W, len(hashes))
        windows = np.lib.stride_tricks.sliding_window_view(hashes, span)
        return np.unique(np.arange(len(windows)) + span - 1 - np.argmin(windows[:, ::-1], axis=1))

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """Matches with enough of a template's words, by place; of overlapping ones that with the most words stays."""
        lower = (text or "").lower()
        if len(lower) != len(text or ""):  # places are those of the text itself
            lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        number = self.vocabulary.get
        words = np.fromiter((number(SPELLINGS.get(w, w), 0) for w in WORD.findall(lower)), "i8")
        hashes = self.grams(words)
        known = np.flatnonzero(hashes != np.uint64(2**64 - 1))
        if not len(known):
            return []
        # Only windows with a known gram can select one.
        near = np.unique((known[:, None] + np.arange(1 - W, W)).ravel())
        near = near[(near >= 0) & (near < len(hashes))]
        chosen = set(known[np.isin(hashes[known], self.always)].tolist())
        for part in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
            chosen.update((self.select(hashes[part[0] : part[-1] + 1]) + part[0]).tolist())
        diagonals: dict[int, list[tuple[int, int]]] = {}
        for at in sorted(chosen):
            for t, place in self.places.get(int(hashes[at]), ()):
                diagonals.setdefault(t, []).append((at, at - place))
        if not diagonals:
            return []
        spans = [m.span() for m in WORD.finditer(lower)]
        found = []
        for t, anchors in diagonals.items():
            name, no, template = self.templates[t]
            band, share = (len(template) // 8, 1.0) if len(template) <= NOTICE else (BAND + len(template) // PER_BAND, COVERAGE)
            if len(template) > LONG:
                starts = [(0, offset) for offset in full_diagonals(np.array([o for _, o in anchors]), band, ANCHORED * self.chosen[t])]
            else:
                starts = None
            first, last, tried = -1, -1, set()
            for at, offset in anchors if starts is None else starts:
                low = 0 if starts is not None or at <= last else last + 1  # a match that follows another has words of its own
                if starts is None and (first <= at <= last or (offset, low) in tried):
                    continue
                tried.add((offset, low))
                matched = align(template, words, offset, band, low)
                if len(matched) >= share * len(template):
                    first, last = matched[0], matched[-1]
                    found.append((len(matched), name, no, len(matched) / len(template), spans[matched[0]][0], spans[matched[-1]][1]))
        kept: list[tuple[str, int, float, int, int]] = []
        for _, name, no, share, start, end in sorted(found, key=lambda m: (-m[0], m[4], m[1], m[2])):
            if all(end <= s or start >= e for _, _, _, s, e in kept):
                kept.append((name, no, share, start, end))
        return sorted(kept, key=lambda m: m[3])


def full_diagonals(offsets: np.ndarray, band: int, least: float) -> list[int]:
    """Diagonals with at least so many anchors within ``band``, the fullest first, none within ``band`` of one before."""
    offsets = np.sort(offsets)
    each = np.unique(offsets)
    n = np.searchsorted(offsets, each + band, "right") - np.searchsorted(offsets, each - band, "left")
    enough = n >= least
    each, n = each[enough], n[enough]
    out: list[int] = []
    for offset in each[np.lexsort((each, -n))].tolist():
        if all(abs(offset - o) > band for o in out):
            out.append(offset)
    return out


def align(template: np.ndarray, words: np.ndarray, offset: int, band: int, low: int = 0) -> list[int]:
    """Places, from ``low``, of the text's words in the longest common subsequence with the template within ``band`` of the diagonal ``offset``."""
    width = 2 * band + 1
    best = np.zeros((len(template) + 1, width + 1), "i4")  # column c of row i stands for the text's word i - 1 + offset + c - band
    at = np.arange(offset - band, offset + band + len(template))
    seen = np.where((at >= low) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], -1)
    for i in range(1, len(template) + 1):
        above = best[i - 1]
        same = seen[i - 1 : i - 1 + width] == template[i - 1]
        best[i, :width] = np.maximum.accumulate(np.maximum(np.append(above[1:width], 0), np.where(same, above[:width] + 1, 0)))
    i, c, out = len(template), width - 1, []
    while i > 0 and c >= 0 and best[i][c]:
        if c and best[i][c] == best[i][c - 1]:
            c -= 1
        elif c + 1 < width and best[i][c] == best[i - 1][c + 1]:
            i, c = i - 1, c + 1
        else:
            out.append(i - 1 + offset + c - band)
            i -= 1
    return out[::-1]


def matches(text: Column, templates: dict[str, list[str]] | None = None) -> Column:
    """The matches in each text as an array of license, template number, coverage, and first and end character; empty for null and for texts without one."""
    chosen = templates or all_templates()

    @F.pandas_udf(MATCH)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(chosen)
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "template", "coverage", "start", "end"), m, strict=True)) for m in index.scan(t)] for t in texts])

    return scan(text)
