"""License scans: rare words of templates pick candidates, alignments of their stretches confirm them.

Templates and documents are sequences of words. A match of coverage 0.8 can lack a fifth of the words of its
template only, so it holds at least one of its rarest fifth and one word; these are kept in an inverted index. Every
word of a document is looked up there. The stretches of the document with one of them, and with enough words of the
template for a match, are aligned with it; each may hold several matches. Templates under five words have to match
whole, so they are looked up by the hash of all their words. Reported are matched coverage of the template and the
span in the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame

from tallyspan.llm.common import fields, flat_map

SHINGLE, WINDOW, BAND, COVERAGE = 5, 3, 8, 0.8
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

# Notices of well-known licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return got


def _shingles(w: np.ndarray, k: int) -> np.ndarray:
    if len(w) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return h ^ (h >> np.uint64(29))


def winnow(h: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash in each window, the last of equal ones."""
    if len(h) <= window:
        return [len(h) - 1 - int(h[::-1].argmin())] if len(h) else []
    return sorted({i + window - 1 - int(h[i : i + window][::-1].argmin()) for i in range(len(h) - window + 1)})


def align(template: list[str], text: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words found in order in ``text`` with text place - template place within ``band`` of ``shift``.

    Returns that number and the first and last place of a matched word; of equal alignments the tightest.
    """
    m = len(template)
    got = (0, 0, 0)  # matched, first - last, first
    best: dict[int, tuple[int, int]] = {}  # by text place: matched, first of what ends before or there
    for i in range(m):
        row: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            a = max(best.get(j, (0, -1)), row.get(j - 1, (0, -1)))
            if template[i] == text[j]:
                before = best.get(j - 1, (0, -1))
                here = (before[0] + 1, before[1] if before[0] else j)
                got = max(got, (here[0], here[1] - j, here[1]))
                a = max(a, here)
            row[j] = a
        # What ended before the band moved on stays reachable at its lower edge.
        low = i + shift - band
        edge = max((v for k, v in best.items() if k < low), default=None)
        if edge is not None:
            row[low - 1] = max(edge, row.get(low - 1, edge))
        best = row
    return (got[0], got[2], got[2] - got[1]) if got[0] else (0, 0, -1)


def reach(template: list[str]) -> tuple[int, int]:
    """Words of a template that a match has to hold, and words of text that it may span."""
    m = len(template)
    return math.ceil(round(COVERAGE * m, 9)), m + 2 * BAND if m >= SHINGLE else m


def occurrences(template: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of disjoint matches of ``template`` in ``text``: as many as there can be.

    They are counted from the left by the earliest end. Each is then the span with most matched words between the
    one before and the next; of equal ones the tightest, then the first.
    """
    need, width = reach(template)
    masks: dict[str, int] = {}
    for i, x in enumerate(template):
        masks[x] = masks.get(x, 0) | 1 << i
    at = [(j, masks[x]) for j, x in enumerate(text) if x in masks]
    full, m = (1 << len(template)) - 1, len(template)
    steps: list[tuple[int, list[tuple[int, int]]]] = []  # by first word: (end, matched) wherever matched grows
    for k, (a, _) in enumerate(at):
        if k + need > len(at) or at[k + need - 1][0] >= a + width:
            continue
        v, top, own = full, need - 1, []  # a zero bit of v for each matched word (bit-parallel LCS)
        for j, mask in at[k : k + width]:
            if j >= a + width:
                break
            u = v & mask
            v = ((v + u) | (v - u)) & full
            n = m - v.bit_count()
            if n > top:
                top = n
                own.append((j + 1, n))
        if own:
            steps.append((a, own))
    least: list[tuple[int, int]] = []
    for k, (a, own) in enumerate(steps):
        end = own[0][0]  # never falls with a
        if (not least or a >= least[-1][1]) and (k + 1 == len(steps) or steps[k + 1][1][0][0] > end):
            least.append((a, end))
    out: list[tuple[int, int, int]] = []
    k = 0
    for i in range(len(least)):
        low, high = out[-1][2] if out else 0, least[i + 1][0] if i + 1 < len(least) else len(text)
        best = None
        while k < len(steps) and steps[k][0] < high:
            a, own = steps[k]
            k += 1
            for end, n in own:
                if a >= low and end <= high and (best is None or (n, a - end) > (best[0], best[1] - best[2])):
                    best = (n, a, end)
        out.append(best)
    return out


def _stretch(stretches: list[list[int]], low: int, high: int) -> None:
    """Adds a stretch that doesn't start before the last one, or lengthens that."""
    if stretches and low < stretches[-1][1]:
        stretches[-1][1] = high
    else:
        stretches.append([low, high])


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.ids = _Ids()
        self.words = {name: WORD.findall(t.lower()) for name, t in templates.items()}
        self.index: dict[int, dict[int, list[tuple[str, int]]]] = defaultdict(dict)  # by shingle size, by hash
        common = Counter(x for w in self.words.values() for x in set(w))
        vocabulary = {x for w in self.words.values() if len(w) >= SHINGLE for x in w}
        self.vocabulary = np.unique(self.hashes(list(vocabulary)))
        self.anchors: dict[int, list[str]] = defaultdict(list)  # templates by place in the vocabulary
        self.members: dict[str, np.ndarray] = {}
        for name, w in self.words.items():
            if not w:
                continue
            if len(w) < SHINGLE:
                h = _shingles(self.hashes(w), len(w))
                for i in winnow(h):
                    self.index[len(w)].setdefault(int(h[i]), []).append((name, i))
                continue
            # A match lacks len(w) - need words at most, so it holds one of any more of them.
            rare = sorted(w, key=lambda x: (common[x], -len(x), x))[: len(w) - reach(w)[0] + 1]
            for c in np.unique(np.searchsorted(self.vocabulary, self.hashes(rare))).tolist():
                self.anchors[c].append(name)
            self.members[name] = np.isin(self.vocabulary, self.hashes(w))
        self.known = {k: np.array(sorted(x), np.uint64) for k, x in self.index.items()}
        self.anchored = np.zeros(len(self.vocabulary), bool)
        self.anchored[list(self.anchors)] = True

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.ids[x] for x in words), np.uint64, len(words))

    def candidates(self, w: np.ndarray) -> dict[str, list[list[int]]]:
        """Stretches by template that hold all of its matches: rows of ``w`` with enough words of it, and a rare one."""
        out: dict[str, list[list[int]]] = defaultdict(list)
        for k, known in self.known.items():
            h = _shingles(w, k)
            for j in np.nonzero(np.isin(h, known))[0].tolist():
                for name, i in self.index[k][int(h[j])]:
                    _stretch(out[name], j - i, j - i + k)
        if not len(self.vocabulary):
            return out
        code = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
        at = np.nonzero(self.vocabulary[code] == w)[0]
        code = code[at]
        rare = self.anchored[code]
        places: dict[str, list[int]] = defaultdict(list)
        for j, c in zip(at[rare].tolist(), code[rare].tolist(), strict=True):
            for name in self.anchors[c]:
                places[name].append(j)
        for name, held in places.items():
            need, width = reach(self.words[name])
            own = at[self.members[name][code]]
            if len(own) < need:
                continue
            first = own[: len(own) - need + 1]
            first = first[own[need - 1 :] < first + width]
            # Of those only the ones with a rare word in reach.
            held = np.array(held)
            k = np.searchsorted(held, first)
            first = first[(k < len(held)) & (held[np.minimum(k, len(held) - 1)] < first + width)]
            for j in first.tolist():
                _stretch(out[name], j, min(len(w), j + width))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """(license, coverage, first word, end word, first character, end character), in order of place and name."""
        low = (text or "").lower()
        words = WORD.findall(low)
        w = self.hashes(words)
        found = set()
        for name, stretches in self.candidates(w).items():
            template = self.words[name]
            for lo, hi in stretches:
                for n, a, b in occurrences(template, words[lo:hi]):
                    found.add((name, n / len(template), lo + a, lo + b))
        if not found:
            return []
        if len(low) != len(text):  # lower case may change lengths; spans are of the text itself
            spans = [m.span() for m in WORD.finditer(text)]
            spans = spans if len(spans) == len(words) else [m.span() for m in WORD.finditer(low)]
        else:
            spans = [m.span() for m in WORD.finditer(low)]
        return [(name, c, a, b, spans[a][0], spans[b - 1][1]) for name, c, a, b in sorted(found, key=lambda x: (x[2], x[3], x[0]))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word, start_char, end_char), a row for each match.

    Ends are exclusive. Null and empty texts match nothing; repeated rows repeat their matches; several
    templates may match one place. A very long text is held whole with its words; only stretches with template words are aligned.
    Only the two named columns are read, so others may have any name. A match holds 0.8 of a template's words in order and spans at most 16 words more than
    the template has, wherever the edits are; templates under five words match whole.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = dict(docs.select(doc).dtypes)[doc]
    out = fields(doc_id="string" if kind == "string" else "long", license="string", coverage="double", start_word="long", end_word="long", start_char="long", end_char="long")

    def make():
        s = Scanner(chosen)

        def run(ids, texts):
            rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in s.scan(t)]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in out.fields]

        return run

    return flat_map(docs, [doc, text], out, make)
