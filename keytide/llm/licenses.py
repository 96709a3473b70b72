"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into words (ASCII letters in lower case, digits and all other letters; everything else
separates). Of the hashes of each ``window`` following three-word strings of a template the least
is kept with its places: an inverted index, whose size is bounded by the templates, a parameter. Every three-word
string of a document is looked up in it, so any five words in a row that a document shares with a
template are noticed. Hits of a template on neighbouring diagonals, none more than ``REACH`` words of the template
after the one before, make a candidate region, in which a local alignment within a band of ``BAND`` diagonals counts
the template's matched words; the region grows until the alignment ends inside it. A match, of a part of a template
too, is reported with its coverage if it has ``FLOOR`` matched words, or ``LEAST`` of a template so short that
this is less. Of matches that overlap by half of the smaller one or more, the one with more matched words, to
which up to ``FILLED`` words are added in proportion to its coverage, as words may match by chance beside a whole
notice. Long regions come first; those inside a longer match are not aligned.

Templates are short notices (``TEMPLATES``), which are tried first in a tie, and the whole texts in ``license_texts``,
named ``<license>-text``. Words that several licenses share go to the template with the most matched words.

A document is settled in one task; nothing is shuffled.

Result: a row for each match: doc_id, license, matched, template_words, coverage, start, end (characters of the text, end
exclusive). Defined cases: null and empty texts have no match; repeated rows give repeated rows; ties
go to the template named first; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keytide.llm.bytehash import Prefix, U, blocks, mix, word_bounds
from keytide.llm.common import documents, ship

K, WINDOW, BAND, REACH, LEAST, FLOOR, FILLED, LONG = 3, 3, 8, 64, 0.75, 7, 4, 128

#: Short notices and first paragraphs of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-short": "Licensed under the GNU General Public License v3.",
    "GPL-2.0-short": "Licensed under the GNU General Public License v2.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "EPL-2.0-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
}


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """The notices and the whole texts; read on the driver only."""
    texts = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return TEMPLATES | {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in texts}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = word_bounds(data, offs, GAP)
    return Prefix(LOWER[data]).of(starts, ends), starts, ends, at


def grams(words: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(words) - K + 1), dtype=U)
    for j in range(K):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[j : len(words) - K + 1 + j])
    return h


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    prints: np.ndarray  # sorted fingerprints, with the template and place of each
    template: np.ndarray
    place: np.ndarray
    flat: np.ndarray  # the words of all templates, with the first of each template and their number
    first: np.ndarray
    size: np.ndarray


def index(templates: dict[str, str]) -> Index:
    found, words = set(), []
    for t, text in enumerate(templates.values()):
        data = np.frombuffer(text.encode(), np.uint8)
        w = words_of(data, np.array([0, len(data)]))[0]
        words.append(w)
        h = grams(w)
        for i in range(max(1, len(h) - WINDOW + 1)):
            if len(h):
                j = i + int(np.argmin(h[i : i + WINDOW]))
                found.add((int(h[j]), t, j))
    rows = sorted(found)
    size = np.array([len(w) for w in words], np.int64)
    prints, template, place = np.array([r[0] for r in rows], U), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return Index(tuple(templates), prints, template, place, np.concatenate([*words, np.zeros(0, U)]), np.cumsum(size) - size, size)


#: A state of the alignment in one number, compared as (score, matched words, first word less the least possible one).
SCORE, MATCHED = 1 << 42, 1 << 21


def align(text: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of parts of templates (all words, starts and lengths, longest first), each within ``BAND`` of its
    diagonal (place in text less place in the part): matched words, first and last word + 1, last place in the part.
    The first word counts from ``diagonal - BAND``."""
    flat, start, length = rows
    n, width = len(start), 2 * BAND + 1
    col = np.arange(width)
    matched, first, end, last = (np.zeros(n, np.int64) for _ in range(4))
    top = np.zeros(n, np.int64)
    state = np.zeros((n, width), np.int64)
    for i in range(int(length.max(initial=0))):
        live = int(np.count_nonzero(length > i))
        s = state[:live]
        j = (diagonal[:live] + (i - BAND))[:, None] + col
        inside = (j >= 0) & (j < len(text))
        hit = inside & (text[np.clip(j, 0, len(text) - 1)] == flat[start[:live] + i][:, None])
        # From the same diagonal, or by skipping a word of either side.
        new = np.where(s > 0, s, i + col) + np.where(hit, 2 * SCORE + MATCHED, -SCORE)
        new[:, :-1] = np.maximum(new[:, :-1], np.where(s[:, 1:] > 0, s[:, 1:] - SCORE, -SCORE))
        new = np.where(inside, new, -(1 << 60))
        new = np.maximum.accumulate(new + col * SCORE, axis=1) - col * SCORE
        new = np.where(inside & (new >= SCORE), new, 0)
        state[:live] = new
        score = new >> 42
        k = score.argmax(1)
        at = np.flatnonzero(score[np.arange(live), k] > top[:live])
        if len(at):
            v = new[at, k[at]]
            top[at], matched[at], first[at] = v >> 42, (v & (SCORE - 1)) >> 21, v & (MATCHED - 1)
            end[at], last[at] = j[at, k[at]] + 1, i
    return matched, first, end, last


def regions(idx: Index, h: np.ndarray) -> np.ndarray:
    """Rows (template, diagonal, first and last place in the template) of the regions with hits of three-word strings ``h``."""
    lo, hi = np.searchsorted(idx.prints, h), np.searchsorted(idx.prints, h, "right")
    n = hi - lo
    p = np.repeat(np.arange(len(h)), n)
    e = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    t, place = idx.template[e], idx.place[e]
    d = p - place
    order = np.lexsort((place, d, t))
    t, place, d = t[order], place[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))[: len(t)]
    base, lead = [], (-1, 0)
    for a, b in zip(t[new].tolist(), d[new].tolist(), strict=True):  # neighbouring diagonals of a template
        if a != lead[0] or b - lead[1] > BAND // 2:
            lead = (a, b)
        base.append(lead[1])
    d = np.repeat(np.array(base, np.int64), np.diff(np.append(new, len(t))))
    order = np.lexsort((place, d, t))
    t, place, d = t[order], place[order], d[order]
    cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1]) | (place[1:] - place[:-1] > REACH)]))[: len(t)]
    last = np.append(cut[1:], len(t)) - 1
    return np.stack([t[cut], d[cut], place[cut], place[last[: len(cut)]]], axis=1)


def aligned(words: np.ndarray, idx: Index, todo: np.ndarray, least: float, floor: int) -> set[tuple[int, int, int, int]]:
    """(template, matched, first word, last word + 1) of the alignments in regions ``todo`` with enough words."""
    found = set()
    pad = np.full(len(todo), REACH // 2)
    while len(todo):
        size = idx.size[todo[:, 0]]
        a, b = np.maximum(0, todo[:, 2] - pad), np.minimum(size, todo[:, 3] + K + pad)
        order = np.argsort(a - b, kind="stable")
        todo, pad, size, a, b = todo[order], pad[order], size[order], a[order], b[order]
        grow = np.zeros(len(todo), bool)
        for i in range(0, len(todo), 4096):
            part = slice(i, i + 4096)
            t, ta, tb = todo[part, 0], a[part], b[part]
            m, f, e, last = align(words, (idx.flat, idx.first[t] + ta, tb - ta), todo[part, 1] + ta)
            grow[part] = ((ta > 0) & (f <= 3 * BAND)) | ((tb < size[part]) & (last >= tb - ta - 1 - BAND))
            ok = ~grow[part] & (m >= np.minimum(floor, least * size[part]))
            found.update(zip(t[ok].tolist(), m[ok].tolist(), (f + todo[part, 1] + ta - BAND)[ok].tolist(), e[ok].tolist(), strict=True))
        todo, pad = todo[grow], pad[grow] * 2
    return found


def choose(found: set[tuple[int, int, int, int]], idx: Index) -> list[tuple[int, int, int, int]]:
    chosen: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[1] - FILLED * x[1] / int(idx.size[x[0]]), *x)):
        if all(2 * (min(x[3], c[3]) - max(x[2], c[2])) < min(x[3] - x[2], c[3] - c[2]) for c in chosen):
            chosen.append(x)
    return sorted(chosen, key=lambda c: c[2])


def scan(words: np.ndarray, idx: Index, least: float, floor: int) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word + 1) of the matches in one text."""
    todo = regions(idx, grams(words))
    rows = todo[:, 3] - todo[:, 2]
    found = aligned(words, idx, todo[rows > LONG], least, floor)
    todo = todo[rows <= LONG]
    a, b = todo[:, 1] + todo[:, 2] - REACH // 2, todo[:, 1] + todo[:, 3] + K + REACH // 2
    free = np.ones(len(todo), bool)
    for _, m, f, e in choose(found, idx):
        free &= (np.maximum(a, 0) < f) | (np.minimum(b, len(words)) > e) | (b - a > m)
    return choose(found | aligned(words, idx, todo[free], least, floor), idx)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, floor: int = FLOOR) -> DataFrame:
    idx = index(templates or all_templates())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in blocks(batch.column("text")):
                words, starts, ends, at = words_of(data, offs)
                near = np.searchsorted(idx.prints, g := grams(words))
                hit = np.flatnonzero(idx.prints[np.minimum(near, len(idx.prints) - 1)] == g) if len(g) else g
                out = []
                for d in np.unique(np.searchsorted(at, hit, "right") - 1):
                    for t, m, f, e in scan(words[at[d] : at[d + 1]], idx, least, floor):
                        lead = lambda n, d=d: int(np.count_nonzero((data[offs[d] : n] & 0xC0) != 0x80))
                        size = int(idx.size[t])
                        out.append((i + d, idx.names[t], m, size, m / size, lead(starts[at[d] + f]), lead(ends[at[d] + e - 1])))
                if out:
                    c = list(zip(*out, strict=True))
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(c[0])), *(pa.array(list(v), k) for v, k in zip(c[1:], kinds, strict=True))], ["doc_id", "license", "matched", "template_words", "coverage", "start", "end"])

    ship(docs.sparkSession)
    narrow = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(find, f"doc_id {dict(narrow.dtypes)['doc_id']}, license string, matched int, template_words int, coverage double, start long, end long")


def op6_license_scan(spark, sf_dir):
    return license_matches(documents(spark, sf_dir))
