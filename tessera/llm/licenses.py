"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are lower-cased runs of letters and digits. Hashes of GRAM consecutive words are
winnowed: of WINDOW neighbours the least (the last of equals) is a fingerprint, so texts that
share WINDOW + GRAM - 1 words share one. The templates' fingerprints form an inverted index,
of the size of the template list. A text's hits on one template are grouped where they fit one
laying of the template (places and diagonals near each other); each group is aligned with the
template in a band around its diagonals (match +2, mismatch and gap -1, best local alignment).
A finding is an alignment that covers least_coverage of the template's words. Of overlapping
findings of one template the best stays; different templates are reported side by side.

One pass without a shuffle. Templates of under GRAM words are not searched. Edge cases: null and
blank texts have no findings; a template repeated in a text is found each time; equal rows get
equal findings; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as tw
from .decontaminate import NOT_WORD
from .shared import map_texts

GRAM, WINDOW = 3, 3

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT (notice)": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _words(column) -> tw.Words:
    return tw.split(column, NOT_WORD, lower=True)


def winnow(w: tw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of every text."""
    g = tw.gram_hashes(tw.word_hashes(w), GRAM)
    at = np.flatnonzero(tw.inner(w, GRAM))
    owner, g = w.owner[at], g[at]
    if not len(at):
        return at, g
    pick = np.zeros(len(at), bool)
    n = np.bincount(owner, minlength=len(w.first) - 1)
    width = np.minimum(n, WINDOW)[owner]  # a text with fewer grams has one window
    last = np.cumsum(n)[owner]
    seat = np.arange(len(at))
    starts = np.flatnonzero(seat + width <= last)
    best = starts.copy()
    for k in range(1, WINDOW):
        other = np.minimum(starts + k, len(at) - 1)
        better = (k < width[starts]) & (g[other] <= g[best])
        best = np.where(better, other, best)
    pick[best] = True
    return at[pick], g[pick]


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[list[bytes]]
    hashes: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        w = _words(pa.array(list(templates.values())))
        at, h = winnow(w)
        owner = np.searchsorted(w.first, at, side="right") - 1
        order = np.argsort(h, kind="stable")
        data = w.raw()
        words = [[data[w.start[i] : w.end[i]] for i in range(w.first[t], w.first[t + 1])] for t in range(len(templates))]
        return Index(list(templates), words, h[order], owner[order], (at - w.first[owner])[order])


def band_align(template: list, text: list, low: int, high: int) -> tuple[int, int, int, int]:
    """(score, matches, start, end in text) of the best local alignment on diagonals low..high (text - template place).

    Of equal scores: more matches, then the earlier end.
    """
    best, before = (0, 0, 0, 0), {}
    for i, word in enumerate(template):
        row, left = {}, None
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            d = j - i
            hit = word == text[j]
            diagonal = before.get(d) or (0, 0, j)
            cell = (diagonal[0] + (2 if hit else -1), diagonal[1] + hit, diagonal[2])
            up = before.get(d + 1)
            for other in (up, left):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            cell = cell if cell[0] > 0 else None
            row[d] = left = cell
            if cell and (cell[0], cell[1]) > best[:2]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = row
    return best


def find(column, index: Index, least_coverage: float) -> list[list[dict]]:
    """The findings of each text."""
    w = _words(column)
    data = w.raw()
    at, h = winnow(w)
    left, right = np.searchsorted(index.hashes, h), np.searchsorted(index.hashes, h, side="right")
    n = right - left
    entry = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place, template = np.repeat(at, n), index.template[entry]
    owner = np.searchsorted(w.first, place, side="right") - 1
    diagonal = place - index.place[entry]
    order = np.lexsort((diagonal, template, owner))
    place, template, owner, diagonal = place[order], template[order], owner[order], diagonal[order]
    size = np.array([len(x) for x in index.words])
    slack = np.maximum(4, size // 8)
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    new = np.ones(len(place), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[template[1:]])
    edge = np.append(np.flatnonzero(new), len(place))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        t, o, spare = int(template[a]), int(owner[a]), int(slack[template[a]])
        first, last = int(w.first[o]), int(w.first[o + 1])
        low, high = int(diagonal[a]) - spare, int(diagonal[b - 1]) + spare
        i, j = max(first, low), min(last, high + int(size[t]))
        said = [data[x:y] for x, y in zip(w.start[i:j].tolist(), w.end[i:j].tolist(), strict=True)]
        _, matches, start, end = band_align(index.words[t], said, low - i, high - i)
        if matches >= least_coverage * size[t]:
            start, end = start + i, end + i
            found = {"license": index.names[t], "matched_words": matches, "template_words": int(size[t]), "start_word": start - first, "end_word": end - first}
            found |= {"start_byte": int(w.start[start] - w.offsets[o]), "end_byte": int(w.end[end - 1] - w.offsets[o])}
            out[o].append(found)
    return [_apart(x) for x in out]


def _apart(found: list[dict]) -> list[dict]:
    """Without findings that overlap a better one of the same license."""
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (-f["matched_words"], f["start_word"])):
        if not any(k["license"] == f["license"] and k["start_word"] < f["end_word"] and f["start_word"] < k["end_word"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f["start_word"], f["license"]))


FINDING = {"license": "string", "matched_words": "int", "template_words": "int", "start_word": "int", "end_word": "int", "start_byte": "int", "end_byte": "int"}
_ARROW = pa.list_(pa.struct([(k, pa.string() if v == "string" else pa.int32()) for k, v in FINDING.items()]))


def license_findings(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, least_coverage: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all) and findings, an array of FINDING in text order."""
    index = Index.of(templates or TEMPLATES)
    kind = "array<struct<" + ",".join(f"{k}:{v}" for k, v in FINDING.items()) + ">>"
    return map_texts(docs, text, lambda c: {"findings": pa.array(find(c, index, least_coverage), _ARROW)}, {"findings": kind}, keep)


def license_report(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, the fields of FINDING and coverage: a row for each finding."""
    each = license_findings(docs, text, keep=[id], **options).select(id, F.explode("findings").alias("f"))
    return each.select(id, "f.*", F.round(F.col("f.matched_words") / F.col("f.template_words"), 6).alias("coverage"))
