"""License scans by patience alignment of texts with license templates.

Words that occur once in the text and once in the template are anchors; the longest increasing
run of anchors is kept, and the gaps between them are aligned in the same way, where other words
become unique. Coverage is the share of the template's words that are aligned. A text can only
reach the threshold for a template if it has that share of the template's words at all, so this
bag of words decides without loss which templates are aligned.

Beside an anchor, equal words are taken first, and a gap without further anchors gets a longest
common subsequence of the words near its anchors.

Words of a license that is stated twice, or that a long text uses elsewhere, are not unique. Where
the alignment of the whole text leaves template words open, each place of the template's rarest
words serves as the anchor of a window. So many words are taken that a text with the least coverage
has one of them, and the window with the most aligned words counts if it has more than the whole.
Positions are those of the words of the whole text.

Each text is aligned in its task: no shuffle, the templates are a fixed list.

Close variants of a license (versions, the Creative Commons family)
differ in less than the least coverage allows: each has its row, and the coverage tells them apart.

Defined results: one row per document and template with ``LEAST_COVERAGE`` or more, and one row
with NULLs for a document without any; NULL and empty texts have none; NULL and repeated doc_ids
are rows like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST_COVERAGE = 0.8

#: Fixed values. Lines of one sentence, as the test documents have them; no published texts.
LINES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

#: Short licenses, and the notices that longer ones ask for, as they are published.
NOTICES = {
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    ),
    "CC-BY-NC-ND-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."
    ),
}

TEMPLATES = LINES | NOTICES

_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(positions: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    pile_of: list[int] = []
    before: list[int] = []
    for index, position in enumerate(positions):
        pile = bisect_left(tops, position)
        before.append(pile_of[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(position)
            pile_of.append(index)
        else:
            tops[pile], pile_of[pile] = position, index
    chain, index = [], pile_of[-1] if pile_of else -1
    while index >= 0:
        chain.append(index)
        index = before[index]
    return chain[::-1]


def _once(words: list[str], start: int, stop: int) -> dict[str, int]:
    counts = Counter(words[start:stop])
    return {words[i]: i for i in range(start, stop) if counts[words[i]] == 1}


def _common(own: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; each row of its table is one number, a clear bit is a step."""
    masks: dict[str, int] = {}
    for i, word in enumerate(own):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(own)) - 1
    row, rows = full, []
    for word in template:
        both = row & masks.get(word, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    pairs, i, j = [], len(own), len(template)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            pairs.append((i, j))
    return pairs[::-1]


def align(text: list[str], template: list[str], seed: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Aligned positions (text, template), both increasing; with ``seed``, those of a window around this pair.

    Before the first anchor and behind the last one, the text beside them is looked at as far as
    the template's gap is long, twice as far beside a seed: a license stands together.
    """
    pairs: list[tuple[int, int]] = []
    # Ranges of both, and whether an aligned pair stands right before and right behind them.
    stack = [(0, len(text), 0, len(template), False, False)]
    if seed:
        i, j = seed
        pairs.append(seed)
        rest = len(template) - j - 1
        stack = [(max(0, i - 2 * j), i, 0, j, False, True), (i + 1, min(len(text), i + 1 + 2 * rest), j + 1, len(template), True, False)]
    while stack:
        a, b, c, d, behind, before = stack.pop()
        while behind and a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while before and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        in_template = _once(template, c, d)
        wanted = in_template.keys()
        own = Counter(w for w in text[a:b] if w in wanted)
        places = [(in_template[w], i) for i in range(a, b) if own.get(w := text[i]) == 1]
        places.sort()
        anchors = [(places[k][1], places[k][0]) for k in _increasing([i for _, i in places])]
        if not anchors:
            near = 2 * (d - c)
            left = range(a, min(b, a + near) if behind else a)
            beside = [*left, *range(max(left.stop, b - near) if before else b, b)]
            pairs += [(beside[x], c + t) for x, t in _common([text[i] for i in beside], template[c:d])]
            continue
        pairs += anchors
        first, last = anchors[0], anchors[-1]
        start, stop = max(a, first[0] - (first[1] - c)), min(b, last[0] + 1 + d - last[1] - 1)
        stack.append((start, first[0], c, first[1], behind and start == a, True))
        stack += [(x + 1, y, t + 1, u, True, True) for (x, t), (y, u) in zip(anchors, anchors[1:], strict=False)]
        stack.append((last[0] + 1, stop, last[1] + 1, d, True, before and stop == b))
    return sorted(pairs)


def _best_window(text: list[str], template: list[str], there: Counter, least: float, most: int) -> list[tuple[int, int]]:
    """The most aligned words of a window around a rare template word, the first such window."""
    needed = ceil(least * len(template) - 1e-9)
    rare = sorted(range(len(template)), key=lambda j: there[template[j]])[: len(template) - needed + 1]
    wanted: dict[str, list[int]] = {}
    for j in rare:
        wanted.setdefault(template[j], []).append(j)
    times = Counter(template)
    best: list[tuple[int, int]] = []
    for i, j in sorted(((i, j) for i, w in enumerate(text) if w in wanted for j in wanted[w]), key=lambda s: (s[0] - s[1], s)):
        own = Counter(w for w in text[max(0, i - 2 * j) : i + 1 + 2 * (len(template) - j - 1)] if w in times)
        if sum(min(n, times[w]) for w, n in own.items()) < max(needed, len(best) + 1):
            continue
        pairs = align(text, template, (i, j))
        if len(pairs) > len(best):
            best = pairs
        if len(best) == most:  # no window of this text can have more
            break
    return best


def licenses_of(text: str | None, templates: dict[str, list[str]], least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, aligned words, first and last aligned word) of each template that the text covers."""
    if not text:
        return []
    words = license_words(text)
    there = Counter(words)
    found = []
    for name, template in templates.items():
        if len(words) < least * len(template):
            continue
        most = sum(min(n, there[w]) for w, n in Counter(template).items())
        if most < least * len(template):
            continue
        pairs = align(words, template)
        if len(pairs) < most:
            pairs = max(pairs, _best_window(words, template, there, least, most), key=len)
        if len(pairs) >= least * len(template):
            found.append((name, len(pairs) / len(template), len(pairs), pairs[0][0], pairs[-1][0]))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_aligned, first_word, last_word) of (doc_id, text)."""
    known = {name: license_words(t) for name, t in (templates or TEMPLATES).items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = licenses_of(text, known, least) or [(None,) * 5]
                rows += [row] * len(own)
                found += own
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "license", "coverage", "n_aligned", "first_word", "last_word"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_aligned", "first_word", "last_word")]
    return docs.select("doc_id", "text").mapInArrow(look, T.StructType(fields))
