"""License scans by patience alignment of documents with license templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import slices
from tickloom.llm.text import table

#: Short notices and the opening or operative paragraphs of public licences.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
        " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
        " other materials provided with the distribution."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-notice": "Released under the BSD License",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc0-1.0-notice": "Released under CC0 1.0",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-unversioned-notice": "This work is licensed under the GNU General Public License",
    "cc-by-nc-unversioned-notice": "Licensed under CC BY-NC",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc0-1.0-dedication": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to"
        " this work."
    ),
}
TEMPLATES["bsd-3-clause"] = TEMPLATES["bsd-2-clause"] + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
TEMPLATES["gpl-unversioned-header"] = TEMPLATES["gpl-3.0-header"].replace(" either version 3 of the License, or (at your option) any later version.", "")
TEMPLATES["gpl-2.0-header"] = TEMPLATES["gpl-3.0-header"].replace("version 3", "version 2")
TEMPLATES["lgpl-3.0-header"] = TEMPLATES["gpl-3.0-header"].replace("General Public", "Lesser General Public")
TEMPLATES["lgpl-2.1-header"] = TEMPLATES["lgpl-3.0-header"].replace("version 3", "version 2.1")
TEMPLATES["agpl-3.0-header"] = TEMPLATES["gpl-3.0-header"].replace("General Public", "Affero General Public")

#: Runs of words that name a licence: all of a template's must stand in a place, unbroken and in this order.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0-notice": ("apache", "2"),
    "apache-2.0-header": ("apache", "2"),
    "mit-notice": ("mit",),
    "bsd-notice": ("bsd",),
    "bsd-3-clause": ("neither the name",),
    "cc-by-4.0-notice": ("cc by", "4"),
    "cc-by-sa-4.0-notice": ("by-sa", "4"),
    "cc-by-nc-4.0-notice": ("by-nc", "4"),
    "cc0-1.0-notice": ("cc0", "1"),
    "cc0-1.0-dedication": ("waived all copyright",),
    "cc-by-nc-unversioned-notice": ("by-nc",),
    "gpl-unversioned-notice": ("gnu general public license",),
    "gpl-unversioned-header": ("gnu general public license",),
    "mpl-2.0-header": ("mozilla", "2"),
} | {
    f"{who}-{version}": (f"gnu {kind}general public license", number)
    for who, kind in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero "))
    for version, number in (("notice", "3"), ("2.0-notice", "2"), ("2.1-notice", "2.1"), ("3.0-notice", "3"), ("2.0-header", "2"), ("2.1-header", "2.1"), ("3.0-header", "3"))
    if f"{who}-{version}" in TEMPLATES
}
COVERAGE = 0.8
#: A place has at most so many times the words of its template.
REACH = 2

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.'/-][A-Za-z0-9]+)*")


_VERSION = re.compile(r"v?([0-9]+)(?:\.0)?")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case and where they stand; v3, 3.0 and 3 are one word."""
    found = list(_WORD.finditer(text))
    words = [m[0].lower() for m in found]
    return [v[1] if (v := _VERSION.fullmatch(w)) else w for w in words], [m.span() for m in found]


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words (index in text, index in template), rising in both.

    Words that stand once in both stretches anchor them; the longest rising run of anchors holds, and the gaps between
    are aligned in the same way, after equal words at their ends. A gap without anchors is aligned word by word.
    """
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1 and here.get(w) == 1}
        met = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [met[k] for k in rising([j for _, j in met])]
        if not anchors:
            pairs += [(a + i, c + j) for i, j in align_gap(text[a:b], template[c:d])]
            continue
        pairs += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(pairs)


def align_gap(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """A longest alignment, for stretches in which words repeat: from the last equal words back to the first."""
    own = set(template)
    kept = [i for i, w in enumerate(text) if w in own]
    best = [[0] * (len(template) + 1)]
    for i in kept:
        row, last = [0], best[-1]
        for j, w in enumerate(template):
            row.append(last[j] + 1 if w == text[i] else max(row[j], last[j + 1]))
        best.append(row)
    pairs, r, j = [], len(kept), len(template)
    while r and j:
        if text[kept[r - 1]] == template[j - 1]:
            r, j = r - 1, j - 1
            pairs.append((kept[r], j))
        elif best[r - 1][j] >= best[r][j - 1]:
            r -= 1
        else:
            j -= 1
    return pairs


def cue_words(template: list[str], often: Mapping[str, float], coverage: float) -> set[str]:
    """Words of which at least one stands in every text that covers the template: those that come least often."""
    n, left = Counter(template), (1 - coverage) * len(template)
    chosen: set[str] = set()
    for w in sorted(n, key=lambda w: (often.get(w, 0), w)):
        if left < -1e-9:
            break
        chosen.add(w)
        left -= n[w]
    return chosen


class Template:
    """The words of a template, and masks of the places of each word for row-wise bits of the alignment."""

    def __init__(self, words: list[str], coverage: float, names: Sequence[str] = ()):
        n = len(words)
        self.names: list[tuple[list[str], int]] = []  # the words of a name, and where it stands in the template
        for name in map(str.split, names):
            after = sum(self.names[-1][1:], len(self.names[-1][0])) if self.names else 0
            self.names.append((name, next(j for j in range(after, n) if words[j : j + len(name)] == name)))
        self.words, self.need, self.reach = words, max(1, math.ceil(coverage * n - 1e-9)), REACH * n
        self.ahead: dict[str, int] = {}
        self.back: dict[str, int] = {}
        for j, w in enumerate(words):
            self.ahead[w] = self.ahead.get(w, 0) | 1 << j
            self.back[w] = self.back.get(w, 0) | 1 << (n - 1 - j)


def steps(words: list[str], at: Iterable[int], masks: Mapping[str, int], n: int) -> Iterator[tuple[int, int]]:
    """(i, aligned): the places, in the order of `at`, at which a longest alignment with the template grows, and its length.

    One row of the alignment is one integer: bit j is unset where the template's word j makes it longer.
    """
    full = (1 << n) - 1
    row, aligned = full, 0
    for i in at:
        mask = masks.get(words[i])
        if mask:
            met = row & mask
            row = ((row + met) | (row - met)) & full
            if n - row.bit_count() > aligned:
                aligned += 1
                yield i, aligned


def covered_stretch(words: list[str], t: Template, a: int, b: int) -> tuple[int, int] | None:
    """The stretch of words[a:b] that covers the template, is within its reach, ends first and starts last."""
    n = len(t.words)
    while (end := next((i for i, k in steps(words, range(a, b), t.ahead, n) if k >= t.need), None)) is not None:
        start = next(i for i, k in steps(words, range(end, a - 1, -1), t.back, n) if k >= t.need)
        if end + 1 - start <= t.reach:
            return start, end + 1
        a = start + 1  # what starts earlier ends no sooner, and is longer still
    return None


def pinned(words: list[str], t: Template) -> list[tuple[int, int]]:
    """The longest alignment of words with the template in which each of its names is aligned; none without them."""
    where = [[i for i in range(len(words)) if words[i : i + len(name)] == name] for name, _ in t.names]
    best: list[tuple[int, int]] = []
    for chosen in product(*where):
        pairs, a, c = [], 0, 0
        for i, (name, j) in zip((*chosen, len(words)), (*t.names, ([], len(t.words))), strict=True):
            if i < a:
                break
            part = align(words[a:i], t.words[c:j])
            pairs += [(a + x, c + y) for x, y in part] + [(i + k, j + k) for k in range(len(name))]
            a, c = i + len(name), j + len(name)
        else:
            if len(pairs) > len(best):
                best = pairs
    return best


def places(words: list[str], t: Template, a: int, b: int) -> Iterator[tuple[float, int, int]]:
    """(coverage, start, end) in words of each place in words[a:b] that covers the template; none overlaps another.

    A stretch grows to the right and then to the left by the words that lengthen its alignment, up to its neighbours.
    """
    n, free, here = len(t.words), a, covered_stretch(words, t, a, b)
    while here:
        after = covered_stretch(words, t, here[1], b)
        start, end = here
        for i, _ in steps(words, range(start, min(after[0] if after else b, start + t.reach)), t.ahead, n):
            end = max(end, i + 1)
        for i, _ in steps(words, range(end - 1, max(free, end - t.reach) - 1, -1), t.back, n):
            start = min(start, i)
        pairs = pinned(words[start:end], t)
        if len(pairs) < t.need and not t.names:
            pairs = align_gap(words[start:end], t.words)
        if len(pairs) >= t.need:
            pairs.sort()
            yield len(pairs) / n, start + pairs[0][0], start + pairs[-1][0] + 1
            free, here = end, after
        else:
            here = covered_stretch(words, t, here[0] + 1, b)


def scan(
    text: str, templates: Mapping[str, list[str]], coverage: float, names: Mapping[str, Sequence[str]] = NAMES
) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of every place that covers a template, in order of names and starts."""
    words, spans = words_of(text)
    often = Counter(words)
    found = []
    for name in sorted(templates):
        named = names.get(name, ())
        if any(often[w] == 0 for phrase in named for w in phrase.split()):
            continue
        t = Template(templates[name], coverage, named)
        cues = cue_words(t.words, often, coverage)
        windows: list[list[int]] = []
        for i in (i for i, w in enumerate(words) if w in cues):
            if windows and i - t.reach <= windows[-1][1]:
                windows[-1][1] = min(len(words), i + t.reach)
            else:
                windows.append([max(0, i - t.reach), min(len(words), i + t.reach)])
        for a, b in windows:
            found += [(name, share, spans[start][0], spans[end - 1][1]) for share, start, end in places(words, t, a, b)]
    return found


def outermost(found: list[tuple[str, float, int, int]], within: Mapping[str, set[str]]) -> list[tuple[str, float, int, int]]:
    """Without the places that are only part of a place of a template that holds theirs (a notice in its header)."""
    return [f for f in found if not any(f[0] in within[g[0]] and g[2] <= f[2] and f[3] <= g[3] for g in found)]


SCHEMA = "doc_id long, license string, coverage double, start long, end long, licenses string"


def scan_documents(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end, licenses: one row per input row.

    license is the place with most of its template's words covered, then of the longest, then of the first name, then the first; start and end are
    code points; licenses lists every place that covers a template as name:start:end. All are null where none is covered. A null
    text has none. Repeated rows are scanned one by one; an empty table gives an empty result; other columns are
    ignored. Texts without any cue word of any template (one of which a covered template must hold) skip the scan.
    """
    words = {name: words_of(t)[0] for name, t in (TEMPLATES if templates is None else templates).items()}
    names = NAMES if templates is None else {}
    within = {name: {f[0] for f in scan(" ".join(t), words, coverage, names) if f[0] != name} for name, t in words.items()}
    cues = sorted({c for t in words.values() for c in cue_words(t, {w: -len(w) for w in t}, coverage)})
    pattern = "|".join(map(re.escape, cues)) or r"[^\s\S]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                worth = pc.fill_null(pc.match_substring_regex(part["text"], pattern, ignore_case=True), False)
                rows = []
                for text, w in zip(part["text"].to_pylist(), worth.to_pylist(), strict=True):
                    found = outermost(scan(text, words, coverage, names), within) if w else []
                    if found:
                        best = min(found, key=lambda f: (-f[1], -len(words[f[0]]), f[0], f[2]))
                        rows.append((*best, ",".join(f"{n}:{s}:{e}" for n, _, s, e in found)))
                    else:
                        rows.append((None,) * 5)
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=["doc_id", "license", "coverage", "start", "end", "licenses"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
