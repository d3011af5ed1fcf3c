"""License scans by Patience alignment.

Template and text are compared as words. Words that occur once in both are anchors; the longest increasing
subsequence of their places keeps those in order, and the gaps between them are aligned the same way; a gap without
such a word is aligned by its longest common subsequence. Coverage is the share of the template's words that are
aligned. Only stretches of a text that hold enough of a template's words to reach the coverage asked for are aligned
at all, so long texts without a license cost one pass over their words. A stretch may hold other words than the
template's, in one gap or in many: at most `foreign` for each word of the template.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm.sampling import id_and_text
from sedge.workspace import small_batches

COVERAGE = 0.8
#: Other words that a stretch may hold, for each word of its template.
FOREIGN = 8

#: Notices by which a license is declared, in the words of the public license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software."
    ),
}

_word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*").findall


def words_of(text: str | None) -> list[str]:
    return _word((text or "").lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, given by rising first member, whose second members rise too (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        tops[pile : pile + 1] = [b]
        ends[pile : pile + 1] = [k]
        back.append(ends[pile - 1] if pile else -1)
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _longest_common(template: list[str], a: int, a_end: int, text: list[str], b: int, b_end: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two gaps, for those where no word occurs once in both."""
    words = set(template[a:a_end])
    at = [j for j in range(b, b_end) if text[j] in words]
    rest = [[0] * (len(at) + 1)]
    for i in range(a_end - 1, a - 1, -1):
        below, row = rest[-1], [0] * (len(at) + 1)
        for n in range(len(at) - 1, -1, -1):
            row[n] = below[n + 1] + 1 if template[i] == text[at[n]] else max(below[n], row[n + 1])
        rest.append(row)
    rest.reverse()
    pairs, i, n = [], a, 0
    while i < a_end and n < len(at):
        if template[i] == text[at[n]]:
            pairs.append((i, at[n]))
            i, n = i + 1, n + 1
        elif rest[i - a + 1][n] >= rest[i - a][n + 1]:
            i += 1
        else:
            n += 1
    return pairs


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in template, in text), rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and template[a] == text[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and template[a_end - 1] == text[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        once_a, once_b = Counter(template[a:a_end]), Counter(text[b:b_end])
        place = {w: j for j, w in enumerate(text[b:b_end], b) if once_b[w] == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(template[a:a_end], a) if once_a[w] == 1 and w in place])
        if not anchors:
            found += _longest_common(template, a, a_end, text, b, b_end)
            continue
        found += anchors
        edges = [(a - 1, b - 1), *anchors, (a_end, b_end)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


def _apart(found: Iterable[tuple], key: Callable[[tuple], tuple]) -> list[tuple]:
    """Stretches that do not overlap, the first by key taken first, in the order of the text.

    Those taken lie apart, so only the neighbours of a new one can overlap it.
    """
    kept: list[tuple] = []
    for f in sorted(found, key=key):
        at = bisect_left(kept, f[2], key=lambda o: o[2])
        if (at == 0 or kept[at - 1][3] <= f[2]) and (at == len(kept) or kept[at][2] >= f[3]):
            kept.insert(at, f)
    return kept


def _worth(aligned: int, extent: int) -> int:
    """An aligned word weighs as much as a little over three others: three words between any two are borne, a second copy is not taken in."""
    return 10 * aligned - 3 * (extent - aligned)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, foreign: int = FOREIGN):
        self.foreign = foreign
        self.templates = {k: words_of(t) for k, t in templates.items()}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.need = {k: max(1, math.ceil(coverage * len(t) - 1e-9)) for k, t in self.templates.items()}
        self.known = {w for t in self.templates.values() for w in t}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of every stretch that covers a template enough, the best ones only."""
        words = words_of(text)
        held = self.known.intersection(words)
        found = []
        for name, own in self.counts.items():
            if sum(n for w, n in own.items() if w in held) >= self.need[name]:
                # Of one template's stretches the one of most worth stays: a longer one may mix in the copy behind.
                found += _apart(self._stretches(name, words), lambda f: (-_worth(f[4], f[3] - f[2]), -f[4], f[2]))
        # Of stretches that overlap, the one that aligns the most words stays; of equals the better covered, then by name.
        return [f[:4] for f in _apart(found, lambda f: (-f[4], -f[1], f[0], f[2]))]

    def _stretches(self, name: str, words: list[str]) -> Iterator[tuple[str, float, int, int, int]]:
        """Stretches of a text that align enough of one template, with the number of aligned words."""
        template, own, need = self.templates[name], self.counts[name], self.need[name]
        size = len(template)
        most = size * (1 + self.foreign)
        lengths = [size, size + size // 4 + 2]
        while lengths[-1] < most:
            lengths.append(min(2 * lengths[-1], most))
        # At most size - need words are missing, so the first aligned word is one of these.
        starts = set(template[: size - need + 1])
        places = [k for k, w in enumerate(words) if w in own]
        done = 0
        for n, k in enumerate(places):
            if k < done or words[k] not in starts:
                continue
            inside = places[n : bisect_left(places, k + lengths[-1], n)]
            if len(inside) < need or sum(min(c, own[w]) for w, c in Counter(words[j] for j in inside).items()) < need:
                continue
            best, worth = [], 0
            for length in lengths:
                pairs = align(template, words[k : k + length])
                if len(pairs) >= need and (not best or _worth(len(pairs), pairs[-1][1] - pairs[0][1] + 1) > worth):
                    best, worth = pairs, _worth(len(pairs), pairs[-1][1] - pairs[0][1] + 1)
                if len(best) == size or k + length >= len(words):
                    break
            if best:
                first, last = k + best[0][1], k + best[-1][1] + 1
                yield name, len(best) / size, first, last, len(best)
                if len(best) == last - first == size:
                    done = last  # nothing that starts within a whole copy is better


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", foreign: int = FOREIGN) -> DataFrame:
    """One row per license found in a whole text: id, license, coverage, first_word, end_word (word places, end exclusive).

    A stretch holds at most `foreign` other words for each of its template's. Of stretches that overlap one is returned,
    that with the most aligned words. Documents without a license give no row; null and empty texts have none, an empty
    table gives an empty one. Repeated rows are scanned alike; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scanner(templates, coverage, foreign)
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch["_id"], batch["_text"], strict=True) for f in own.scan(t)]
            yield pd.DataFrame(rows, columns=[id_col, "license", "coverage", "first_word", "end_word"])

    return id_and_text(docs, id_col, text_col).mapInPandas(scan, f"{id_col} {kind}, license string, coverage double, first_word long, end_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
