"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every token sequence that occurs in a licence template or
in a base phrase.  Each text is streamed through it once, token by token,
giving its matching statistics (longest template substring that ends at each
token).  Maximal matches of ``min_match`` tokens or more become anchors between
text and template; the best chain of anchors in order and close together is a span
(covered tokens count for it, foreign words inside it ``FOREIGN`` times against it).
A span that covers enough of its template carries the template's label: all of
a template of up to ``SHORT`` tokens, where a word more or less is another licence,
and ``min_cover`` of a longer one.
Places of the base phrases come from the same pass: a phrase ends at a token
when its automaton state lies on the suffix-link path of the current state.

The automaton is built from the templates alone (a few thousand states) and is
shipped with the task; texts never leave their row, so there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import map_arrow, utf8

# ---------------------------------------------------------------------------
# Base phrases with their labels, and wording of public licences
# and of the notices that name them.
# ---------------------------------------------------------------------------
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Names of licences as SPDX identifiers.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause",
    "BSD-3-Clause", "MPL-2.0", "ISC", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CC0-1.0", "Unlicense", "0BSD", "Zlib",
)
# Creative Commons licences: what their codes stand for.
CC_PARTS = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_CODES = ("", "sa", "nd", "nc", "nc-sa", "nc-nd")
CC_VERSIONS = ("3.0", "4.0")
TEMPLATES = (
    ("mit", "under the MIT License"),
    ("mit", "The MIT License (MIT)"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Apache License 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied.",
    ),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "GNU General Public License v2.0"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License v3.0"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("epl-1.0", "Eclipse Public License v 1.0"),
    ("epl-1.0", "Eclipse Public License 1.0"),
    ("epl-2.0", "Eclipse Public License v 2.0"),
    ("epl-2.0", "Eclipse Public License 2.0"),
    ("eupl-1.2", "European Union Public Licence, version 1.2"),
    ("eupl-1.2", "European Union Public Licence v. 1.2"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-2-clause", "Simplified BSD License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsd-3-clause", "New BSD License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    *((name.lower(), f"SPDX-License-Identifier: {name}") for name in SPDX),
    *(
        (f"cc-by{code and '-'}{code}-{version}", " ".join(["Creative Commons Attribution", *map(CC_PARTS.get, code.split("-") if code else ()), version, end]))
        for code in CC_CODES
        for version in CC_VERSIONS
        for end in ("International", "Unported", "license")
    ),
    *(
        (f"cc-by{code and '-'}{code}-{version}", f"CC BY{code and '-'}{code} {version}")
        for code in CC_CODES
        for version in CC_VERSIONS
    ),
)
MIN_MATCH = 3  # tokens of an anchor
MAX_GAP = 8  # tokens between chained anchors, in text and in template
MIN_COVER = 0.75  # share of a long template that a span must cover
SHORT = 10  # tokens of a template that must be covered wholly
FOREIGN = 3  # weight of a word inside a span that is not the template's

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: ASCII letters and digits, and all other code points above U+007F."""
    return TOKEN.findall(utf8(text).lower())


@dataclass
class Automaton:
    """Generalised suffix automaton over token numbers, with its templates."""

    words: dict[bytes, int] = field(default_factory=dict)
    size: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    labels: list[str] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    is_base: list[bool] = field(default_factory=list)
    ends: list[list[tuple[int, int]]] = field(default_factory=list)
    phrases: list[list[int]] = field(default_factory=list)

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State for the part of q's strings that is reached from p by c."""
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        cur = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return cur

    def build(self, templates: list[tuple[str, list[bytes], bool]]) -> Automaton:
        coded = []
        for label, words, base in templates:
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            self.labels.append(label)
            self.lengths.append(len(ids))
            self.is_base.append(base)
            coded.append(ids)
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.ends = [[] for _ in self.size]
        self.phrases = [[] for _ in self.size]
        for t, ids in enumerate(coded):
            s = 0
            for e, c in enumerate(ids):
                s = self.step[s][c]
                up = s
                while up > 0 and not self.is_base[t]:
                    self.ends[up].append((t, e))
                    up = self.link[up]
            if self.is_base[t] and ids:
                self.phrases[s].append(t)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.phrases[s] = self.phrases[s] + [t for t in self.phrases[self.link[s]] if t not in self.phrases[s]]
        return self


def build_automaton(templates=TEMPLATES, base_phrases=BASE_PHRASES) -> Automaton:
    entries = [(label, tokens(text), False) for label, text in templates]
    entries += [(label, tokens(text), True) for text, label in base_phrases]
    return Automaton().build(entries)


def matching_statistics(sam: Automaton, words: list[bytes]):
    """Yield (position, state, length) of the longest match ending at each token that has one."""
    s = length = 0
    step, link, size, known = sam.step, sam.link, sam.size, sam.words.get
    for i, c in enumerate(map(known, words)):
        if c is None:
            s = length = 0
            continue
        while s and c not in step[s]:
            s = link[s]
            length = size[s]
        if c in step[s]:
            s = step[s][c]
            length += 1
            yield i, s, length


def chain_value(chain, max_gap: int):
    """(covered, foreign) of anchors (text start, template start, length) chained in this order; None if they are no chain.

    An anchor must lead its forerunner in text and template, by at most
    ``max_gap`` tokens; what both have of the template or the text counts once.
    """
    covered = foreign = end = t_end = 0
    for k, (i, j, n) in enumerate(chain):
        lead = 0
        if k:
            lead = max(0, end - i, t_end - j)  # part of the anchor that the chain has already
            if lead >= n or i - end > max_gap or j - t_end > max_gap:
                return None
            foreign += i + lead - end
        covered += n - lead
        end, t_end = i + n, j + n
    return covered, foreign


def chain_anchors(anchors, max_gap: int):
    """Best chains of (template, text start, template start, length) anchors.

    A chain is worth its covered tokens less ``FOREIGN`` for each foreign word.
    For each template the best chain is taken, then the best of those that end
    later or begin earlier, and so on.  Yields (template, text start, text
    end, template start, template end, covered, foreign).
    """
    by_template: dict[int, list] = {}
    for t, i, j, n in anchors:
        by_template.setdefault(t, []).append((i, j, n))
    for t, own in by_template.items():
        own.sort()
        longest = max(n for _, _, n in own)
        best: list[tuple] = []  # value, covered, foreign, text start, template start, forerunner
        first = 0  # anchors before it end too far back
        for k, (i, j, n) in enumerate(own):
            top = (n, n, 0, i, j, -1)
            while own[first][0] + longest + max_gap < i:
                first += 1
            for p in range(first, k):
                pi, pj, pn = own[p]
                end, t_end = pi + pn, pj + pn
                lead = max(0, end - i, t_end - j)
                if lead >= n or i - end > max_gap or j - t_end > max_gap:
                    continue
                value, covered, foreign, a, ta, _ = best[p]
                more = i + lead - end
                found = (value + n - lead - FOREIGN * more, covered + n - lead, foreign + more, a, ta, p)
                if found > top:
                    top = found
            best.append(top)
        taken: list[tuple[int, int]] = []  # disjoint, in text order
        for k in sorted(range(len(own)), key=lambda k: (-best[k][0], own[k])):
            _, covered, foreign, a, ta, _ = best[k]
            i, j, n = own[k]
            at = bisect_left(taken, (a, i + n))
            if (at == len(taken) or i + n <= taken[at][0]) and (at == 0 or a >= taken[at - 1][1]):
                taken.insert(at, (a, i + n))
                yield t, a, i + n, ta, j + n, covered, foreign


def scan(sam: Automaton, words: list[bytes], min_match: int, max_gap: int, min_cover: float):
    """(base places [(label, start)], spans) of one text."""
    places, anchors = [], []
    previous = (-2, 0, 0)

    def close(i: int, s: int, length: int) -> None:
        if length >= min_match:
            for t, e in sam.ends[s]:
                anchors.append((t, i - length + 1, e - length + 1, length))

    for now in matching_statistics(sam, words):
        i, s, length = now
        if not (i == previous[0] + 1 and length == previous[2] + 1):
            close(*previous)
        previous = now
        for t in sam.phrases[s]:
            if sam.lengths[t] <= length:
                places.append((sam.labels[t], i - sam.lengths[t] + 1))
    close(*previous)
    spans = []
    for t, a, b, ta, tb, covered, foreign in chain_anchors(anchors, max_gap):
        cover = covered / (sam.lengths[t] + FOREIGN * foreign)
        if cover >= (1 if sam.lengths[t] <= SHORT else min_cover):
            spans.append({"label": sam.labels[t], "start": a, "end": b, "template_start": ta, "template_end": tb, "cover": cover})
    spans.sort(key=lambda x: (x["start"], x["end"], x["label"], -x["cover"]))
    return places, spans


SPAN = pa.struct(
    [
        ("label", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("template_start", pa.int64()),
        ("template_end", pa.int64()),
        ("cover", pa.float64()),
    ]
)
PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    base_phrases=BASE_PHRASES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``base_places`` and ``spans``.

    ``base_places``: array of (label, start) of every place of a base phrase.
    ``spans``: array of covered template spans (text words start to end, end
    exclusive).  Texts are read whole, however long.  Spans of one template do
    not overlap; of equally good chains the one that starts later is taken.  NULL,
    empty and wordless texts have 0 words and empty arrays; ids may be NULL or
    repeated; an empty table gives no rows; other columns are ignored.
    """
    sam = build_automaton(templates, base_phrases)

    def run(batches):
        for batch in batches:
            n_words, places, spans = [], [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                p, s = scan(sam, words, min_match, max_gap, min_cover)
                n_words.append(len(words))
                places.append([{"label": label, "start": at} for label, at in p])
                spans.append(s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(places, pa.list_(PLACE)),
                    pa.array(spans, pa.list_(SPAN)),
                ],
                names=["id", "n_words", "base_places", "spans"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    out = (
        f"id {id_type}, n_words long, base_places array<struct<label:string,start:long>>, "
        "spans array<struct<label:string,start:long,end:long,template_start:long,template_end:long,cover:double>>"
    )
    found = map_arrow(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), run, out)
    return found.withColumnRenamed("id", id_col)
