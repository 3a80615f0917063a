"""Licence scans with a positional rare-token index.

The index holds the words of every template with their positions, and a word's weight: its inverse document frequency over
the templates. Every template has a mandatory phrase (a *phrase* template is its own), and is posted under that phrase's rarest
word. A file's rare licence words are looked up; a posting counts if the phrase stands around it, word by word. Only then the template's
other words are looked up in the file, the heaviest first, and the template is given up as soon as those that the file lacks weigh more than
may be missing. The postings of all its words near the phrase are intersected by relative position (file position minus template
position), up to a few words of ``slack``, so that an inserted, lost or changed word doesn't break them: a group of them goes on only
if the words in it weigh the share ``least``. The words around the group are then aligned with the template (the heaviest common
subsequence within the slack). An alignment counts if its share of the template's weight reaches ``least`` and all mandatory phrases of
the template stand inside it. A phrase template has ``least`` 1 and no slack: its words stand at their places or don't.

The index is built from the templates alone, which are few and fixed, so its size doesn't depend on the
documents; documents are scanned whole, each by itself, without a shuffle.

Defined cases: a null or empty text has no words, no labels and a score of 0. A very long text is scanned whole, as one row. Overlapping
places of a phrase all count; of overlapping alignments of another template the one with the greatest share stays, the first of
ties. Every input row gives one output row, repeated rows too; only the id and text columns are read. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record_batch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z only; a word is a run of ASCII letters and digits and of all non-ASCII characters."""
    return WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Template:
    """least: the share of the template's weight that must match in order. keys: phrases that must stand inside."""

    label: str
    text: str
    least: float = 1.0
    keys: tuple[str, ...] = ()
    base: bool = False


# The base phrases and their labels.
BASE_PHRASES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

# Notices of public licences, with the phrases that tell them apart.
NOTICES = (
    Template(
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
        0.7,
        ("gnu affero general public license",),
    ),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", 0.7, ("affero general public license",)),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
        0.7,
        ("apache license",),
    ),
    Template(
        "artistic-2",
        "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
        0.7,
        ("artistic license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        0.7,
        ("source and binary forms",),
    ),
    Template(
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered "
        "by this license the software to use reproduce display distribute execute and transmit the software",
        0.7,
        ("person or organization",),
    ),
    Template("bsl-1", "distributed under the boost software license version 1 0", 0.7, ("boost software license",)),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", 0.8, ("creative commons attribution",)),
    Template(
        "cc-by-nc",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
        0.8,
        ("attribution noncommercial",),
    ),
    Template(
        "cc-by-nc-sa",
        "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license",
        0.8,
        ("noncommercial sharealike",),
    ),
    Template("cc-by-nd", "this work is licensed under the creative commons attribution noderivatives 4 0 international license", 0.8, ("attribution noderivatives",)),
    Template("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", 0.8, ("attribution sharealike",)),
    Template("cc-by-sa", "licensed under cc by sa", 0.8, ("cc by sa",)),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        0.7,
        ("related or neighboring rights",),
    ),
    Template("cc0", "creative commons zero v1 0 universal", 0.7, ("creative commons zero",)),
    Template(
        "cddl-1",
        "the contents of this file are subject to the terms of the common development and distribution license",
        0.7,
        ("common development and distribution license",),
    ),
    Template(
        "epl-2",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        0.7,
        ("eclipse public license",),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version",
        0.7,
        ("gnu general public license", "version 2"),
    ),
    Template("gpl-2", "under the terms of the gnu general public license version 2", 0.7, ("gnu general public license", "version 2")),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version",
        0.7,
        ("gnu general public license", "version 3"),
    ),
    Template("gpl-3", "licensed under the gnu general public license version 3", 0.7, ("gnu general public license", "version 3")),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        0.7,
        ("with or without fee",),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation",
        0.7,
        ("gnu lesser general public license",),
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", 0.7, ("gnu lesser general public license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software",
        0.7,
        ("permission is hereby granted", "without restriction"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
        "obtain one at",
        0.7,
        ("mozilla public license",),
    ),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 0.7, ("open font license",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        0.7,
        ("released into the public domain",),
    ),
    Template("wtfpl", "do what the fuck you want to public license", 0.7, ("you want to public license",)),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software",
        0.7,
        ("in no event will the authors",),
    ),
)


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


class Index:
    """Postings of the rare words of all templates."""

    def __init__(self, templates: Iterable[Template]):
        self.templates = tuple(templates)
        self.words = [words_of(t.text) for t in self.templates]
        df = Counter(w for ws in self.words for w in set(ws))
        self.idf = {w: math.log((1 + len(self.words)) / c) + 1 for w, c in df.items()}
        self.total = [sum(self.idf[w] for w in ws) for ws in self.words]
        self.keys = [[words_of(k) for k in t.keys] for t in self.templates]
        self.slack = [0 if t.least >= 1 else max(2, len(ws) // 8) for t, ws in zip(self.templates, self.words, strict=True)]
        self.places: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in self.words]
        #: a rare word's postings: (template, its place in the template's mandatory phrase, the phrase)
        self.postings: dict[bytes, list[tuple[int, int, list[bytes]]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for at, w in enumerate(ws):
                self.places[t][w].append(at)
            phrase = self.keys[t][0] if self.keys[t] else ws
            at = max(range(len(phrase)), key=lambda k: (self.idf.get(phrase[k], math.inf), -k))
            self.postings[phrase[at]].append((t, at, phrase))
        self.heaviest = [sorted(own, key=lambda w: (-self.idf[w], w)) for own in self.places]
        self.rare = frozenset(self.postings)
        self.known = frozenset(self.idf)

    def phrases(self, words: list[bytes]) -> dict[int, list[int]]:
        """Of each template, where its mandatory phrase stands."""
        found: dict[int, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.rare:
                for t, place, phrase in self.postings[w]:
                    if at >= place and words[at - place : at - place + len(phrase)] == phrase:
                        found[t].append(at - place)
        return found

    def proposals(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, least, greatest relative position) of every group of postings that can reach the template's share."""
        stand = self.phrases(words)
        if not stand:
            return []
        there: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.known:
                there[w].append(at)
        found = []
        for t, starts in stand.items():
            if not self.slack[t]:
                found += [(t, at, at) for at in starts]
                continue
            need = self.templates[t].least * self.total[t] - 1e-9
            spare = self.total[t] - need
            for w in self.heaviest[t]:
                spare -= 0 if w in there else self.idf[w] * len(self.places[t][w])
                if spare < 0:
                    break
            if spare >= 0:
                found += self._groups(t, starts, there, need)
        return found

    def _groups(self, t: int, starts: list[int], there: dict[bytes, list[int]], need: float) -> list[tuple[int, int, int]]:
        """The groups within reach of the phrase: a span that holds it is no longer than the template and its slack on both sides."""
        reach, met = len(self.words[t]) + 2 * self.slack[t], set()
        for w, places in self.places[t].items():
            at = there.get(w, ())
            for s in starts:
                near = at[bisect_left(at, s - reach) : bisect_right(at, s + reach)]
                met.update((x - p, p) for x in near for p in places)
        own, found, end = sorted(met), [], 0
        for begin, (low, _) in enumerate(own):
            if begin and low == own[begin - 1][0]:
                continue
            while end < len(own) and own[end][0] <= low + 2 * self.slack[t]:
                end += 1
            if sum(self.idf[self.words[t][p]] for p in {p for _, p in own[begin:end]}) >= need:
                found.append((t, low, own[end - 1][0]))
        return found

    def aligned(self, t: int, words: list[bytes], low: int, high: int) -> tuple[float, int, int]:
        """(share, first, end) of the heaviest common subsequence of template t and the words around the relative positions low to high."""
        want, slack = self.words[t], self.slack[t]
        begin, end = max(0, low - slack), min(len(words), high + slack + len(want))
        if not slack:
            return (1.0 if words[low : low + len(want)] == want and low >= 0 else 0.0), low, low + len(want)
        own = words[begin:end]
        # best[j]: (weight, -first position) with words up to j; the least span wins ties
        best = [(0.0, 0)] * (len(own) + 1)
        for i, w in enumerate(want):
            row = [best[0]]
            for j, x in enumerate(own):
                at = max(best[j + 1], row[j])
                if x == w and low - slack <= begin + j - i <= high + slack:
                    weight, first = best[j]
                    at = max(at, (weight + self.idf[w], first if weight else -(begin + j)))
                row.append(at)
            best = row
        weight, first = best[-1]
        last = next((j for j in range(len(own) + 1) if best[j] == best[-1]), 0)
        return weight / self.total[t], -first, begin + last

    def alignments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start word, share of weight) of every alignment that meets the template's terms."""
        if self.rare.isdisjoint(words):
            return []
        met: dict[int, list[tuple[float, int, int]]] = {}
        for t, low, high in self.proposals(words):
            share, first, end = self.aligned(t, words, low, high)
            if share >= self.templates[t].least - 1e-9 and all(holds(words[first:end], k) for k in self.keys[t]):
                met.setdefault(t, []).append((-share, first, end))
        found = []
        for t, own in met.items():
            taken: list[tuple[int, int]] = []
            for share, first, end in sorted(set(own)):
                if not self.slack[t] or all(end <= a or b <= first for a, b in taken):
                    taken.append((first, end))
                    found.append((t, first, min(1.0, -share)))
        return found

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, float, bool]]]:
        """Number of words, and (label, start word, share, base) of every match in order of start."""
        words = words_of(text or "")
        hits = [(self.templates[t].label, s, x, self.templates[t].base) for t, s, x in self.alignments(words)]
        return len(words), sorted(hits, key=lambda h: (h[1], h[0]))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,start:long,share:double,base:boolean>>"
)


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = BASE_PHRASES + NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and labels of the base phrases, all labels, and every match with its place."""
    templates = tuple(templates)
    built: list[Index] = []

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(Index(templates))
        rows = []
        for t in batch.column(1).to_pylist():
            n, hits = built[0].scan(t)
            base = [h for h in hits if h[3]]
            starts = [h[1] for h in base]
            rows.append(
                (
                    n,
                    len(base),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(sorted({h[0] for h in base})),
                    ",".join(sorted({h[0] for h in hits})),
                    max((h[2] for h in hits), default=0.0),
                    [dict(zip(("label", "start", "share", "base"), h, strict=True)) for h in hits],
                )
            )
        n, base, first, last, base_labels, labels, score, matches = zip(*rows, strict=True) if rows else [()] * 8
        match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())])
        return record_batch(
            {
                "doc_id": (batch.column(0).cast(pa.int64()), pa.int64()),
                "n_words": (n, pa.int64()),
                "n_base": (base, pa.int64()),
                "first_word": (first, pa.int64()),
                "last_word": (last, pa.int64()),
                "base_labels": (base_labels, pa.string()),
                "labels": (labels, pa.string()),
                "score": (score, pa.float64()),
                "matches": (matches, pa.list_(match)),
            }
        )

    return map_batches(docs.select(doc_id, text), scan, SCHEMA)
