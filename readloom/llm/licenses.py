"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased runs of ASCII letters and digits and of bytes beyond ASCII. A template is found where a window of as many
words as it has holds at least `CONTAINMENT` of its distinct shingles of five words. For that Jaccard similarity is
CONTAINMENT / (2 - CONTAINMENT) at least; the number of bands follows from it, the rows of a band and the target chance of a
shared band. Windows start at every word, so they overlap in all but one. Only windows with at least one shingle of some
template are signed, which no match lacks.

Defined cases: a null or empty text has no match; null and repeated doc_ids are carried along, each row for itself; a template
of fewer than five words is an error; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import wordscan as ws
from readloom.llm.common import broadcast, col_of, slices
from readloom.llm.decontam import lowered_words

SHINGLE, CONTAINMENT, ROWS, TARGET = 5, 0.8, 2, 0.999
#: So many windows are signed at a time.
WINDOWS = 4096
FOUND = "doc_id long, license string, n_places int, first_word long, last_word long, containment double"

#: Public license notices by their SPDX identifiers.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def bands_for(containment: float = CONTAINMENT, rows: int = ROWS, target: float = TARGET) -> int:
    """As many bands as share one with the target chance at the least similarity of a match."""
    similarity = containment / (2 - containment)
    return math.ceil(math.log(1 - target) / math.log(1 - similarity**rows))


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """windows x shingles (0: none) -> windows x bands."""
    out = np.zeros((len(shingles), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(shingles), b, np.uint64)
            for r in range(rows):
                h = ws.mix(shingles ^ ws.mix(np.uint64(b * rows + r + 1)))
                key = ws.mix(key * ws.MULT + np.where(shingles == 0, np.uint64(2**64 - 1), h).min(axis=1))
            out[:, b] = key
    return out


class Index:
    """The templates by length in words: a window length needs windows of its own."""

    def __init__(self, templates: dict[str, list[str]], containment: float, rows: int, target: float):
        self.containment, self.rows, self.bands = containment, rows, bands_for(containment, rows, target)
        names = [name for name, texts in templates.items() for _ in texts]
        w = lowered_words(pa.array([t for texts in templates.values() for t in texts]))
        self.templates: list[tuple[str, int, np.ndarray]] = []
        for i, name in enumerate(names):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h) < SHINGLE:
                raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
            self.templates.append((name, len(h), np.unique(ws.grams(h, SHINGLE))))
        self.shingles = np.unique(np.concatenate([s for _, _, s in self.templates]))
        self.tables: dict[int, dict[int, list[int]]] = {}
        for t, (_, n, s) in enumerate(self.templates):
            for key in band_hashes(s[None, :], self.bands, rows)[0].tolist():
                self.tables.setdefault(n, {}).setdefault(key, []).append(t)


def find(w: ws.Words, index: Index) -> list[tuple[int, int, int, float]]:
    """(text, template, first word, containment) of every window that holds a template, not more than one for each start."""
    g = ws.grams(w.hash, SHINGLE)
    if not len(g):
        return []
    maybe = np.zeros(1 << 18, bool)
    maybe[index.shingles & np.uint64((1 << 18) - 1)] = True
    within = ws.gram_starts(w, SHINGLE)
    some = np.flatnonzero(maybe[g & np.uint64((1 << 18) - 1)] & within)
    some = some[np.isin(g[some], index.shingles)]
    out: list[tuple[int, int, int, float]] = []
    if not len(some):
        return out
    for n, table in index.tables.items():
        m = n - SHINGLE + 1
        start = np.unique(np.concatenate([some - j for j in range(m)]))
        start = start[start >= 0]
        # A window is cut by the ends of its text, so a start before it moves to its first word.
        ahead = np.minimum(start + m - 1, len(g) - 1)
        start = np.unique(np.maximum(start, np.where(w.doc[start] != w.doc[ahead], np.where(np.isin(start, some), start, w.first[w.doc[ahead]]), start)))
        for part in np.array_split(start, math.ceil(len(start) / WINDOWS)):  # a text of nothing but licenses has many
            at = part[:, None] + np.arange(m)[None, :]
            inside = at < len(g)
            at = np.minimum(at, len(g) - 1)
            inside &= (w.doc[at] == w.doc[part][:, None]) & within[at]
            window = np.where(inside, g[at], np.uint64(0))
            for row, keys in enumerate(band_hashes(window, index.bands, index.rows).tolist()):
                for t in {t for key in keys for t in table.get(key, ())}:
                    held = np.isin(index.templates[t][2], window[row]).mean()
                    if held >= index.containment:
                        out.append((int(w.doc[part[row]]), t, int(part[row] - w.first[w.doc[part[row]]]), float(held)))
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT, rows: int = ROWS, target: float = TARGET) -> DataFrame:
    """For each row of docs and license found in it: in how many places that don't overlap, and the best of them."""
    spark = docs.sparkSession
    shared = broadcast(spark, Index(templates, containment, rows, target))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        for batch in slices(batches):
            ids = col_of(batch, "doc_id").to_pylist()
            by: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
            for doc, t, first, held in find(lowered_words(col_of(batch, "text")), index):
                name, n, _ = index.templates[t]
                by.setdefault((doc, name), []).append((-held, first, n))
            found = []
            for (doc, name), places in sorted(by.items()):
                places.sort()
                taken: list[int] = []  # starts and ends in turn, ascending
                for _, first, n in places:
                    i = bisect_right(taken, first)
                    if i % 2 == 0 and (i == len(taken) or taken[i] >= first + n):
                        taken[i:i] = [first, first + n]
                held, first, n = places[0]
                found.append((ids[doc], name, len(taken) // 2, first, first + n - 1, -held))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(search, FOUND)
