"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates become lower-case words (letters and digits) and 5-word shingles. For
each class of template sizes a text is laid out in blocks of as many shingles as the largest
template of the class has, and every two neighbouring blocks are a window: so some window
holds any whole template and at most three times its shingles, a Jaccard similarity of 1/3 at least. With
``bands`` bands of one MinHash value each the template is missed with probability (2/3) ** bands,
2e-6 for 32. At containment 0.8 inside one window the similarity is 0.25 at least, a miss of 0.75 ** 32 = 1e-4; a
notice that foreign words split is retrieved by its parts: by one with 0.4 of the shingles, 1/9 and a
miss of 0.023. Candidates are verified on the full shingle sets: the share of the template's shingles
in the window, or else in the whole text, must be ``containment`` or more.

Edge cases: null text is empty; texts under five words hold no template; a template under five words is an
error. Repeated rows give repeated results, null ids stay null. Whole texts are read, whatever
their length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .hashing import mix, salt, words

WIDTH = 5
BATCH = 1 << 20

#: Notices that name or grant a license, as they are commonly written.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

#: Letters and digits in lower case, bytes of other scripts as they are, everything else a space.
LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word number) of every shingle, in order."""
    h, doc = words(texts, LETTERS)
    n = len(h) - WIDTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    out = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        out = mix(out * salt(1) + h[i : n + i] + np.uint64(i + 1))
    many = np.bincount(doc, minlength=len(texts))
    number = np.arange(n) - (np.cumsum(many) - many)[doc[:n]]
    whole = doc[WIDTH - 1 :] == doc[:n]
    return out[whole], doc[:n][whole], number[whole]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], bands: int):
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(shingles([t.encode()])[0]) for _, t in templates]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs at least {WIDTH} words")
        self.bands = bands
        # Size classes: the largest has at most 1.5 times the shingles of the smallest.
        order = sorted(range(len(self.sets)), key=lambda i: len(self.sets[i]))
        self.classes: list[list[int]] = []
        for i in order:
            if self.classes and len(self.sets[i]) <= 1.5 * len(self.sets[self.classes[-1][0]]):
                self.classes[-1].append(i)
            else:
                self.classes.append([i])

    def value(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return mix(hashes + salt(band + 1))

    def scan(self, texts: list[bytes], containment: float) -> list[tuple[int, int, float, int]]:
        """(text number, template, containment, first word of the window) of the verified windows."""
        h, doc, number = shingles(texts)
        if not len(h):
            return []
        values = [self.value(h, b) for b in range(self.bands)]
        out = []
        for ids in self.classes:
            size = max(len(self.sets[i]) for i in ids)
            # Blocks start at multiples of ``size`` within each text.
            first = np.flatnonzero((number % size == 0))
            pair = np.flatnonzero(doc[first[1:]] == doc[first[:-1]])
            single = np.setdiff1d(np.arange(len(first)), np.concatenate([pair, pair + 1]))
            ends = np.append(first[1:], len(h))
            hits: set[tuple[int, int, int]] = set()
            for b in range(self.bands):
                low = np.minimum.reduceat(values[b], first)
                windows = np.minimum(low[pair], low[pair + 1])
                for i in ids:
                    want = self.value(self.sets[i], b).min()
                    hits |= {(i, int(first[p]), int(ends[p + 1])) for p in pair[windows == want]}
                    hits |= {(i, int(first[p]), int(ends[p])) for p in single[low[single] == want]}
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for i, lo, hi in hits:
                share = float(np.isin(self.sets[i], h[lo:hi]).mean())
                if share >= containment:
                    out.append((int(doc[lo]), i, share, int(number[lo])))
                key = int(doc[lo]), i
                best[key] = max(best.get(key, (0.0, 0)), (share, -int(number[lo])))
            # Words put into a notice spread it over several windows.
            for (d, i), (share, word) in best.items():
                if share < containment:
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    share = float(np.isin(self.sets[i], h[lo:hi]).mean())
                    if share >= containment:
                        out.append((d, i, share, -word))
        return out


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = 0.8, bands: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and license found: doc_id, license, containment (of its best
    template) and word (number of the first word of the window where that is first)."""
    index = Templates(templates, bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            ids = b["doc_id"].astype("Int64")
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < BATCH):
                    size += len(texts[stop])
                    stop += 1
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for d, i, share, word in index.scan(texts[start:stop], containment):
                    key = (start + d, index.names[i])
                    best[key] = max(best.get(key, (0.0, 0)), (share, -word))
                found = sorted(best.items())
                yield pd.DataFrame({
                    "doc_id": ids.iloc[[k[0] for k, _ in found]].reset_index(drop=True),
                    "license": pd.Series([k[1] for k, _ in found], dtype=object),
                    "containment": pd.Series([v[0] for _, v in found], dtype=float),
                    "word": pd.Series([-v[1] for _, v in found], dtype="int64"),
                })
                start = stop

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id long, license string, containment double, word long")
