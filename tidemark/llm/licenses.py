"""License scans: templates retrieved by MinHash bands over overlapping windows, verified by exact shingle containment.

Texts and templates are words of letters and digits in lower case, in shingles of five. For each power of two s that a template's size
asks for, windows of 2 s shingles start at every s-th, so any run of s shingles lies whole in one of them. A window that holds the required part of a
template has at least about a fifth of all shingles in common with it; with BANDS bands of one MinHash each, the chance that none agrees is
0.8 ** BANDS or less, below one in a thousand. What meets is verified: some run of s shingles must hold the part exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import shingle_hashes
from tidemark.llm.tokens import slices

# Fixed values: (license, notice as it is commonly written).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
BANDS = 32
WIDTH = 5
#: ASCII letters to lower case, other ASCII but digits to spaces; bytes of other letters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Templates:
    """Templates' shingles, and their MinHash values by window size."""

    def __init__(self, templates: tuple[tuple[str, str], ...], containment: float) -> None:
        self.names = [t[0] for t in templates]
        self.sets = [np.unique(shingle_hashes(words(t[1]), WIDTH)) for t in templates]
        self.needed = [max(1, int(np.ceil(containment * len(s) - 1e-9))) for s in self.sets]
        self.turns = np.random.default_rng(7).integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.sizes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.sizes.setdefault(self.run(i), []).append(i)
        self.values = np.array([[self.hashes(b, s).min() if len(s) else 0 for b in range(BANDS)] for s in self.sets], np.uint32)

    def run(self, template: int) -> int:
        """Shingles among which the required part must lie: the power of two that the template needs."""
        return 1 << (len(self.sets[template]) - 1).bit_length()

    def hashes(self, band: int, shingles: np.ndarray) -> np.ndarray:
        return ((shingles * self.turns[band]) >> np.uint64(32)).astype(np.uint32)

    def retrieve(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of the windows that agree with a template in a band."""
        found: set[tuple[int, int, int]] = set()
        top = max(self.sizes, default=0)
        for band in range(BANDS):
            low, s = self.hashes(band, shingles), 1
            while s <= top and len(low):
                if s in self.sizes:
                    window = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    for t in self.sizes[s]:
                        found.update((t, int(j) * s, (int(j) + 2) * s) for j in np.flatnonzero(window == self.values[t, band]))
                if len(low) % 2:
                    low = np.append(low, np.uint32(0xFFFFFFFF))
                low, s = np.minimum(low[::2], low[1::2]), 2 * s
        return found


def scan_texts(texts: list[str | None], templates: Templates) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, template, first word, end word, containment) of every notice found; overlapping windows of one template count once."""
    per = [shingle_hashes(words(t), WIDTH) for t in texts]
    ends = np.cumsum([len(x) for x in per])
    starts = ends - np.array([len(x) for x in per], np.int64)
    shingles = np.concatenate(per) if per else np.empty(0, np.uint64)
    spans: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for t, a, b in sorted(templates.retrieve(shingles)):
        b = min(b, len(shingles))
        hit = a + np.flatnonzero(np.isin(shingles[a:b], templates.sets[t]))
        text = np.searchsorted(ends, hit, side="right")
        for k in np.unique(text):
            mine = hit[text == k]
            # Within a run of the size that windows cover, not just within a window.
            for i, j in enumerate(np.searchsorted(mine, mine + templates.run(t))):
                held = len(np.unique(shingles[mine[i:j]])) if j - i >= templates.needed[t] else 0
                if held >= templates.needed[t]:
                    spans.setdefault((int(k), t), []).append((int(mine[i] - starts[k]), int(mine[j - 1] - starts[k]) + WIDTH, held / len(templates.sets[t])))
    for (k, t), found in sorted(spans.items()):
        found.sort()
        a, b, part = found[0]
        for x, y, p in found[1:]:
            if x < b:
                b, part = max(b, y), max(part, p)
            else:
                yield k, t, a, b, part
                a, b, part = x, y, p
        yield k, t, a, b, part


def scan(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: doc_id, license, template (number), start_word, end_word (exclusive), containment.

    Null, empty and short texts have no notice. A null id stays null, repeated rows are scanned each, long texts whole; other columns are
    ignored; an empty table gives no rows. A text that fits several templates has a row for each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, containment)
        for batch in batches:
            kind = batch.column(0).type
            for some in slices(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), 1 << 20, lambda x: len(x[1] or "")):
                found = list(scan_texts([t for _, t in some], known))
                if found:
                    c = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([some[i][0] for i in c[0]], kind), pa.array([known.names[t] for t in c[1]]), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64())],
                        names=["doc_id", "license", "template", "start_word", "end_word", "containment"],
                    )

    return rows.mapInArrow(run, f"doc_id {doc_type}, license string, template int, start_word long, end_word long, containment double")
