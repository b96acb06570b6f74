"""License scan: winnowed fingerprints in an inverted index pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits, lower-cased in A-Z. Templates and texts give a hash for each run of three words and
keep, of each three in a row, the least; a shared run of five words is thus always met. Fingerprints that agree name a
template and a diagonal; the template's words are then aligned with the text's in a band around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import CHUNK, U64, combine, mix, prefix_hash, span_hashes, word_spans

GRAM, WINDOW = 3, 3
#: The part of a template's words that a match must cover, and the widest shift within it, as a part of its length.
COVERAGE, SHIFT = 0.8, 0.1
_other = np.ones(256, dtype=bool)
_other[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Public license notices and texts, by SPDX name. ``templates`` below takes others in their place.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"],
}


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, in bytes; hashed in pieces of bounded size."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and not _other[text[end]]:
            end += 1
        data = np.frombuffer(text[at:end].lower(), dtype=np.uint8)
        start, stop = word_spans(data, _other)
        parts.append((span_hashes(prefix_hash(data), start, stop), start + at, stop + at))
        at = end
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def winnow(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the selected word runs: of each WINDOW in a row the least, the last of equals."""
    if len(w) < GRAM:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = combine(w, GRAM)
    if len(g) < WINDOW:
        k = len(g) - 1 - int(np.argmin(g[::-1]))
        return g[k : k + 1], np.array([k])
    rows = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.arange(len(rows)) + WINDOW - 1 - np.argmin(rows[:, ::-1], axis=1)
    at = np.unique(at)
    return g[at], at


class Index:
    """Fingerprints of the templates: hash to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.words, rows = [], [], []
        for name, text in templates:
            w = words(text.encode())[0]
            if len(w):
                h, at = winnow(w)
                if len(w) < GRAM + WINDOW - 1:
                    h, at = (combine(w, GRAM), np.arange(max(1, len(w) - GRAM + 1)))
                rows += [(int(x), len(self.names), int(p)) for x, p in zip(h, at)]
                self.names.append(name)
                self.words.append(w)
        rows.sort()
        self.hash = np.array([r[0] for r in rows], dtype=U64)
        self.template = np.array([r[1] for r in rows], dtype=np.int64)
        self.place = np.array([r[2] for r in rows], dtype=np.int64)
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.hash >> U64(48)).astype(np.int64)] = True

    def candidates(self, w: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) pairs, one for each run of neighbouring diagonals."""
        h, at = winnow(w)
        on = self.filter[(h >> U64(48)).astype(np.int64)]
        out: dict[tuple[int, int], int] = {}
        for x, p in zip(h[on], at[on]):
            k = int(np.searchsorted(self.hash, x))
            while k < len(self.hash) and self.hash[k] == x:
                t, d = int(self.template[k]), int(p - self.place[k])
                band = max(2, int(SHIFT * len(self.words[t])))
                out.setdefault((t, d // band), d)
                k += 1
        return sorted({(t, d) for (t, _), d in out.items()})

    def align(self, w: np.ndarray, t: int, d: int) -> tuple[int, int, int] | None:
        """(matched words, first, last place in the text) of the longest common subsequence in the band around d."""
        pattern = self.words[t]
        band = max(2, int(SHIFT * len(pattern)))
        best = np.zeros((len(pattern) + 1, 2 * band + 2), dtype=np.int64)
        for i in range(len(pattern)):
            for j in range(2 * band + 1):  # the text's word at i + d - band + j
                p = i + d - band + j
                take = best[i, j] + (1 if 0 <= p < len(w) and w[p] == pattern[i] else 0)
                skip = best[i, j + 1] if j + 1 <= 2 * band else 0
                best[i + 1, j] = max(take, skip, best[i + 1, j - 1] if j else 0)
        i, j = len(pattern), int(np.argmax(best[-1, : 2 * band + 1]))
        n, first, last = int(best[i, j]), None, None
        while i and best[i, j]:
            p = i - 1 + d - band + j
            if j and best[i, j] == best[i, j - 1]:
                j -= 1
            elif j + 1 <= 2 * band and best[i, j] == best[i - 1, j + 1]:
                i, j = i - 1, j + 1
            else:
                if 0 <= p < len(w) and w[p] == pattern[i - 1] and best[i, j] == best[i - 1, j] + 1:
                    first, last = p, p if last is None else last
                i -= 1
        return (n, first, last) if n and first is not None else None


def scan(index: Index, text: str) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of the notices in a text, in characters, ends exclusive; of overlapping ones the one with most words."""
    raw = text.encode()
    w, start, end = words(raw)
    found = []
    for t, d in index.candidates(w):
        got = index.align(w, t, d)
        if got and got[0] >= COVERAGE * len(index.words[t]):
            found.append((got[0], got[0] / len(index.words[t]), index.names[t], got[1], got[2]))
    found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
    taken: list[tuple] = []
    for x in found:
        if all(x[4] < y[3] or x[3] > y[4] for y in taken):
            taken.append(x)
    at = lambda b: len(raw[:b].decode())
    return [(name, round(c, 6), at(start[a]), at(end[b])) for _, c, name, a, b in sorted(taken, key=lambda x: (x[3], x[2]))]


SPANS = "doc_id long, spans array<struct<license:string,coverage:double,start:int,end:int>>"


def license_spans(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row of ``docs``. Null and empty texts have no spans; repeated rows repeat; other columns aren't read."""
    pairs = [(name, t) for name, texts in (templates or TEMPLATES).items() for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(pairs)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[dict(zip(("license", "coverage", "start", "end"), x)) for x in scan(index, t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SPANS)


def license_report(docs: DataFrame, **kw) -> DataFrame:
    """A row for each document: its licenses, the best coverage, and all spans as license:start:end."""
    return license_spans(docs, **kw).select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.array_sort(F.array_distinct("spans.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
