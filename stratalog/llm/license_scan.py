"""License scans: MinHash bands over overlapping word windows retrieve templates, exact shingle containment verifies.

For each template length there are windows of that many words, a step apart; the step is an eighth of the length, so some window
is off by half a step at most. A window's signature is a number of MinHash values, each a band of one row: a window whose
shingles have Jaccard similarity j with the template's is retrieved with probability 1 - (1 - j)^bands. An occurrence at the least
containment has a similarity that follows from the template's length; the bands are as many as give SURE there.
Retrieved windows, widened by a step on both sides, are then compared shingle by shingle.

The templates are a parameter of bounded size and are broadcast with their bands. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textbytes import LOWER, U64, byte_sums, chunks, map_batches, mix, span_hash, spaced, utf8

SHINGLE = 5
LEAST = 0.8
#: Probability of retrieving an occurrence.
SURE = 0.9999
#: Most bands; templates that need more are refused.
BANDS_MAX = 48
_SALTS = mix(np.arange(1, BANDS_MAX + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Notices as their licences word them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
}


def shingles(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of SHINGLE words in a row (letters and digits, lower case) and where each document's begin; shorter documents have none."""
    text = LOWER[text]
    edge = np.flatnonzero(np.diff(_LETTER[text], prepend=False, append=False))
    s, e = edge[0::2], edge[1::2]
    h = span_hash(byte_sums(text), s, e)
    first = np.searchsorted(s, starts)
    gram = np.zeros(len(h), dtype=np.uint64)
    for k in range(SHINGLE):
        gram[: max(0, len(h) - k)] = mix(gram[: max(0, len(h) - k)] * U64(6364136223846793005) + h[k:])
    keep = np.zeros(len(h), dtype=bool)
    for a, b in zip(first[:-1], first[1:]):
        keep[a : max(a, b - SHINGLE + 1)] = True
    return gram[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def bands_for(size: int) -> int:
    """Bands that retrieve a template of `size` shingles with probability SURE at the least containment; an error if BANDS_MAX are too few."""
    step = max(1, size // 8)
    both = np.ceil(LEAST * size) - (step // 2)
    j = both / (2 * size - both)
    bands = 1 if j >= 1 else int(np.ceil(np.log(1 - SURE) / np.log(1 - j)))
    if bands > BANDS_MAX:
        raise ValueError(f"a template of {size} shingles would need {bands} bands")
    return bands


@dataclass
class Index:
    """Templates by their number of shingles, with the values of each band."""

    names: list[str]
    sets: list[np.ndarray]
    by_size: dict[int, list[int]]
    bands: dict[int, list[tuple[np.ndarray, np.ndarray]]]


def build_index(templates: dict[str, str]) -> Index:
    """A template of fewer than SHINGLE words can't be told from chance and is refused."""
    names, sets, by_size = sorted(templates), [], {}
    for k, name in enumerate(names):
        data, offs = utf8(pa.array([templates[name]]))
        own, _ = shingles(*spaced(data, offs, 0, 1))
        if not len(own):
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
        sets.append(np.unique(own))
        by_size.setdefault(len(own), []).append(k)
    bands = {}
    for size, members in by_size.items():
        bands[size] = []
        for salt in _SALTS[: bands_for(size)]:
            low = np.array([mix(sets[k] ^ salt).min() for k in members])
            order = np.argsort(low, kind="stable")
            bands[size].append((low[order], np.array(members)[order]))
    return Index(names, sets, by_size, bands)


def scan(index: Index, gram: np.ndarray, first: np.ndarray) -> list[dict[str, float]]:
    """For each document the templates contained at LEAST or more, with the best containment."""
    out: list[dict[str, float]] = [{} for _ in range(len(first) - 1)]
    if not len(gram):
        return out
    salted = [mix(gram ^ salt) for salt in _SALTS[: max(map(len, index.bands.values()))]]
    owner = np.repeat(np.arange(len(out)), np.diff(first))
    for size, members in index.by_size.items():
        step = max(1, size // 8)
        cells = -(-size // step)
        # windows start at each step within a document and end with it
        counts = np.diff(first)
        n = -(-counts // step)
        cell = np.repeat(first[:-1] - step * (np.cumsum(n) - n), n) + step * np.arange(n.sum())
        cell_doc = np.repeat(np.arange(len(out)), n)
        last = np.append(np.cumsum(n), 0)[cell_doc] - 1
        here = np.arange(len(cell))
        hits = [np.zeros((0, 2), np.int64)]
        for values, (low, which) in zip(salted, index.bands[size]):
            least = np.minimum.reduceat(values, cell)
            window, reach = least, 1
            while reach < cells:  # the least over ever more cells, within the document
                more = min(reach, cells - reach)
                window = np.minimum(window, window[np.minimum(here + more, last)])
                reach += more
            for value, k in zip(low, which):
                at = np.flatnonzero(window == value)
                hits.append(np.stack([at, np.full(len(at), k)], axis=1))
        found = np.unique(np.concatenate(hits), axis=0)
        for k in members:  # the retrieved windows of a template, each wide enough for an occurrence that begins or ends a step off
            c = found[found[:, 1] == k, 0]
            if not len(c):
                continue
            doc = owner[cell[c]]
            a, b = np.maximum(first[doc], cell[c] - step), np.minimum(first[doc + 1], cell[c] + cells * step + step)
            place, reach = np.minimum(np.searchsorted(index.sets[k], gram), len(index.sets[k]) - 1), int((b - a).max())
            inside = np.where(index.sets[k][place] == gram, place, -1)  # the template's shingle at each place of the text
            spread = a[:, None] + np.arange(reach)
            held = np.sort(np.where(spread < b[:, None], inside[np.minimum(spread, len(gram) - 1)], -1), axis=1)
            share = ((held >= 0) & np.concatenate([np.ones((len(c), 1), bool), held[:, 1:] != held[:, :-1]], axis=1)).sum(axis=1) / len(index.sets[k])
            for d, s in zip(doc[share >= LEAST].tolist(), share[share >= LEAST].tolist()):
                out[d][index.names[k]] = max(out[d].get(index.names[k], 0.0), s)
    return out


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and `matches`: array of (template, containment), sorted by template; every row gives a row.

    A null, empty or short text has no matches; whole texts are scanned; other columns are ignored; repeated rows repeat; an empty table gives an empty
    result. Templates that are both contained are both told, also where one lies in the other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for i, j in chunks(offs):
                found = scan(shared.value, *shingles(*spaced(data, offs, i, j)))
                rows = [[{"template": t, "containment": c} for t, c in sorted(f.items())] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(rows, kind)], ["doc_id", "matches"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, matches array<struct<template:string,containment:double>>")
