"""Licence scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates are lower-cased (A-Z), ASCII punctuation counts as white
space, and words are cut into ``K``-word shingles.  Templates are grouped by
size; for templates of at most m shingles, and at least m / ``GROWTH``, a text is
cut into windows of 2m shingles, a new one every m, so that any m neighbouring
shingles lie whole in a window.  A window that holds a share c of a template has
a Jaccard similarity of at least c / (2 * GROWTH + 1 - c) with it (c = 0.8:
0.28); with ``BANDS`` bands of one hash each, 1 - 0.72 ** 40 > 0.999998 of
such windows meet their template.  Bands are looked up by value; a text without a
single shingle of any template can't meet one and is passed over.  A window
that meets a template is verified exactly: the share of the template's shingles
that are in the window, and the phrases that tell the licence's version or variant from its
kin, among the words that match.  Of licences whose matches overlap the one with
the most matching shingles stays.

Null and empty texts match nothing.  Each input row gives one row, repeated rows
included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, read
from ._text import U64, binary_rows, splitmix, window_hashes, word_hashes

K, BANDS, CONTAINED, GROWTH = 3, 40, 0.8, 1.3
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"


def _gnu(name: str, version: str) -> tuple[str, ...]:
    return (f"This work is licensed under the GNU {name}General Public License, version {version}.", _GNU.format(name, version))


def _cc(name: str, short: str) -> tuple[str, ...]:
    return (f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{short.lower()}/4.0/")


#: Notices and texts as their licences word them.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "CC-BY-4.0": _cc("Attribution", "BY"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    "BSD-2-Clause": (f"{_BSD}: {_BSD2} {_BSD_AS_IS}",),
    "BSD-3-Clause": (_BSD, f"{_BSD}: {_BSD2} {_BSD3} {_BSD_AS_IS}"),
    "ISC": (_ISC, f"{_ISC}. {_ISC_AS_IS}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
#: One of a licence's phrase sets must be whole among the matching words.
MARKS = {
    "MIT": (("mit license",), ("sublicense and or",)), "Apache-2.0": (("apache license version 2 0",), ("licenses license 2 0",)),
    "GPL-2.0": (("gnu general", "version 2"),), "GPL-3.0": (("gnu general", "version 3"),), "LGPL-2.1": (("lesser general", "version 2 1"),), "LGPL-3.0": (("lesser general", "version 3"),), "AGPL-3.0": (("affero general", "version 3"),),
    "MPL-2.0": (("mozilla public license v 2 0",),),
    **{
        f"CC-{short}-4.0": ((f"cc {short} 4 0".lower().replace("-", " "),), (f"{name} 4 0",))
        for short, name in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-ND", "attribution noderivatives"), ("BY-NC", "attribution noncommercial"), ("BY-NC-SA", "noncommercial sharealike"), ("BY-NC-ND", "noncommercial noderivatives"))
    },
}


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(_TO_SPACE))


def shingles(text: bytes) -> np.ndarray:
    return window_hashes(words_of(text), K)


@dataclass
class Templates:
    """Templates of at most m shingles: names, their distinct shingles, their band values, and their sets of phrases (as hashes of words)."""

    m: int
    names: list[str]
    sets: list[np.ndarray]
    bands: np.ndarray
    marks: list[list[list[np.ndarray]]]


_SEEDS = splitmix(np.arange(7, 7 + BANDS, dtype=U64)) | U64(1)


def _band(values: np.ndarray, k: int) -> np.ndarray:
    return (values * _SEEDS[k]) >> U64(32)


def prepare(templates: dict[str, tuple[str, ...]] = TEMPLATES, marks: dict = MARKS) -> list[Templates]:
    every = sorted(((len(s), name, np.unique(s)) for name, texts in templates.items() for text in texts if len(s := shingles(text.encode()))), key=lambda x: (-x[0], x[1]))
    groups: list[list] = []
    for size, name, found in every:
        if not groups or groups[-1][0][0] > GROWTH * size:
            groups.append([])
        groups[-1].append((size, name, found))
    told = {name: [[words_of(p.encode()) for p in phrases] for phrases in marks.get(name, ((),))] for name in templates}
    return [Templates(g[0][0], [n for _, n, _ in g], [s for *_, s in g], np.array([[_band(s, k).min() for k in range(BANDS)] for *_, s in g]), [told[n] for _, n, _ in g]) for g in reversed(groups)]


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([words[j : j + n] == w for j, w in enumerate(phrase)]).any())


def _met(g: Templates, every: np.ndarray, start: np.ndarray, follows: np.ndarray) -> list[tuple[int, int]]:
    """(template, window) of equal band values."""
    met: set[tuple[int, int]] = set()
    for k in range(BANDS):
        low = np.minimum.reduceat(_band(every, k), start)
        low[:-1] = np.where(follows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
        order = np.argsort(g.bands[:, k], kind="stable")
        first, last = (np.searchsorted(g.bands[order, k], low, side) for side in ("left", "right"))
        for w in np.flatnonzero(last > first).tolist():
            met.update((int(t), w) for t in order[first[w] : last[w]])
    return sorted(met)


def scan(texts: list[bytes], groups: list[Templates]) -> list[list[dict]]:
    """For each text its licences: name, the best containment and the place (words) where that match begins."""
    out: list[list[dict]] = [[] for _ in texts]
    of_any = np.unique(np.concatenate([s for g in groups for s in g.sets])) if groups else np.empty(0, U64)
    words = [words_of(t) for t in texts]
    lists = [window_hashes(w, K) for w in words]
    seen = np.isin(np.concatenate(lists), of_any) if len(lists) else np.empty(0, bool)
    upto = np.concatenate([[0], np.cumsum(seen)])
    ends = np.cumsum([len(x) for x in lists])
    near = [d for d, e in enumerate(ends) if upto[e] > upto[e - len(lists[d])]]
    if not near:
        return out
    lengths = np.array([len(lists[d]) for d in near])
    begin = np.cumsum(lengths) - lengths
    every = np.concatenate([lists[d] for d in near])
    found: dict[int, list[tuple]] = {}
    for g in groups:
        per = -(-lengths // g.m)
        text = np.repeat(np.arange(len(near)), per)
        start = begin[text] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * g.m
        follows = np.append(text[1:] == text[:-1], False)  # the next block is of the same text
        for t, w in _met(g, every, start, follows):
            d = text[w]
            at = int(start[w] - begin[d])
            window = lists[near[d]][at : at + 2 * g.m]
            hit = np.isin(window, g.sets[t])
            share = np.isin(g.sets[t], window).mean()
            if share >= CONTAINED:
                places = np.flatnonzero(hit)
                a, b = at + int(places[0]), at + int(places[-1]) + K
                if any(all(_holds(words[near[d]][a:b], p) for p in phrases) for phrases in g.marks[t]):
                    found.setdefault(near[d], []).append((-round(share * len(g.sets[t])), -float(share), g.names[t], a, b))
    for d, matches in found.items():
        taken: list[tuple] = []
        for m in sorted(matches):
            if all(m[4] <= o[3] or m[3] >= o[4] or m[2] == o[2] for o in taken):
                taken.append(m)
        best: dict[str, dict] = {}
        for _, share, name, a, _ in sorted(taken, key=lambda m: (m[1], m[3])):
            best.setdefault(name, {"licence": name, "containment": round(-share, 6), "word": a})
        out[d] = [best[name] for name in sorted(best)]
    return out


def licence_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``licences`` array<struct<licence, containment, word>>; the templates are a bounded parameter."""
    groups = prepare(templates)
    item = pa.struct([("licence", pa.string()), ("containment", pa.float64()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scan(texts, groups), pa.list_(item))], names=[key, "licences"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, licences array<struct<licence string, containment double, word long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_matches(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.transform("licences", lambda x: x["licence"]), ",").alias("licences"), F.size("licences").alias("n_licences"), F.array_max(F.transform("licences", lambda x: x["containment"])).alias("best"))
