"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts are cut into words of digits, letters and non-ASCII characters,
lower-cased in A-Z. A document matches a template where a window of
``SLACK`` times the template's words has at least ``CONTAINMENT`` of the
template's distinct shingles of ``SHINGLE`` words (a template of fewer words
is one shingle).

Retrieval. Windows of 2^k shingles overlap by three quarters. A template looks
at the least k whose windows, at this overlap, hold any such region whole; so
some window's Jaccard similarity with the template is at least ``similarity``,
and one of ``BANDS`` bands of one MinHash agrees with probability at least
``collision_probability(similarity)`` (over 0.999 for all templates here; more
rows a band would ask for far more bands). Minima of all window sizes come
from doubling: the minimum over 2^(k+1) shingles is that of two over 2^k.

Minima are looked up in the sorted minima of all templates, so a scan costs the
same for ten templates and ten thousand. Verification counts shingles as words,
not hashes, around retrieved windows.

The templates here are whole short licenses (MIT, BSD, ISC), the notices and
headers that other licenses ask for, one-line mentions and SPDX lines; ``scan``
takes any others, also as a table.

Defined cases: null and empty texts match nothing; repeated template ids add
their texts as separate templates of one id; templates without words are
passed over, those with a null id too; overlapping windows of one template
merge to one match; repeated rows each get their row; clashing columns give way.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import extended, raw, table, without
from factloom.llm.decontaminate import words

SHINGLE = 5
CONTAINMENT = 0.8
SLACK = 1.25
BANDS = 32
PIECE = 1 << 16
CACHE = 1 << 20
TEMPLATE_BYTES = 32 << 20

#: Wording of public licenses and license notices.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("cc0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)
#: Names of licenses as one-line notices say them, and their identifiers.
NAMES = (
    ("bsd-2-clause", "BSD 2-Clause License"), ("bsd-3-clause", "BSD 3-Clause License"), ("isc", "ISC License"), ("mpl-2.0", "Mozilla Public License 2.0"), ("unlicense", "The Unlicense"),
    ("cc-by-4.0", "CC BY 4.0"), ("cc-by-sa-4.0", "CC BY-SA 4.0"), ("cc-by-nc-4.0", "CC BY-NC 4.0"), ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"), ("cc-by-nd-4.0", "CC BY-ND 4.0"),
)
SPDX = "Apache-2.0 MIT GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense Zlib BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
TEMPLATES = (*NOTICES, *((k, f"Licensed under {name}.") if name.startswith(("CC", "The")) else (k, f"Licensed under the {name}.") for k, name in NAMES), *((x.lower(), f"SPDX-License-Identifier: {x}") for x in SPDX))


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """That a window of this Jaccard similarity agrees with the template in a band."""
    return 1 - (1 - similarity) ** bands


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 1)
        return out


@cache
def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(own: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(own) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h + own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class Template:
    def __init__(self, license_id: str, seq: list[bytes], hashed: np.ndarray):
        self.id, self.size = license_id, min(SHINGLE, len(seq))
        n = len(seq) - self.size + 1
        self.shingles = {s: k for k, s in enumerate(dict.fromkeys(tuple(seq[i : i + self.size]) for i in range(n)))}
        self.need = math.ceil(CONTAINMENT * len(self.shingles) - 1e-9)
        self.span = max(1, math.ceil(SLACK * len(seq)) - self.size + 1)  # shingles in a region
        # The stride is a quarter window: three quarters must hold the region.
        self.level = max(2, math.ceil(math.log2(4 * self.span / 3)))
        own = np.unique(_hashes(hashed, self.size))
        self.mins = [int((own * a).min()) for a in _multipliers()]

    @property
    def similarity(self) -> float:
        return self.need / ((1 << self.level) + len(self.shingles) - self.need)

    def verify(self, seq: list[bytes], low: int, high: int) -> list[tuple[int, int, int]]:
        """``(start word, end word, most shingles in a window)`` of the merged matches in seq[low:high]."""
        at = [(i, k) for i in range(low, min(high, len(seq) - self.size + 1)) if (k := self.shingles.get(tuple(seq[i : i + self.size]))) is not None]
        out: list[tuple[int, int, int]] = []
        held: dict[int, int] = {}
        left = 0
        for i, k in at:
            held[k] = held.get(k, 0) + 1
            while at[left][0] <= i - self.span:
                old = at[left][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                left += 1
            if len(held) >= self.need:
                start, end, n = at[left][0], i + self.size, len(held)
                if out and start < out[-1][1]:
                    start, n = out[-1][0], max(n, out[-1][2])
                    out.pop()
                out.append((start, end, n))
        return out


class Lookup:
    """Templates by their minimum of one band: a filter of 2^16 bits on the high bits, then a search in the sorted minima,
    so a window costs the same whatever the number of templates."""

    def __init__(self, mins: np.ndarray, templates: np.ndarray):
        order = mins.argsort(kind="stable")
        self.mins, self.templates = mins[order], templates[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.mins >> np.uint64(48)] = True

    def hits(self, low: np.ndarray):
        """``(position, template)`` of every window minimum that is a template's."""
        for i in np.flatnonzero(self.filter[low >> np.uint64(48)]).tolist():
            a, b = np.searchsorted(self.mins, low[i], "left"), np.searchsorted(self.mins, low[i], "right")
            for t in self.templates[a:b].tolist():
                yield i, t


class Templates:
    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.hash = WordHash()
        self.all = []
        for license_id, text in items:
            seq = words(text and text.encode())
            if seq and license_id is not None:
                self.all.append(Template(license_id, seq, self._ids(seq)))
        groups: dict[tuple[int, int], list[int]] = {}
        for t, own in enumerate(self.all):
            groups.setdefault((own.size, own.level), []).append(t)
        #: By shingle size and level: a lookup for each band.
        self.tables: dict[int, dict[int, list[Lookup]]] = {}
        for (size, level), ts in groups.items():
            self.tables.setdefault(size, {})[level] = [Lookup(np.array([self.all[t].mins[k] for t in ts], np.uint64), np.array(ts)) for k in range(BANDS)]

    def _ids(self, seq: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash.__getitem__, seq), np.uint64, len(seq))

    def retrieve(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Ranges of words around the windows that agree with a template in a band."""
        found: dict[int, set[tuple[int, int]]] = {}
        for size, levels in self.tables.items():
            if len(ids) < size:
                continue
            whole = _hashes(ids, size)
            top = max(levels)
            # Pieces overlap by the largest window; the last windows of the text may be shorter.
            for base in range(0, len(whole), PIECE):
                part = np.full(PIECE + (1 << top), np.uint64(2**64 - 1))
                own = whole[base : base + len(part)]
                for band, a in enumerate(_multipliers()):
                    part[: len(own)] = own
                    part[: len(own)] *= a
                    low = np.minimum(part[:-1], part[1:])  # of two shingles, at every position
                    for level in range(2, top + 1):
                        # Windows of 2^level shingles start a quarter window apart, so each level has half as many.
                        low = np.minimum(low[:-2], low[2:]) if level == 2 else np.minimum(low[:-4:2], low[4::2])
                        if level in levels:
                            stride, width = 1 << (level - 2), 1 << level
                            for i, t in levels[level][band].hits(low):
                                start = base + i * stride
                                found.setdefault(t, set()).add((start, start + width))
        out: dict[int, list[tuple[int, int]]] = {}
        for t, ranges in found.items():
            more, merged = self.all[t].span, []
            for a, b in sorted(ranges):
                a, b = max(0, a - more), b + more
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            out[t] = merged
        return out

    def matches(self, texts: list[bytes | None], *, exhaustive: bool = False) -> list[list[tuple[str, int, int, float]]]:
        """``(id, start word, end word, containment)`` of each text, by start; ``exhaustive`` verifies everywhere.

        Retrieval runs over the texts end to end: a window over a border is as long as any other,
        so the similarity that it must have is the same; verification stays within a text."""
        seqs = [words(t) for t in texts]
        ends = np.cumsum([len(s) for s in seqs])
        starts = ends - [len(s) for s in seqs]
        out: list[set] = [set() for _ in seqs]

        def verify(t: int, d: int, low: int, high: int) -> None:
            x = self.all[t]
            out[d].update((x.id, a, b, n / len(x.shingles)) for a, b, n in x.verify(seqs[d], max(0, low), high))

        if exhaustive:
            for t in range(len(self.all)):
                for d, seq in enumerate(seqs):
                    verify(t, d, 0, len(seq))
        elif len(ends) and ends[-1]:
            whole = np.concatenate([self._ids(s) for s in seqs])
            for t, ranges in self.retrieve(whole).items():
                for low, high in ranges:
                    for d in range(np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")):
                        verify(t, d, low - starts[d], high - starts[d])
        return [sorted(x, key=lambda m: (m[1], m[0], m[2], m[3])) for x in out]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, *, text: str = "text", keep_text: bool = True, most_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """``docs`` with ``matches``: license, words (end exclusive) and containment. One pass, no shuffle.

    ``templates`` are pairs, or a table ``(license, text)``; they go to every task, so a table
    of over ``most_bytes`` of text is an error.
    """
    docs = without(docs, "matches")
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        if size > most_bytes:
            raise ValueError(f"{size} bytes of templates are more than {most_bytes}")
        templates = [(r.license, r.text) for r in templates.select("license", "text").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(list(templates))
    item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        own = Templates(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [[dict(zip(("license", "start", "end", "containment"), m, strict=True)) for m in ms] for ms in own.matches(raw(part, text))]
                yield extended(part, () if keep_text else (text,), matches=pa.array(found, pa.list_(item)))

    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    kind = T._parse_datatype_string("array<struct<license:string,start:bigint,end:bigint,containment:double>>")
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("matches", kind)]))


def op1_license_windows(spark, sf_dir):
    """One row per document: its license matches, their ids and where they are."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    place = lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(F.transform("matches", place), ",").alias("spans"),
    )
