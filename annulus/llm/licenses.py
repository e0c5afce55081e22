"""License notices in whole texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are compared by five-word shingles. Templates are classed by length: a class of
block size B (a power of two) holds the templates of at most B shingles and more than B / 2. A text is
cut into blocks of B shingles and each two neighbouring blocks are a window, so a notice of at most B
shingles in a row lies wholly in some window. If a window holds the share ``threshold`` of a template of
n shingles, their resemblance is at least threshold n / (2 B + (1 - threshold) n); a class has as many
bands of one MinHash as make a miss less likely than ``miss``. Block minima of a class come from those of
the class below, so all classes together cost about two passes over the hashes.

A retrieved template is verified by the distinct shingles of the window and its surroundings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 5
WORD = re.compile(r"\w+")
PART = 1 << 15  # shingles of a text taken together

# fixed values: short notices, standard headers and short licenses as their stewards publish them
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause license": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC license": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib license": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(w: list[str]) -> list[tuple[str, ...]]:
    return list(zip(w, w[1:], w[2:], w[3:], w[4:]))


class Hasher:
    """Hashes of shingles as arrays; remembers a bounded number of words."""

    def __init__(self, keep: int = 500_000):
        self.known: dict[str, int] = {}
        self.keep = keep

    def __call__(self, w: list[str]) -> np.ndarray:
        import xxhash

        if len(w) < WIDTH:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for x in set(w):
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x)
        each = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        n = len(w) - WIDTH + 1
        h = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            h = (h ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float = 0.8, miss: float = 1e-4, seed: int = 7):
        self.threshold, self.hash = threshold, Hasher()
        self.held = {}
        for name, text in templates.items():
            s = shingles(words(text))
            if s:
                self.held[name] = (s, frozenset(s))
        by_class: dict[int, list[str]] = {}
        for name, (s, _) in self.held.items():
            by_class.setdefault(max(0, (len(s) - 1).bit_length()), []).append(name)
        rng = np.random.default_rng(seed)
        self.bands: dict[int, int] = {}
        for level, names in by_class.items():
            block = 1 << level
            least = min(threshold * len(self.held[x][1]) / (2 * block + (1 - threshold) * len(self.held[x][1])) for x in names)
            self.bands[level] = 1 if block == 1 else math.ceil(math.log(miss) / math.log(1 - least))
        most = max(self.bands.values(), default=1)
        self.flip = rng.integers(1 << 63, size=most, dtype=np.uint64)
        self.odd = rng.integers(1 << 63, size=most, dtype=np.uint64) | np.uint64(1)
        # level -> (which low bits occur, (band, minimum) -> names)
        self.index: dict[int, tuple[np.ndarray, dict]] = {}
        for level, names in by_class.items():
            bits, keys = np.zeros(1 << 16, bool), {}
            for x in names:
                s = self.held[x][0]
                low = self.permuted(self.hash([v[0] for v in s] + list(s[-1][1:])), self.bands[level]).min(axis=0)
                for band, value in enumerate(low.tolist()):
                    keys.setdefault((band, value), []).append(x)
                    bits[value & 0xFFFF] = True
            self.index[level] = bits, keys

    def permuted(self, h: np.ndarray, bands: int) -> np.ndarray:
        x = (h[:, None] ^ self.flip[None, :bands]) * self.odd[None, :bands]
        return x ^ (x >> np.uint64(31))

    def candidates(self, h: np.ndarray) -> set[tuple[str, int, int]]:
        """(template, first and end shingle of a window that may hold it)."""
        found: set[tuple[str, int, int]] = set()
        top = max(self.index, default=-1)
        now = self.permuted(h, max(self.bands.values(), default=1))
        for level in range(top + 1):
            block = 1 << level
            if level:  # minima of two blocks; a last single one stays
                odd = now[-1:] if len(now) % 2 else now[:0]
                now = np.concatenate([np.minimum(now[0:-1:2], now[1::2]), odd]) if len(now) > 1 else now
            if level in self.index:
                bits, keys = self.index[level]
                n = self.bands[level]
                if block == 1 or len(now) == 1:
                    window, span = now[:, :n], block
                else:
                    window, span = np.minimum(now[:-1, :n], now[1:, :n]), 2 * block
                for i, band in zip(*np.nonzero(bits[window & np.uint64(0xFFFF)])):
                    for name in keys.get((int(band), int(window[i, band])), ()):
                        found.add((name, int(i) * block, min(int(i) * block + span, len(h))))
        return found

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment): where templates are held, by place; overlapping finds are one."""
        w = words(text)
        h = self.hash(w)
        out: dict[str, list[list]] = {}
        most = max((len(s) for s, _ in self.held.values()), default=1)
        seen = set()
        for a in range(0, len(h), PART):
            # neighbouring parts overlap by more than a notice
            seen |= {(name, a + i, a + j) for name, i, j in self.candidates(h[a : a + PART + 4 * most])}
        for name, i, j in sorted(seen, key=lambda x: (x[1], x[2], x[0])):
            s, held = self.held[name]
            lo, hi = max(0, i - len(s)), min(len(h), j + len(s))
            at = [k for k in range(lo, hi) if tuple(w[k : k + WIDTH]) in held]
            share = len({tuple(w[k : k + WIDTH]) for k in at}) / len(held)
            if share + 1e-9 >= self.threshold:
                spans = out.setdefault(name, [])
                if spans and at[0] < spans[-1][1]:
                    spans[-1] = [spans[-1][0], max(spans[-1][1], at[-1] + WIDTH), max(spans[-1][2], share)]
                else:
                    spans.append([at[0], at[-1] + WIDTH, share])
        return sorted(((name, a, b, c) for name, spans in out.items() for a, b, c in spans), key=lambda x: (x[1], x[0]))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("containment", T.DoubleType())]))


def found_column(text: Column, templates: dict[str, str], threshold: float) -> Column:
    @F.pandas_udf(FOUND)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(templates, threshold)
        for texts in parts:
            yield pd.Series([[{"license": n, "start": a, "stop": b, "containment": c} for n, a, b, c in matcher.find(t or "")] for t in texts], dtype=object)

    return found.asNondeterministic()(text)  # else the plan would run it once more, to filter before the explosion


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, start, stop, containment: one row for each notice in each row of ``docs``; places in words.

    templates: name -> text, a list of the size of a license collection, which travels with the code.
    Null or empty texts hold none; templates under five words are left out; repeated rows are reported
    each, whatever their ids; extra columns are ignored.
    """
    x = docs.select("doc_id", F.explode(found_column(F.coalesce(F.col("text"), F.lit("")), dict(templates or TEMPLATES), threshold)).alias("x"))
    return x.select("doc_id", "x.license", "x.start", "x.stop", "x.containment")
