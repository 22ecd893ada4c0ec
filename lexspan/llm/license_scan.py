"""License scans: MinHash bands over overlapping windows of text find templates, exact containment confirms them.

Words are lower-cased runs of letters, digits and non-ASCII bytes; shingles are five words. Templates of
(w/2, w] shingles, w a power of two, are sought in windows of w shingles every w/4. A text that holds
`share` of a template's shingles in one stretch has a window whose Jaccard similarity with the template
is at least 0.36, so with `BANDS` bands of one row the chance to miss it is under 0.64 ** BANDS, below
one in a thousand. A candidate is verified on the stretch of 2 w shingles around its window: the share of
the template's distinct shingles that occur there. Of overlapping stretches only the best one counts.

The templates are short texts, headers and notices; `templates_in` reads further ones, such as the full
texts of long licenses, from a folder of the user's.

Defined results: null, empty and shorter texts have no licenses; templates of fewer than five words are
one shingle of all their words, sought in windows of that many words; of stretches with equal shares the
first counts; repeated rows give repeated results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _spark, _text

N, SHARE, BANDS = 5, 0.8, 16
#: log2 of the places that tell the windows whose least hash no template has.
BITS = 16

#: Notices, headers and short license texts as their publishers word them.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0-notice": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-line": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates_in(folder: str) -> dict[str, str]:
    """Further templates: the files of a folder by name, such as the full texts of long licenses."""
    out = {}
    for name in sorted(os.listdir(folder)):
        at = os.path.join(folder, name)
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace") as f:
                out[name] = f.read()
    return out


def _seeds(bands: int) -> np.ndarray:
    return _text.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hashed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h * seed
    return x ^ (x >> np.uint64(29))


def _told(least: np.ndarray) -> np.ndarray:
    """The low bits of least hashes: unlike the high ones they are spread evenly."""
    return (least & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Index:
    """Templates by shingle length, window class and band. Only the shingles are sent to workers, which make the keys anew."""

    def __init__(self, templates: dict[str, str], n: int = N, bands: int = BANDS):
        self.bands = bands
        self.groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name in sorted(templates):
            buf, _ = _text.join(pa.array([templates[name]]))
            _, _, h = _text.all_words(buf, _text.alnum)
            k = min(n, len(h))
            if k:
                s = np.unique(_text.window_hashes(h, k))
                self.groups.setdefault((k, 1 << (len(s) - 1).bit_length()), []).append((name, s))
        self._band()

    def __getstate__(self) -> tuple:
        return self.bands, self.groups

    def __setstate__(self, state: tuple) -> None:
        self.bands, self.groups = state
        self._band()

    def _band(self) -> None:
        self.keys: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for (k, w), own in self.groups.items():
            for b, seed in enumerate(_seeds(self.bands)):
                least = np.array([_hashed(s, seed).min() for _, s in own], np.uint64)
                order = np.argsort(least, kind="stable")
                bits = np.zeros(1 << BITS, bool)
                bits[_told(least)] = True
                self.keys[k, w, b] = least[order], order, bits

    def find(self, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, str, float, int, int, int]]:
        """(text, template, share, first word, past word, shingles found) of the best stretch of each template; h: word hashes of all texts.

        Windows begin on a grid of each text's own and end with it, so texts do not depend on their neighbours.
        """
        found: dict[tuple[int, str], tuple[float, int, int, int]] = {}
        for k in sorted({k for k, _ in self.groups}):
            s = _text.window_hashes(h, k)
            ends = first + np.maximum(count - k + 1, 0)  # past the last shingle of each text
            text = np.repeat(np.arange(len(count)), count)[: len(s)]
            place = np.arange(len(s))
            inside, own_place = place < ends[text], place - first[text]
            classes = sorted(w for x, w in self.groups if x == k)
            grid = {w: np.flatnonzero(inside & (own_place & (max(1, w // 4) - 1) == 0)) for w in classes}
            same = {1 << i: text[: -(1 << i)] == text[1 << i :] for i in range(classes[-1].bit_length() - 1)}
            pairs: set[tuple[int, int, int]] = set()
            for b, seed in enumerate(_seeds(self.bands)):
                low, w = np.where(inside, _hashed(s, seed), ~np.uint64(0)), 1
                while True:
                    if w in classes:
                        keys, order, bits = self.keys[k, w, b]
                        seen = low[grid[w]]
                        at = np.flatnonzero(bits[_told(seen)])
                        spot = np.searchsorted(keys, seen[at])
                        while len(at):
                            ok = (spot < len(keys)) & (keys[np.minimum(spot, len(keys) - 1)] == seen[at])
                            at, spot = at[ok], spot[ok]
                            pairs.update((w, int(t), x) for t, x in zip(order[spot].tolist(), grid[w][at].tolist(), strict=True))
                            spot = spot + 1
                    if w >= classes[-1]:
                        break
                    more = low.copy()
                    np.minimum(low[:-w], low[w:], out=more[:-w], where=same[w])
                    low, w = more, 2 * w
            for w, t, at in sorted(pairs):
                name, own = self.groups[k, w][t]
                d = int(text[at])
                a, z = max(int(first[d]), at - w // 2), min(int(ends[d]), at + w + w // 2)
                x = s[a:z]
                spot = np.minimum(np.searchsorted(own, x), len(own) - 1)
                hit = own[spot] == x
                if hit.any():
                    n, p = len(np.unique(spot[hit])), np.flatnonzero(hit)
                    got = (n / len(own), int(a + p[0] - first[d]), int(a + p[-1] + k - first[d]), n)
                    best = found.get((d, name))
                    if best is None or (-got[0], got[1]) < (-best[0], best[1]):
                        found[d, name] = got
        return [(d, name, *x) for (d, name), x in sorted(found.items())]


def _apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of templates whose stretches overlap, that with the most shingles found, then the greatest share, then the first name; in order of name."""
    taken: list[tuple[str, float, int, int]] = []
    for name, share, a, z, _ in sorted(found, key=lambda x: (-x[4], -x[1], x[0])):
        if all(z <= x or y <= a for _, _, x, y in taken):
            taken.append((name, share, a, z))
    return sorted(taken)


def _scan(index: Index, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("share", pa.float64()), ("first", pa.int32()), ("past", pa.int32())]))
        for batch in batches:
            buf_all, start_all = _text.join(batch.column("text"))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            words = np.zeros(batch.num_rows, np.int64)
            for i, j in _text.slices(start_all):
                buf, start = buf_all[start_all[i] : start_all[j]], start_all[i : j + 1] - start_all[i]
                a, _, h = _text.all_words(buf, _text.alnum)
                first = np.searchsorted(a, start)
                words[i:j] = np.diff(first)
                kept: dict[int, list] = {}
                for d, name, got, x, y, n in index.find(h, first[:-1], np.diff(first)):
                    if got >= share:
                        kept.setdefault(d, []).append((name, got, x, y, n))
                for d, own in kept.items():
                    out[i + d] = [{"license": name, "share": got, "first": x, "past": y} for name, got, x, y in _apart(own)]
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(words), pa.array(out, kind)], [*rest.schema.names, "n_words", "licenses"])

    return run


def scan(docs: DataFrame, *keep: str, templates: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """The columns `keep` of docs, n_words, and licenses: array of (license, share, first, past), the words of the best stretch."""
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.drop("text").schema)
    return slim.mapInArrow(_spark.bounded(_scan(Index(TEMPLATES if templates is None else templates), share)), f"{fields}n_words long, licenses array<struct<license:string,share:double,first:int,past:int>>")
