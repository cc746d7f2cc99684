"""Licence notices and texts in documents, by Dice coefficient over word bigrams.

Words are lower-cased runs of letters, digits, dots and hyphens. Every stretch of words of a document is compared with every
template, wherever lines begin and end: Dice is 2 s / (a + b) for a stretch of a bigrams, a template of b and s bigrams in common, counted
with their times. Sizes prune first: Dice can reach a limit t only if a <= b (2 - t) / t and s >= b t / (2 - t), so a template is
dropped unless that many of its bigrams lie that close together. That filter follows from the templates and loses nothing. Of
the stretches that remain only those that begin and end with a common bigram are scored, as cutting off others raises Dice.
The list of templates is a fixed parameter of some kilobytes; it goes to the tasks with the code.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from postlake.llm.rows import bounded_batches

#: The least Dice coefficient, in hundredths.
LIMIT = 80

# Parts that licences share.
_BSD_2 = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_3 = ' 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

# Notices and short texts of public licences.
TEMPLATES = {
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        _BSD_2,
        _BSD_2 + _BSD_END,
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        _BSD_2 + _BSD_3,
        _BSD_2 + _BSD_3 + _BSD_END,
    ),
    "BSL-1.0": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "0BSD": (_ISC + "." + _ISC_END,),
    "ISC": (
        _ISC + _ISC_NOTICE,
        _ISC + _ISC_NOTICE + _ISC_END,
    ),
    "LGPL-2.1": ('This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ('This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
}
_TERM = re.compile(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?")
_LINE_END = re.compile("\n")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class _Numbers(dict):
    """A word's number; -1 for words that no template has."""

    def __missing__(self, word):
        return -1


class Templates:
    """Templates as counts of numbered bigrams."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, limit: int = LIMIT):
        texts = [(name, terms(x)) for name, given in sorted(templates.items()) for x in given]
        texts = [(name, words) for name, words in texts if len(words) > 1]
        self.limit, self.names = limit, [name for name, _ in texts]
        self.number = _Numbers()
        for _, words in texts:
            for w in words:
                self.number.setdefault(w, len(self.number))
        codes = [self._codes(words) for _, words in texts]
        self.grams = np.unique(np.concatenate([*codes, np.empty(0, dtype=np.int64)]))
        self.times = np.zeros((len(texts), len(self.grams)), dtype=np.int64)
        for row, x in zip(self.times, codes):
            np.add.at(row, np.searchsorted(self.grams, x), 1)
        self.size = self.times.sum(axis=1)
        self.least = -(-self.size * limit // (200 - limit))  # common bigrams
        self.most = self.size * (200 - limit) // limit  # bigrams of a stretch

    def _codes(self, words: list[str]) -> np.ndarray:
        """A number for each bigram, -1 with a word that no template has."""
        k = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        return np.where((k[:-1] >= 0) & (k[1:] >= 0), k[:-1] * (1 << 20) + k[1:], -1)

    def find(self, words: list[str]) -> list[tuple[int, int, str, int, float]]:
        """(first word, words, name, common bigrams, Dice) of the stretches like a template.

        Of stretches that overlap, the one with more common bigrams stands, then the higher Dice, the earlier start and the first name.
        """
        if len(words) < 2 or not len(self.grams):
            return []
        codes = self._codes(words)
        at = np.flatnonzero(codes >= 0)
        gram = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        real = self.grams[gram] == codes[at]
        at, gram = at[real], gram[real]
        there = np.bincount(gram, minlength=len(self.grams))
        possible = np.flatnonzero(np.minimum(self.times, there).sum(axis=1) >= self.least)
        hits = {k: self._hits(k, at[has], gram[has]) for k in possible.tolist() for has in [self.times[k, gram] > 0]}
        waiting = [x for k, (places, _, starts) in hits.items() for i in starts for x in self._best(hits, k, i, len(words))]
        heapq.heapify(waiting)
        begins, taken = [len(words)], {}  # where what is taken begins, in order
        while waiting:
            shared, dice, start, name, n, k, i = heapq.heappop(waiting)
            next_at = bisect.bisect_left(begins, start)
            if next_at and taken[begins[next_at - 1]][1] > start or start in taken:
                continue
            if start + n > begins[next_at]:  # the best that ends before what is taken
                for x in self._best(hits, k, i, begins[next_at]):
                    heapq.heappush(waiting, x)
                continue
            bisect.insort(begins, start)
            taken[start] = (start, start + n, (start, n, name, -shared, -dice))
        return [taken[x][2] for x in begins[:-1]]

    def _hits(self, k: int, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The places of a template's bigrams; of each, the place from which a stretch must begin for it to count, as its bigram has
        come the template's times before; and those places that enough others follow closely."""
        order = np.argsort(gram, kind="stable")
        before = np.full(len(at), -1)
        back = np.arange(len(at)) - self.times[k, gram[order]]
        full = back >= np.searchsorted(gram[order], gram[order])
        before[order[full]] = order[back[full]]
        close = np.searchsorted(at, at + self.most[k]) - np.arange(len(at)) >= self.least[k]
        return at, before, np.flatnonzero(close).tolist()

    def _best(self, hits: dict, k: int, i: int, bound: int) -> Iterator[tuple]:
        """The best stretch that begins with the template's i-th bigram and ends before the word ``bound``, if it reaches the limit."""
        at, before, _ = hits[k]
        end = int(np.searchsorted(at, min(at[i] + self.most[k], bound - 1)))
        counts = before[i:end] < i
        shared, a = np.cumsum(counts), at[i:end] - at[i] + 1
        ok = np.flatnonzero(counts & (200 * shared >= self.limit * (a + self.size[k])))
        if len(ok):
            top = ok[np.lexsort((a[ok], -shared[ok]))[0]]
            yield (-int(shared[top]), -2 * int(shared[top]) / int(a[top] + self.size[k]), int(at[i]), self.names[k], int(a[top]) + 1, k, i)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    templates = Templates()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            lower = (text or "").lower()
            stretches = templates.find(_TERM.findall(lower))
            if stretches:  # few texts need places of words and lines, and then those of all at once
                places, ends = ([m.start() for m in x.finditer(lower)] for x in (_TERM, _LINE_END))
                rows += [(doc_id, name, bisect.bisect_left(ends, places[start]), round(dice, 6), start, n) for start, n, name, _, dice in stretches]
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "license", "line", "dice", "start", "words"]).astype({"doc_id": "Int64"})


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, license, line (from 0) and word (start) where it begins, dice and words of each stretch like a template.

    Null and empty texts have none; a row without doc_id is scanned too; repeated rows give repeated results; an empty table gives no
    rows. Long texts are taken whole: a task holds a text's words. Ties between templates go to the one with more common bigrams, then
    by name. Columns other than doc_id and text are ignored.
    """
    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInPandas(_scan, "doc_id long, license string, line int, dice double, start int, words int")
