"""Licence scan: normalised text against templates by the Dice coefficient of word bigrams.

Normalised words are runs of letters and digits (any byte from 0x80 counts as a
letter) in ASCII lower case.  Whole texts, paragraphs, lines and sentences are
units; a unit is compared with a template as sets of word bigrams.  Dice >= d
needs a unit of m*d/(2-d) to m*(2-d)/d bigrams for a template of m, so sizes
prune the templates, and a unit without enough bigrams of any template is never
built.  A licence of several paragraphs, or whose lines were broken anew, is
found as a run of neighbouring lines and sentences: for each template that
shares enough bigrams with a document, the run with the highest Dice, then the
next that does not overlap it.  Long full texts are sought as runs only.  One
narrow pass, no shuffle; the templates are a fixed parameter.

Edge cases: null and empty texts have no match; the best template of a unit
wins, the first by name on a tie; spans that several kinds of unit share count
once; a run is left out where matches with no less Dice cover half of it; repeated rows and null ids give a row each; other columns are ignored; an
empty table gives an empty result.
"""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm import _text as T
from mmspark.llm._spark import ready

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Fixed public texts: (licence, template).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_2 + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Full public texts, too long for units.
FULL_TEXTS: tuple[tuple[str, str], ...] = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SCHEMA = "doc_id long, matches array<struct<license:string,start:int,end:int,dice:double>>"


def normalised(data: np.ndarray, off: np.ndarray):
    """Words of the normalised text, as T.words gives them, and the folded bytes."""
    folded = _FOLD[data]
    return (*T.words(np.where(_LETTER[folded], folded, np.uint8(32)), off), folded)


def bigrams(data: np.ndarray, off: np.ndarray):
    """(hash of words i and i+1 for each i, words' starts, first word of each document)."""
    starts, ends, first, folded = normalised(data, off)
    h = T.word_hashes(folded, starts, ends)
    return (T.mix(h[:-1] * T.U(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)), starts, first


def template_sets(templates) -> list[tuple[str, np.ndarray]]:
    out = []
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        out.append((name, np.unique(bigrams(raw, np.array([0, len(raw)]))[0])))
    return [x for x in out if len(x[1])]


def _units(data: np.ndarray, off: np.ndarray, starts: np.ndarray, first: np.ndarray):
    """(first word, end word) of every text, paragraph, line and sentence with at least two words, and the first words of all lines and sentences with the end."""
    n = len(data)
    newline = data == 10
    stop = np.zeros(n, bool)
    stop[:-1] = ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & T._WS[data[1:]]
    ends = np.flatnonzero(newline)
    blank = np.zeros(0, np.int64)
    if len(ends) > 1:
        solid = np.concatenate([[0], np.cumsum(~T._WS[data])])
        blank = ends[1:][solid[ends[1:]] == solid[ends[:-1]]]
    edges = [off, np.concatenate([off, blank]), np.concatenate([off, ends]), np.concatenate([off, ends, np.flatnonzero(stop) + 1])]
    spans = []
    for e in edges:
        at = np.unique(np.searchsorted(starts, np.unique(e)))
        spans.append(np.column_stack([at[:-1], at[1:]]))
    spans = np.concatenate(spans)
    return np.unique(spans[spans[:, 1] - spans[:, 0] >= 2], axis=0), at


def _runs(grams: np.ndarray, edges: np.ndarray, mine: np.ndarray, dice: float) -> list[tuple[float, int, int]]:
    """(Dice, first word, end word) of the best runs of neighbouring pieces between edges that reach the Dice and do not overlap.

    Shared and distinct bigrams are kept for every first piece while the end
    moves on; a bigram counts for the starts behind its last occurrence.  A start
    with more distinct bigrams than any match can have never comes back.
    """
    m, most = len(mine), len(mine) * (2 - dice) / dice + 1e-9
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before = np.full(len(grams), -1)
    before[order[1:][same]] = order[:-1][same]
    place = np.arange(len(grams))
    lo, hi = np.searchsorted(edges, before, "right"), np.searchsorted(edges, place, "right")
    hit = np.isin(grams, mine)
    shared, distinct, n, live, at, found = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64), len(edges) - 1, 0, 0, []
    for j in range(1, n + 1):
        end = edges[j] - 1
        a, b = np.maximum(lo[at:end], live) - live, np.maximum(hi[at:end], live) - live
        w, size = hit[at:end], j - live + 1
        distinct[live : j + 1] += np.cumsum(np.bincount(a, minlength=size)[:size] - np.bincount(b, minlength=size)[:size])
        if w.any():
            shared[live : j + 1] += np.cumsum(np.bincount(a[w], minlength=size)[:size] - np.bincount(b[w], minlength=size)[:size])
            score = 2 * shared[live:j] / (distinct[live:j] + m)
            k = len(score) - 1 - int(np.argmax(score[::-1]))
            if score[k] >= dice:
                found.append((float(score[k]), int(edges[live + k]), int(edges[j])))
        at = end
        while live < j and distinct[live] > most:
            live += 1
    return _apart(found)


def _apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The best first, without those that overlap a better one."""
    kept: list[tuple[float, int, int]] = []
    for d, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if all(b <= y or a >= z for _, y, z in kept):
            kept.append((d, a, b))
    return kept


def license_scan(docs: DataFrame, templates=TEMPLATES, dice: float = 0.8, full_texts=FULL_TEXTS) -> DataFrame:
    """One row a document: doc_id, matches (licence, first word, end word, Dice) by position."""
    ready(docs.sparkSession)
    sets = sorted(template_sets(templates), key=lambda x: x[0])
    known = np.unique(np.concatenate([x[1] for x in sets])) if sets else np.zeros(1, np.uint64)
    least = min((len(x[1]) for x in sets), default=1 << 60) * dice / (2 - dice)
    most = max((len(x[1]) for x in sets), default=0) * (2 - dice) / dice
    every = sorted(sets + template_sets(full_texts), key=lambda x: x[0])
    vocabulary = np.unique(np.concatenate([x[1] for x in every])) if every else np.zeros(1, np.uint64)
    member = np.array([np.isin(vocabulary, x[1]) for x in every], np.int32).reshape(len(every), len(vocabulary)).T
    need = np.array([len(x[1]) * dice / (2 - dice) - 1e-9 for x in every])

    def shared(grams: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(document, template) of those that share as many distinct bigrams as the Dice takes."""
        at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == grams)
        doc = np.searchsorted(first, hit, "right") - 1
        inside = hit + 1 < first[doc + 1]
        pairs = np.unique(doc[inside] * len(vocabulary) + at[hit[inside]])
        if not len(pairs):
            return []
        docs, begin = np.unique(pairs // len(vocabulary), return_index=True)
        enough = np.add.reduceat(member[pairs % len(vocabulary)], begin, axis=0) >= need
        return [(int(docs[i]), int(t)) for i, t in np.argwhere(enough)]

    def add_runs(found: list[list[dict]], grams: np.ndarray, first: np.ndarray, edges: np.ndarray) -> None:
        runs: dict[int, list[tuple]] = {}
        for d, t in shared(grams, first):
            a, b = int(first[d]), int(first[d + 1])
            mine = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b, "right")] - a
            runs.setdefault(d, []).extend((*x, every[t][0]) for x in _runs(grams[a : b - 1], mine, every[t][1], dice))
        for d, have in runs.items():
            for score, a, b, name in sorted(have, key=lambda x: (-x[0], x[3], x[1])):
                if not any(m["dice"] >= score and 2 * (min(b, m["end"]) - max(a, m["start"])) >= b - a for m in found[d]):
                    found[d].append({"license": name, "start": a, "end": b, "dice": score})
            found[d].sort(key=lambda m: (m["start"], m["end"]))

    def best(unit: np.ndarray) -> tuple[float, str]:
        u, found = len(unit), (0.0, "")
        for name, mine in sets:
            m = len(mine)
            if m * dice / (2 - dice) - 1e-9 <= u <= m * (2 - dice) / dice + 1e-9:
                d = 2 * int(np.isin(unit, mine, assume_unique=True).sum()) / (u + m)
                if d >= dice and d > found[0]:
                    found = (d, name)
        return found

    def run(batches):
        for rows, data, off in T.documents(batches):
            grams, starts, first = bigrams(data, off)
            found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
            if len(grams):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hits = np.concatenate([[0], np.cumsum(known[at] == grams)])
                units, edges = _units(data, off, starts, first)
                have = hits[units[:, 1] - 1] - hits[units[:, 0]]
                count = units[:, 1] - units[:, 0] - 1
                units = units[(have >= dice * (least + 1e-9) / 2) & (count >= least - 1e-9) & ((count <= most) | (have >= least * dice))]
                doc = np.searchsorted(first, units[:, 0], "right") - 1
                for (a, b), d in zip(units.tolist(), doc.tolist(), strict=True):
                    score, name = best(np.unique(grams[a : b - 1]))
                    if name:
                        found[d].append({"license": name, "start": a - int(first[d]), "end": b - int(first[d]), "dice": score})
                add_runs(found, grams, first, edges)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())])))], ["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
