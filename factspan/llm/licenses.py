"""License scans by patience alignment.

Text and template are aligned on words that occur once in both: of these anchors the longest increasing subsequence is
kept, and every gap between kept anchors is aligned in the same way; runs that continue an anchor word by word count
too.  Coverage is the share of the template's words that the alignment meets.

An alignment looks at stretches of a text only: a stretch is a run of the template's own rare words (those outside a
short list of function words) that lie no further apart than the template is long; copies within it are tried singly.  A stretch whose words could not
reach the coverage asked for, even if all of them were aligned, is left out; that bound is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import ALNUM, Tokens, hash_spans, padded, slices, string_buffer

MIN_COVERAGE = 0.8

#: What the notices of one family share; fixed texts.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")


def _gnu(program: str, name: str, version: str) -> str:
    """The notice of the GNU licenses, which differ in names and versions only."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>.")


#: Public licenses, those that are short as whole texts, and the notices that stand for the long ones; fixed texts.
TEMPLATES = {
    "agpl-3.0-header": _gnu("This program", "Affero General Public License", "3"),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "bsd-2-clause": _BSD_HEAD + _BSD_CLAUSES + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + _BSD_CLAUSES + _BSD_THIRD + _BSD_TAIL,
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
        "This work is published under the CC0 1.0 Universal Public Domain Dedication."),
    "gpl-2.0-header": _gnu("This program", "General Public License", "2"),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _gnu("This program", "General Public License", "3"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "lgpl-2.1-header": _gnu("This library", "Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("This library", "Lesser General Public License", "3"),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law."),
}

COMMON = frozenset("a all and any as at be by either for if in is it may no not of on or so that the this to use with you your work can will but even out under".split())


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, where, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(where[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            where.append(i)
        else:
            tops[k], where[k] = v, i
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of positions (text, template) of equal words, increasing in both.  Gaps wait on a list, not on the stack."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ours, theirs = Counter(text[a0:a1]), Counter(template[b0:b1])
        at = {w: i for i, w in enumerate(template[b0:b1], b0) if theirs[w] == 1}
        anchors = [(i, at[w]) for i, w in enumerate(text[a0:a1], a0) if ours[w] == 1 and w in at]
        kept = [anchors[i] for i in increasing([b for _, b in anchors])]
        if not kept:
            continue
        pairs += kept
        x, y = a0, b0
        for a, b in [*kept, (a1, b1)]:
            todo.append((x, a, y, b))
            x, y = a + 1, b + 1
    return sorted(pairs)


class Templates:
    """Templates as word hashes, and what finds stretches of their rare words."""

    def __init__(self, templates: dict[str, str]):
        data = pa.array(list(templates.values()), pa.large_string())
        buf, offsets = string_buffer(data)
        pad = padded(buf, lower=True)
        t = Tokens(pad, offsets, ALNUM)
        h = hash_spans(pad, t.start, t.end)
        self.names = list(templates)
        self.words = [h[a:b].tolist() for a, b in zip(t.first[:-1], t.first[1:])]
        common = set()
        for w in COMMON:
            p = padded(np.frombuffer(w.encode(), np.uint8))
            common.add(int(hash_spans(p, np.array([0]), np.array([len(w)]))[0]))
        # A template of function words only is told by all of its words.
        self.rare = [sorted(set(w) - common) or sorted(set(w)) for w in self.words]
        self.flags = np.unique(np.concatenate([np.array(r, np.uint64) for r in self.rare])) if templates else np.zeros(0, np.uint64)


def _stretches(template: list, have: Counter, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the text to align: all of it with the template's length around, and, where even the rarest of its
    words recurs (copies side by side leave no word unique), one around each place of that word, wide and tight."""
    size = len(template)
    out = [(int(at[0]) - size, int(at[-1]) + size + 1)]
    rarest = min(have, key=lambda w: (have[w], template.index(w)))
    if have[rarest] > template.count(rarest):
        q = template.index(rarest)
        for p in at[words == rarest].tolist():
            for slack in (0, size // 4 + 1):
                out.append((p - q - slack, p - q + size + slack))
    return out


def _apart(stretches: list[dict]) -> list[dict]:
    """Of stretches that overlap the one of most coverage (then the shortest, then the first), in the order of the text."""
    kept: list[tuple[int, int]] = []
    out = []
    for x in sorted(stretches, key=lambda x: (-x["coverage"], x["last_word"] - x["first_word"], x["first_word"])):
        k = bisect_left(kept, (x["first_word"], x["last_word"]))
        if (k and kept[k - 1][1] >= x["first_word"]) or (k < len(kept) and kept[k][0] <= x["last_word"]):
            continue
        kept.insert(k, (x["first_word"], x["last_word"]))
        out.append(x)
    return sorted(out, key=lambda x: x["first_word"])


def scan(column: pa.Array, templates: Templates, min_coverage: float) -> list[list[dict]]:
    """Per text: one entry per stretch that a template covers, of stretches that overlap the best: name, coverage, words
    matched, first and last word."""
    buf, offsets = string_buffer(column)
    out: list[list[dict]] = []
    for lo, hi in slices(offsets):
        pad = padded(buf[offsets[lo]:offsets[hi]], lower=True)
        t = Tokens(pad, offsets[lo:hi + 1] - offsets[lo], ALNUM)
        h = hash_spans(pad, t.start, t.end)
        found: list[list[dict]] = [[] for _ in range(hi - lo)]
        spot = np.searchsorted(templates.flags, h)
        flagged = np.flatnonzero(templates.flags[np.minimum(spot, len(templates.flags) - 1)] == h) if len(templates.flags) else np.zeros(0, np.int64)
        words = h[flagged]
        rows = np.searchsorted(t.first, flagged, "right") - 1
        for name, template, rare in zip(templates.names, templates.words, templates.rare):
            mine = np.flatnonzero(np.isin(words, np.array(rare, np.uint64)))
            if not len(mine):
                continue
            at, row = flagged[mine], rows[mine]
            cut = np.flatnonzero((np.diff(at) > len(template)) | (np.diff(row) > 0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.append(cut, len(at))
            need = min_coverage * len(template)
            spare = sum(w not in set(rare) for w in template)
            full = Counter(w for w in template if w in set(rare))
            met: dict[int, list[dict]] = {}
            for s, e in zip(starts.tolist(), ends.tolist()):
                if spare + (e - s) < need:
                    continue
                have = Counter(words[mine[s:e]].tolist())
                if spare + sum(min(n, have[w]) for w, n in full.items()) < need:
                    continue
                r = int(row[s])
                low, high = int(t.first[r]), int(t.first[r + 1])
                for first, last in _stretches(template, have, words[mine[s:e]], at[s:e]):
                    first, last = max(low, first), min(high, last)
                    pairs = align(h[first:last].tolist(), template)
                    coverage = len(pairs) / len(template)
                    if coverage >= min_coverage:
                        met.setdefault(r, []).append({"license": name, "coverage": coverage, "matched": len(pairs), "first_word": first - low + pairs[0][0], "last_word": first - low + pairs[-1][0]})
            for r, stretches in met.items():
                found[r] += _apart(stretches)
        out += found
    return out


_FOUND = "array<struct<license:string, coverage:double, matched:int, first_word:int, last_word:int>>"
_FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``found`` (stretches that cover a template to ``min_coverage``
    or more, those of one template apart from each other, in the order of templates and of the text), ``best`` (the one with most words matched) and ``n_found``.

    Null and empty texts find nothing, nor do templates without words.  Repeated rows give repeated rows, an empty
    table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in (templates or TEMPLATES).items() if v and v.strip()})

    def run(batches):
        known = Templates(shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(scan(b.column(1), known, min_coverage), _FOUND_ARROW)], names=["doc_id", "found"])

    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {_FOUND}")
    best = F.array_sort("found", lambda x, y: F.when(x["matched"] != y["matched"], y["matched"] - x["matched"]).when(x["license"] < y["license"], -1).otherwise(1))
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.get(best, F.lit(0))["license"].alias("best"), "found")
