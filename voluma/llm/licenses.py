"""License scans by patience alignment.

A text and a template are word lists (letters and digits, lower case). A stretch starts at a word of the text and is
half as long again as the template and four words more. It is aligned with the template: words that occur once in both
anchor it, the longest increasing subsequence of the anchors is kept, and the gaps between them are aligned the same
way, with equal ends matched first. Coverage is the share of the template's words that the alignment matches. A stretch
is found if its first word is matched, all of the template's ``must`` words (its name, its version) are, and coverage
is at or over the least; the scan goes on behind its last matched word, so repeated notices are all found.

Stretches are refused without an alignment only where none could succeed: if the text lacks a ``must`` word; if the
first word is not among the template's first words (all before the first matched one are missed, so it has at most
the missed share before it); or if the words that stretch and template share, counted with repeats, are fewer than
coverage asks for (an alignment matches each of them once at most).

Templates are the notices by which works name their licenses, the short licenses and the openings of some, and the
whole texts of seven long ones (``license_texts``). Other licenses are not known and not reported.

Scale: one scan without shuffle; templates are some thousands of words; memory is one text at a time.

Defined cases: null or empty text, and texts without a match, give no row; very long texts are scanned whole, in time
that grows with their length; rows that share a ``doc_id`` are scanned each; of overlapping stretches of one family of
licenses (all GNU ones, all BSD ones) the best covered is reported, then the longest, then the first; of different
families each; extra columns are left out; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, id_or_least, map_rows, read, text_or_empty

#: The notices by which works name their license, the short licenses, and openings of some, each with the
#: words that must be among the matched ones.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "creative 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "warranties", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "binary neither", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "gnu 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "gnu 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lesser 2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("BSD-2-Clause", "binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("Zlib", "misrepresented", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "sublicense merchantability", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
#: The words that must be matched in the whole texts of ``license_texts``.
WHOLE = {"Apache-2.0": "apache", "CC0-1.0": "affirmer", "GPL-2.0": "gnu 1991", "GPL-3.0": "gnu 2007", "LGPL-2.1": "lesser 1999", "LGPL-3.0": "lesser 2007", "MPL-2.0": "mozilla"}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (by first) with rising seconds, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [b]
        piles[at : at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Index pairs of the words of ``a`` and ``b`` that a patience alignment matches, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ones = {w for w, n in Counter(b[b0:b1]).items() if n == 1} & {w for w, n in Counter(a[a0:a1]).items() if n == 1}
        where = {b[j]: j for j in range(b0, b1) if b[j] in ones}
        kept = rising([(i, where[a[i]]) for i in range(a0, a1) if a[i] in where])
        if not kept:
            continue
        out += kept
        for (i, j), (u, v) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if u > i + 1 and v > j + 1:
                todo.append((i + 1, u, j + 1, v))
    return sorted(out)


@lru_cache(maxsize=1)
def whole_texts() -> tuple[tuple[str, str, str], ...]:
    """The templates of the long licenses."""
    folder = Path(__file__).parent / "license_texts"
    return tuple((name, must, (folder / f"{name}.txt").read_text()) for name, must in WHOLE.items())


def family(name: str) -> str:
    first = name.split("-")[0]
    return "GPL" if first.endswith("GPL") else first


class Scanner:
    def __init__(self, templates: Iterable[tuple[str, str, str]] | None = None, least: float = 0.8) -> None:
        self.templates = []
        templates = [*TEMPLATES, *whole_texts()] if templates is None else templates
        for k, (name, must, text) in enumerate(templates):
            words = words_of(text)
            need = ceil(least * len(words) - 1e-9)
            opening = frozenset(words[: len(words) - need + 1])
            self.templates.append((name, k, words, need, frozenset(words_of(must)), opening, Counter(words)))

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, float]]:
        """(license, template, first word, last word, matched words, coverage) of each stretch; of overlapping ones of a family the best."""
        out, taken = [], {}
        for x in sorted(self.stretches(text), key=lambda x: (-x[5], -x[4], x[2], x[1])):
            ends = taken.setdefault(family(x[0]), [])  # (first, last) of what is reported, in order and apart
            at = bisect_left(ends, (x[2], x[2]))
            if (at == 0 or ends[at - 1][1] < x[2]) and (at == len(ends) or ends[at][0] > x[3]):
                ends.insert(at, (x[2], x[3]))
                out.append(x)
        return out

    def found(self, words: list[bytes], first: int, template: tuple) -> tuple[str, int, int, int, int, float] | None:
        """What the stretch from ``first`` on gives."""
        name, k, wanted, need, must, _, _ = template
        pairs = align(words[first : first + span(wanted)], wanted)
        if len(pairs) >= need and pairs[0][0] == 0 and must <= {wanted[j] for _, j in pairs}:
            return name, k, first, first + pairs[-1][0], len(pairs), len(pairs) / len(wanted)
        return None

    def stretches(self, text: str) -> Iterator[tuple[str, int, int, int, int, float]]:
        words = words_of(text)
        seen = set(words)
        for template in self.templates:
            _, _, wanted, need, must, opening, count = template
            if len(words) < need or not must <= seen:
                continue
            hits = [i for i, w in enumerate(words) if w in count]
            end, done, shared, inside = 0, -1, 0, Counter()
            for start, first in enumerate(hits):
                while end < len(hits) and hits[end] < first + span(wanted):
                    w = words[hits[end]]
                    inside[w] += 1
                    shared += inside[w] <= count[w]
                    end += 1
                if first > done and shared >= need and words[first] in opening and (x := self.found(words, first, template)):
                    done = x[3]
                    yield x
                w = words[hits[start]]
                shared -= inside[w] <= count[w]
                inside[w] -= 1


def span(template: list[bytes]) -> int:
    return len(template) * 3 // 2 + 4


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, template, first_word, last_word, matched, coverage of every stretch found in every text."""
    templates = [*TEMPLATES, *whole_texts()] if templates is None else templates

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        scanner = Scanner(templates, least)
        for r in rows:
            for found in scanner.scan(r["text"]):
                yield (r["id"], *found)

    schema = "doc_id long, license string, template int, first_word long, last_word long, matched int, coverage double"
    out = map_rows(docs.select(id_or_least().alias("id"), text_or_empty().alias("text")), schema, run)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
