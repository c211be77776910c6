"""Licence scan (operator 9): text windows against licence templates by the Dice
coefficient over word bigrams.

Texts and templates are normalised alike: A-Z lower-cased, words are runs of ASCII letters,
digits and non-ASCII bytes; everything else separates. For a template of w words, every
window of w consecutive words of a text is compared (the whole text when it is shorter):
Dice = 2 |A & B| / (|A| + |B|) over the sets of bigrams. A window can reach ``threshold`` t
only with at least t |B| / (2 - t) bigrams of the template, and a text only when it has at
least that many bigrams at all; these size bounds prune with one cumulative sum per
template, and only windows that pass are compared exactly.

Per document: ``license`` (template of the largest Dice at or above the threshold; ties go
to the longer template, then the name), ``dice``, ``first_word`` (the window's start) and
``matches`` (all templates that reach the threshold, sorted). NULL or empty texts, and texts
without a match, get NULL and an empty list. A template with fewer than two words is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from washbay.llm.common import _BYTE_CODE, _LOWER, Texts, doc_rows, given_id, mix, passes, span_hash, texts_of

# Wording of widely used licence texts, headers, titles and notices (families are added below).
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _creative_commons() -> dict[str, str]:
    """The deed's sentence and the short notice of the six licences in all their versions."""
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
             "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
             "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    out = {}
    for version, port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        for short, long in kinds.items():
            long = long if version == "4.0" else long.replace("NoDerivatives", "NoDerivs")
            if version == "1.0" and short == "BY-NC-ND":
                long = "Attribution-NoDerivs-NonCommercial"
            out[f"CC-{short}-{version}"] = f"This work is licensed under a Creative Commons {long} {version} {port} License."
            out[f"CC-{short}-{version}-notice"] = f"Licensed under CC {short} {version}."
    return out


def _gnu() -> dict[str, str]:
    """Title of the text, header (this or any later version; this version only) and notice."""
    out = {}
    for name, what, kind, version, dated in (
            ("GPL-1.0", "program", "", "1", "February 1989"), ("GPL-2.0", "program", "", "2", "June 1991"),
            ("GPL-3.0", "program", "", "3", "29 June 2007"), ("LGPL-2.0", "library", "Library ", "2", "June 1991"),
            ("LGPL-2.1", "library", "Lesser ", "2.1", "February 1999"), ("LGPL-3.0", "program", "Lesser ", "3", "29 June 2007"),
            ("AGPL-3.0", "program", "Affero ", "3", "19 November 2007")):
        gnu = f"GNU {kind}General Public License"
        start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {gnu}"
        out[f"{name}-title"] = f"{gnu} Version {version}, {dated}"
        out[f"{name}-header"] = (f"{start} as published by the Free Software Foundation, either version {version} of the License, "
                                 "or (at your option) any later version.")
        out[f"{name}-only-header"] = f"{start} version {version} as published by the Free Software Foundation."
        out[f"{name}-notice"] = f"This work is licensed under the {gnu}, version {version}."
    return out


def _bsd() -> dict[str, str]:
    head = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: ")
    source = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the "
              "following disclaimer. ")
    binary = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
              "following disclaimer in the documentation and/or other materials provided with the distribution. ")
    advert = ("All advertising materials mentioning features or use of this software must display the following "
              "acknowledgement: This product includes software developed by the organization. ")
    names = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission. ")
    tail = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
            "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE.")
    clauses = {"1": [source], "2": ["1. ", source, "2. ", binary], "3": ["1. ", source, "2. ", binary, "3. ", names],
               "4": ["1. ", source, "2. ", binary, "3. ", advert, "4. ", names]}
    plain = {"2": [source, binary], "3": [source, binary, names], "4": [source, binary, advert, names]}
    return ({f"BSD-{n}-Clause": head + "".join(c) + tail for n, c in clauses.items()}
            | {f"BSD-{n}-Clause-unnumbered": head + "".join(c) + tail for n, c in plain.items()}
            | {f"BSD-{n}-Clause-notice": f"Licensed under the BSD {n}-Clause License." for n in "234"})


def _more() -> dict[str, str]:
    as_is = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. ")
    liable = ("BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
              "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. ")
    author = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
              "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
              "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
              "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
              "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
    use = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    mozilla = ('The contents of this file are subject to the Mozilla Public License Version {} (the "License"); you may not use '
               "this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, "
               "WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing "
               "rights and limitations under the License.")
    unlicense = "This is free and unencumbered software released into the public domain."
    out = {
        "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "MIT-0": (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without '
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            f"Software, and to permit persons to whom the Software is furnished to do so. {as_is}IN NO EVENT SHALL THE "
            f"AUTHORS OR COPYRIGHT HOLDERS {liable}"),
        "X11": TEMPLATES["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM") + (
            " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise "
            "to promote the sale, use or other dealings in this Software without prior written authorization from the X "
            "Consortium."),
        "ISC-text": f"{use}, provided that the above copyright notice and this permission notice appear in all copies. {author}",
        "0BSD": f"{use}. {author}",
        "MPL-1.0-header": mozilla.format("1.0"),
        "MPL-1.1-header": mozilla.format("1.1"),
        "MPL-2.0-header": (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                    "to this work."),
        "CC0-1.0-title": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "CC0-1.0-notice": "Licensed under CC0 1.0.",
        "Unlicense-notice": unlicense,
        "Unlicense": (
            f"{unlicense} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
            "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
            "copyright interest in the software to the public domain. We make this dedication for the benefit of the public "
            "at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
            "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
            f"{as_is}IN NO EVENT SHALL THE AUTHORS {liable}For more information, please refer to http://unlicense.org/"),
        "Zlib": (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
            "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
            "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
            "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
            "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
            "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
            "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
            "removed or altered from any source distribution."),
        "BSL-1.0-header": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or "
                           "copy at http://www.boost.org/LICENSE_1_0.txt)"),
    }
    for name, title in (("MIT", "MIT"), ("ISC", "ISC"), ("Zlib", "zlib")):
        out[f"{name}-licensed-notice"] = f"Licensed under the {title} License."
    for name, title in (("BSD", "BSD"), ("ISC", "ISC")):
        out[f"{name}-notice"] = f"Released under the {title} License."
    for name, title in (("MPL", "Mozilla"), ("EPL", "Eclipse")):
        for version in ("1.0", "1.1", "2.0") if name == "MPL" else ("1.0", "2.0"):
            out[f"{name}-{version}-notice"] = f"Licensed under the {title} Public License, Version {version}."
    for version in ("1.0", "1.1"):
        out[f"Apache-{version}-notice"] = f"Licensed under the Apache License, Version {version}."
    return out


for _made in (_creative_commons, _gnu, _bsd, _more):
    TEMPLATES |= {name: body for name, body in _made().items() if name not in TEMPLATES}

_PART = np.zeros(256, dtype=bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal_words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words, and each text's first word (and the end)."""
    n, raw = t.size, t.buf[:t.size]
    part = _PART[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[t.off] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = part[:-1], part[1:]
    start = np.flatnonzero(part & (~before | edge[:n]))
    end = np.flatnonzero(part & (~after | edge[1:])) + 1
    return span_hash(_BYTE_CODE[_LOWER[raw]], start, end), np.searchsorted(start, t.off)


def _bigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(templates)
        hashes, first = normal_words(texts_of(pa.array([templates[n] for n in self.names])))
        self.size = np.diff(first)
        if (self.size < 2).any():
            raise ValueError("a template needs at least two words")
        self.grams = [np.unique(_bigrams(hashes[a:b])) for a, b in zip(first[:-1], first[1:])]
        self.least = [max(1, math.ceil(threshold * len(g) / (2 - threshold) - 1e-9)) for g in self.grams]
        self.any = np.unique(np.concatenate(self.grams))
        self.among = [np.isin(self.any, g) for g in self.grams]
        self.threshold = threshold

    def scan(self, t: Texts) -> list[list[tuple[float, int, str, int]]]:
        """Per text: (dice, template words, name, first word) of each matching template's best window."""
        words, first = normal_words(t)
        out: list[list] = [[] for _ in range(t.n)]
        if len(words) < 2:
            return out
        grams = _bigrams(words)
        at = np.searchsorted(self.any, grams)
        known = np.flatnonzero(self.any[np.minimum(at, len(self.any) - 1)] == grams)
        inside = np.ones(len(words), dtype=bool)
        inside[first[1:-1][first[1:-1] < len(words)] - 1] = False             # no bigram crosses two texts
        known = known[inside[known]]
        gram, row_of = at[known], np.searchsorted(first, known, side="right") - 1
        for k, name in enumerate(self.names):
            of_it = self.among[k][gram]
            hits = known[of_it]
            if len(hits) < self.least[k]:
                continue
            rows = np.flatnonzero(np.bincount(row_of[of_it]) >= self.least[k])
            if not len(rows):
                continue
            total = np.zeros(len(grams) + 1, dtype=np.int32)
            total[hits + 1] = 1
            np.cumsum(total, out=total)
            w = int(self.size[k])
            for row in rows.tolist():
                a, b = int(first[row]), int(first[row + 1])
                starts = np.arange(a, max(a + 1, b - w + 1))
                stops = np.minimum(starts + w, b)
                enough = total[np.maximum(stops - 1, starts)] - total[starts] >= self.least[k]
                best = None
                for s, e in zip(starts[enough].tolist(), stops[enough].tolist()):
                    g = np.unique(grams[s:e - 1])
                    dice = 2 * len(np.intersect1d(g, self.grams[k], assume_unique=True)) / (len(g) + len(self.grams[k]))
                    if dice >= self.threshold and (best is None or dice > best[0]):
                        best = (dice, w, name, s - a)
                if best:
                    out[row].append(best)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, dice, first_word, matches per document. One scan, no shuffle."""
    chosen = Templates(templates or TEMPLATES, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in passes(batches):
            found = chosen.scan(t)
            best = [min(f, key=lambda m: (-m[0], -m[1], m[2])) if f else (None, None, None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([b[2] for b in best], pa.string()), pa.array([b[0] for b in best], pa.float64()),
                 pa.array([b[3] for b in best], pa.int64()), pa.array([sorted(m[2] for m in f) for f in found], pa.list_(pa.string()))],
                names=["doc_id", "license", "dice", "first_word", "matches"])

    return (doc_rows(docs).mapInArrow(run, "doc_id bigint, license string, dice double, first_word bigint, matches array<string>")
            .withColumn("doc_id", given_id()))
