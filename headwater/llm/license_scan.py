"""Finds licences of files: TF-IDF cosine to templates, then inheritance from the nearest folder above.

A text is cut into units at line ends and after sentence ends, and into paragraphs at empty lines. Each unit and each
paragraph is compared with the header templates (short notices, notices of several lines, and the paragraph that
only the text of a long licence has), the whole text with the complete texts of short licences, by the cosine of
sparse TF-IDF vectors over the words of all templates. The inverse frequencies are those among the templates; a word that no template
has weighs as one that none contains, and each such word counts as a word of its own. The best template at
``LEAST`` or more is the file's own licence (ties: the smaller name); the licences in ``RESERVED`` say no more than
that rights are kept, as every notice does, and count only where no other is found.

Only units that can reach ``LEAST`` are scored: for each template words are collected, the heaviest first and
function words last, until the rest of its vector is shorter than ``LEAST``; a unit without any of the collected
words has a smaller cosine with it, so leaving it out loses nothing.

A file without a licence of its own inherits: licence files (by their name) speak for their folder, and the
nearest folder at or above the file's that has one decides (several in a folder: the best score, then the
smaller licence, then the smaller path). Folders are joined with folders, not files: each distinct folder is
unfolded into the folders above it and meets the licensed ones by an equi-join.

All of it is DataFrame functions. Defined cases: null and empty texts have no own licence; a null path is in
no folder, speaks for none and inherits nothing; repeated rows are all returned; an empty table gives an
empty result; clashing names of other columns get a leading underscore.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, reserved

LEAST = 0.8
MOST_BROADCAST = 50_000
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
PARAGRAPH_END = r"\n(?:[ \t#*/;%-]*\r?\n)+"
UNIT_END = r"\r?\n|(?<=[.!?;])[ \t]+"
#: The public wording of notices.
_GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; version {} of the License."
HEADERS = {
    "0BSD": ["SPDX-License-Identifier: 0BSD"],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", _GPL_NOTICE.format("Affero General Public License", 3), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        _GPL_NOTICE.format("General Public License", 2), _GPL_ONLY.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        _GPL_NOTICE.format("General Public License", 3), _GPL_ONLY.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "ISC": ["SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", _GPL_NOTICE.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved."],
}
RESERVED = frozenset({"Proprietary"})
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
FILES = {
    "0BSD": [f"{_ISC}. {_AS_IS}"],
    "BSD-2-Clause": [f"{_BSD} {_BSD_AS_IS}", _BSD],
    "BSD-3-Clause": [f"{_BSD} {_BSD_THIRD} {_BSD_AS_IS}", f"{_BSD} {_BSD_THIRD}"],
    "ISC": [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [f"{_MIT} {_NO_WARRANTY.format('OR COPYRIGHT HOLDERS')}", _MIT],
    "Unlicense": [f"{_UNLICENSE} {_UNLICENSE_REST} {_NO_WARRANTY.format('')} For more information, please refer to https://unlicense.org/", _UNLICENSE],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}
#: Words that any English text has; they serve last to tell which units are worth scoring.
COMMON = frozenset("a above all an and any as at be by do either for from in into is it no not of on or so that the this to was with without".split())
_SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class Templates:
    """Normalised TF-IDF vectors of (licence, kind, text) and the words that a match must touch."""

    def __init__(self, headers: dict[str, list[str]], files: dict[str, list[str]], least: float):
        rows = [(name, kind, Counter(_words(t))) for kind, group in (("header", headers), ("file", files)) for name, texts in group.items() for t in texts]
        n, df = len(rows), Counter(w for *_, c in rows for w in c)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in sorted(df.items())}
        self.unknown = math.log(1 + n) + 1
        self.vectors = []
        for name, kind, c in rows:
            raw = {w: k * self.idf[w] for w, k in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((name, kind, {w: x / norm for w, x in sorted(raw.items())}))
        self.needed = {"header": set(), "file": set()}
        for _, kind, vector in self.vectors:
            rest = 1.0
            for w, x in sorted(vector.items(), key=lambda p: (p[0] in COMMON, -p[1], p[0])):
                if math.sqrt(max(rest, 0)) < least - 1e-9:
                    break
                self.needed[kind].add(w)
                rest -= x * x


def _literal_map(values: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _dot(terms: Column, vector: dict[str, float]) -> Column:
    weights = _literal_map(vector)
    return F.aggregate(terms, F.lit(0.0), lambda acc, s: acc + s["x"] * F.coalesce(F.try_element_at(weights, s["w"]), F.lit(0.0)))


def _best(words: Column, t: Templates, kind: str) -> Column:
    """(score, -rank of the name) of the best template for an array of words."""
    idf = _literal_map(t.idf)
    names = sorted({n for n, k, _ in t.vectors if k == kind})
    times = lambda v, w: F.size(F.filter(v, lambda y: y == w)).cast("double")

    def scored(v: Column) -> Column:
        terms = F.transform(F.array_distinct(v), lambda w: F.struct(w.alias("w"), (times(v, w) * F.element_at(idf, w)).alias("x")))

        def against(terms: Column) -> Column:
            known = F.aggregate(terms, F.lit(0.0), lambda acc, s: acc + s["x"] * s["x"])
            norm = F.sqrt(known + (F.size(words) - F.size(v)) * F.lit(t.unknown**2))
            dots = []
            for name, own, vector in t.vectors:
                if own == kind:
                    dots.append(F.struct(_dot(terms, vector).alias("dot"), F.lit(-names.index(name)).alias("rank")))
            return _bind(norm, lambda n: F.array_max(F.transform(F.array(*dots), lambda d: F.struct(F.round(d["dot"] / n, 9).alias("score"), d["rank"].alias("rank")))))

        return _bind(terms, against)

    return _bind(F.filter(words, lambda w: w.isin(*t.idf)), scored)


def own_licences(text: Column, headers: dict[str, list[str]] = HEADERS, files: dict[str, list[str]] = FILES, least: float = LEAST) -> Column:
    """A struct (licence, score), null if there is none."""
    t = Templates(headers, files, least)
    to_words = lambda u: F.filter(F.split(u, _SPLIT), lambda w: w != "")

    def best_of(units: Column, kind: str) -> Column:
        names = sorted({n for n, k, _ in t.vectors if k == kind})
        if not names:
            return F.lit(None).cast("struct<score:double,licence:string>")
        some = F.filter(units, lambda u: F.exists(u, lambda w: w.isin(*sorted(t.needed[kind]))))
        top = F.array_max(F.transform(some, lambda w: _best(w, t, kind)))
        return _bind(top, lambda b: F.when(b["score"] >= least, F.struct(b["score"].alias("score"), F.element_at(F.array(*map(F.lit, names)), 1 - b["rank"]).alias("licence"))))

    def pick(both: Column) -> Column:
        files_of, headers_of = both["whole"], both["units"]
        found = F.filter(F.array(best_of(headers_of, "header"), best_of(files_of, "file")), lambda b: b.isNotNull())
        last = lambda b: b["licence"].isin(*RESERVED)
        rank = lambda b: F.struct(last(b).alias("r"), (-b["score"]).alias("s"), b["licence"].alias("licence"))
        return _bind(F.array_min(F.transform(found, rank)), lambda b: F.when(b.isNotNull(), F.struct((-b["s"]).alias("score"), b["licence"].alias("licence"))))

    lower = F.lower(F.coalesce(text, F.lit("")))
    short = F.transform(F.split(lower, UNIT_END), to_words)
    parts = F.transform(F.split(lower, PARAGRAPH_END), to_words)
    return _bind(F.struct(F.array_distinct(F.concat(short, parts)).alias("units"), F.array(to_words(lower)).alias("whole")), pick)


def folder(path: Column) -> Column:
    """The folder of a path without a trailing sign; the empty text at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", headers: dict[str, list[str]] = HEADERS, files_: dict[str, list[str]] = FILES, least: float = LEAST) -> DataFrame:
    """All columns of ``files`` but the text, and own_licence, own_score, licence, inherited_from."""
    own = reserved(files, "own_licence", "own_score", "licence", "inherited_from", "ls_own", "ls_dir")
    rows = files.withColumn(own["ls_own"], own_licences(F.col(text_col).cast("string"), headers, files_, least)).withColumn(own["ls_dir"], folder(F.col(path_col))).drop(text_col)
    rows = cut(rows, "licence-own")
    path, struct, place = F.col(path_col), F.col(own["ls_own"]), F.col(own["ls_dir"])
    name = F.regexp_extract(path, r"[^/]*$", 0)
    speaking = rows.where(struct.isNotNull() & path.isNotNull() & name.rlike(LICENCE_NAME))
    rank = F.struct((-struct["score"]).alias("a"), struct["licence"].alias("licence"), path.alias("from"))
    licensed = speaking.groupBy(place.alias("above")).agg(F.min(rank).alias("l"))
    folders = rows.where(place.isNotNull()).select(place.alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folders.select("dir", F.explode_outer(F.array_distinct(up)).alias("above"))
    licensed = cut(licensed, "licence-folders")
    near = above.join(broadcast_if_small(licensed, MOST_BROADCAST), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "l")).alias("near"))
    near = cut(near.select(F.col("dir").alias("_dir"), F.col("near.l.licence").alias("_licence"), F.col("near.l.from").alias("_from")), "licence-near")
    joined = rows.join(broadcast_if_small(near, MOST_BROADCAST), place == F.col("_dir"), "left")
    others = [F.col(f"`{c}`") for c in files.columns if c != text_col]
    return joined.select(
        *others,
        struct["licence"].alias(own["own_licence"]),
        struct["score"].alias(own["own_score"]),
        F.coalesce(struct["licence"], F.col("_licence")).alias(own["licence"]),
        F.when(struct.isNull(), F.col("_from")).alias(own["inherited_from"]),
    )
