"""License scans with DataFrame functions only.

A text is normalised to words (lower case; anything but letters and digits parts words, so that comment signs, quotes and line
breaks do not matter). Each license template has some word bigrams as anchors, so many that no text that matches can do without
all of them. Where one occurs, it proposes a window: as many words as the template has, placed so that the bigram stands where
it stands in the template. Windows and templates are compared by the Dice coefficient of their sets of word bigrams; the
size of a window's set bounds the coefficient from above, so that windows of another size are never compared. A notice is
thus found wherever it stands: in a line of its own, within a paragraph, over several of them, before or after other text.

Defined results: null and empty texts have no license; of equal coefficients the longer template wins, then the one that
sorts first; repeated rows are each reported; a text of one word matches nothing; an empty table gives an empty result;
other columns are ignored. Windows that reach over an end of the text are cut there.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import column, let

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0 line": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0 title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0 title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "LGPL-2.1 header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0 title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT line": "Released under the MIT License.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0 title": "Mozilla Public License Version 2.0 1. Definitions",
    "Reserved line": "All rights reserved.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


@dataclass(frozen=True)
class Scan:
    """``dice`` is the least coefficient that counts."""

    dice: float = 0.8

    def least(self, m: int) -> int:
        """The least size of a set that can reach the coefficient with a set of ``m``, which is also the least that they share."""
        return math.ceil(self.dice / (2 - self.dice) * m - 1e-9)

    def most(self, m: int) -> int:
        return math.floor((2 - self.dice) / self.dice * m + 1e-9)


def anchors(templates: dict[str, str], settings: Scan = Scan()) -> tuple[dict[str, dict[str, list[int]]], list[str]]:
    """For each template its anchors (bigram -> places), and the words that they are about.

    Words are chosen, long ones and those of earlier templates first, until they touch more bigrams than a match may lack:
    then a text without any of the words, or without any of these bigrams, cannot match.
    """
    chosen: set[str] = set()
    out: dict[str, dict[str, list[int]]] = {}
    for name, text in sorted(templates.items()):
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for i, (a, b) in enumerate(zip(words, words[1:])):
            places.setdefault(f"{a} {b}", []).append(i)
        needed = len(places) - settings.least(len(places)) + 1
        touched: dict[str, list[int]] = {}
        for word in sorted(set(words), key=lambda w: (w not in chosen, -len(w), w)):
            if len(touched) >= needed:
                break
            chosen.add(word)
            touched |= {p: at for p, at in places.items() if word in p.split()}
        out[name] = dict(sorted(touched.items()))
    return out, sorted(chosen)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def scan(df: DataFrame, settings: Scan = Scan(), templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, dice (of the best window), n_matches, licenses: one row per row of ``df``; license is null where nothing matches.

    ``licenses`` are the names of all templates with a window, comma-joined in order, and ``n_matches`` is their number. A
    template that is part of another is found in it, too. The templates are literals in the plan; their number and size do not depend on the data.
    """
    names = sorted(templates)
    bags = [sorted(bigrams_of(templates[n])) for n in names]
    sizes = [len(words_of(templates[n])) for n in names]
    proposed: dict[str, list[dict[str, int]]] = {}
    by_name, words = anchors(templates, settings)
    for t, name in enumerate(names):
        for pair, places in by_name[name].items():
            proposed.setdefault(pair, []).extend({"t": t, "at": i} for i in places)
    # i folds case beyond ASCII only with u, as lower() does
    wanted = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"
    table = F.from_json(F.lit(json.dumps(proposed)), "map<string,array<struct<t:int,at:int>>>")
    literal = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    all_bags, all_sizes = literal(bags, "array<string>"), literal(sizes, "int")
    least, most = literal([settings.least(len(b)) for b in bags], "int"), literal([settings.most(len(b)) for b in bags], "int")

    def found_in(pairs: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.get(pairs, i).isin(sorted(proposed)))
        windows = F.flatten(F.transform(places, lambda i: F.transform(F.element_at(table, F.get(pairs, i)), lambda a: F.struct(a["t"].alias("t"), (i - a["at"]).alias("from")))))

        def judged(w: Column) -> Column:
            start = F.greatest(w["from"], F.lit(0))
            own = F.array_distinct(F.slice(pairs, start + 1, w["from"] + F.get(all_sizes, w["t"]) - 1 - start))

            def compared(b: Column) -> Column:
                bag, n = F.get(all_bags, w["t"]), F.size(b)
                fits = (n >= F.get(least, w["t"])) & (n <= F.get(most, w["t"]))
                dice = F.when(fits, F.round(2.0 * F.size(F.array_intersect(b, bag)) / (n + F.size(bag)), 6)).otherwise(F.lit(0.0))
                return F.struct((-dice).alias("d"), (-F.get(all_sizes, w["t"])).alias("size"), w["t"].alias("t"))

            return let(own, compared)

        return F.filter(F.transform(F.array_distinct(windows), judged), lambda s: -s["d"] >= settings.dice)

    def of_text(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return let(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")), lambda p: F.when(F.size(p) > 0, found_in(p)).otherwise(none))

    none = F.array().cast("array<struct<d:double,size:int,t:int>>")
    text = F.coalesce(column(text_col), F.lit(""))
    told = df.select(column(id_col).alias("id"), F.when(text.rlike(wanted), let(_words(text), of_text)).otherwise(none).alias("found"))
    best, kinds = F.array_min("found"), F.array_sort(F.array_distinct(F.transform("found", lambda s: s["t"])))
    name_of = lambda t: F.get(literal(names, "string"), t)
    out = told.select("id", name_of(best["t"]).alias("l"), (-best["d"]).alias("d"), F.size(kinds).cast("long").alias("n"), F.array_join(F.transform(kinds, name_of), ",").alias("all"))
    return out.toDF(id_col, "license", "dice", "n_matches", "licenses")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(settings: Scan = Scan(), templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL: anchors joined with the bigrams of every text, windows cut out and compared, without any pruning."""
    names = sorted(templates)
    rows = ", ".join(f"({t}, {_sql_text(n)}, {_sql_text(templates[n])})" for t, n in enumerate(names))
    by_name, _ = anchors(templates, settings)
    places = ", ".join(f"({t}, {_sql_text(p)}, {i})" for t, n in enumerate(names) for p, at in by_name[n].items() for i in at)
    words = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH templates AS (SELECT t, license, {words.format('body')} AS w FROM (VALUES {rows}) v(t, license, body)),
bags AS (SELECT t, len(w) AS size, list_distinct({pairs}) AS bag FROM templates),
anchors AS (SELECT * FROM (VALUES {places}) v(t, pair, place)),
worded AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
listed AS (SELECT r, doc_id, {pairs} AS ps FROM worded),
spread AS (SELECT r, unnest(ps) AS pair, generate_subscripts(ps, 1) - 1 AS i FROM listed),
starts AS (SELECT DISTINCT r, t, i - place AS p FROM spread JOIN anchors USING (pair)),
windows AS (SELECT s.r, s.t, bag, size, list_distinct(ps[greatest(p, 0) + 1 : p + size - 1]) AS own FROM starts s JOIN bags USING (t) JOIN listed l ON l.r = s.r),
scored AS (SELECT r, t, size, round(2.0 * len(list_intersect(own, bag)) / (len(own) + len(bag)), 6) AS d FROM windows),
kept AS (SELECT r, t, size, max(d) AS d FROM scored WHERE d >= {settings.dice} GROUP BY r, t, size),
best AS (SELECT r, max(d) AS dice, arg_min(t, (-d, -size, t)) AS t, count(*) AS n, list(t ORDER BY t) AS ts FROM kept GROUP BY r)
SELECT w.doc_id, x.license, b.dice, coalesce(b.n, 0)::BIGINT AS n_matches, coalesce(array_to_string(list_transform(b.ts, lambda k: {[*names]!r}[k + 1]), ','), '') AS licenses
FROM worded w LEFT JOIN best b USING (r) LEFT JOIN templates x ON x.t = b.t
"""
