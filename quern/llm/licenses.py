"""License scans: units and windows of a text against licence templates by the Dice coefficient over word bigrams.

Unit and template are normalised to words: ASCII letters lowered, runs of ASCII letters, digits and whatever is not
ASCII, so comment signs and line breaks do not matter.  With A and B the sets of word bigrams, Dice is
2 |A and B| / (|A| + |B|).  Units are a text's lines, and its paragraphs (between empty lines) of more than one line.
A pair can only reach the threshold t if |A| lies between t / (2 - t) and (2 - t) / t times |B|, so templates outside
these bounds are pruned before any bigram is compared; templates are sorted by size.

Notices within longer lines and whole licences over many paragraphs are found by windows: runs of the text's words as
long as the template, placed so that a bigram that both have lies in the same place.  A window can only reach t if the
text has t / (2 - t) of the template's bigrams, which prunes all templates for almost every text in one pass.

Defined cases: null, empty and one-word units have no bigrams and no match; repeated lines are units of their own;
a unit that fits several templates counts for each; a window at a text's edge is shorter; a very long text is one
row's work; repeated rows stay repeated; other columns are not looked at, and where one has a new column's name,
underscores are put behind the latter; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices

THRESHOLD = 0.8
#: Notices as their licences or customs word them, the standard headers, and the paragraphs of short
#: licences as they stand.  BSD-3-Clause holds all of BSD-2-Clause, so only its third condition has a template of its own.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: Further sentences by which whole licences and usual notices are known.
TEMPLATES["AGPL-3.0"] += [
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
]
TEMPLATES["Apache-2.0"] += [
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
]
TEMPLATES["BSL-1.0"] += [
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
]
TEMPLATES["CC-BY-SA-4.0"] = ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]
TEMPLATES["CC0-1.0"] = [
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
]
TEMPLATES["EPL-2.0"] = [
    'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
]
TEMPLATES["GPL-2.0"] += [
    "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
]
TEMPLATES["GPL-3.0"] += [
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
]
TEMPLATES["LGPL-3.0"] += [
    "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
]
TEMPLATES["MPL-2.0"] += [
    '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
]
TEMPLATES["Unlicense"] += [
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
]
TEMPLATES["WTFPL"] = [
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
]
TEMPLATES["Zlib"] += [
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution.",
]
#: Whole licences, of the paragraphs above.
WHOLE = {
    "BSD-2-Clause": TEMPLATES["BSD-2-Clause"],
    "BSD-3-Clause": [*TEMPLATES["BSD-2-Clause"][:3], *TEMPLATES["BSD-3-Clause"], TEMPLATES["BSD-2-Clause"][3]],
    "ISC": TEMPLATES["ISC"],
    "MIT": TEMPLATES["MIT"][2:],
    "Unlicense": TEMPLATES["Unlicense"],
    "Zlib": TEMPLATES["Zlib"],
}
TEMPLATES = {name: [*texts, *([" ".join(WHOLE[name])] if name in WHOLE else [])] for name, texts in TEMPLATES.items()}
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256))


def words(text: str | bytes) -> list[bytes]:
    body = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return body.translate(_KEEP).split()


def bigrams(found: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(found, found[1:]))


class Templates:
    """Templates by rising number of bigrams."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        found_words = {(name, frozenset(b)): words(t) for name, texts in templates.items() for t in texts if (b := bigrams(words(t)))}
        every = [(len(b), name, set(b)) for name, b in found_words]
        self.all = sorted(every, key=lambda x: (x[0], x[1], sorted(x[2])))
        self.sizes = [n for n, _, _ in self.all]
        self.threshold = threshold
        ratio = threshold / (2 - threshold)
        self.least = self.sizes[0] * ratio if self.sizes else float("inf")
        self.most = self.sizes[-1] / ratio if self.sizes else 0
        # for windows: what a template needs, its length, and where each of its bigrams is first
        self.long, self.first, self.having = [], [], {}
        for number, (size, name, found) in enumerate(self.all):
            ws = found_words[name, frozenset(found)]
            places: dict = {}
            for at, pair in enumerate(zip(ws, ws[1:])):
                places.setdefault(pair, at)
            self.long.append(len(ws))
            self.first.append(places)
            for pair in found:
                self.having.setdefault(pair, []).append(number)
        self.pairs = frozenset(self.having)
        self.need = [size * ratio - 1e-9 for size in self.sizes]

    def of(self, unit: list[bytes]) -> Iterator[tuple[str, int, int]]:
        """(name, shared bigrams, bigrams of both) of the templates that the unit fits."""
        if len(unit) - 1 < self.least:
            return
        own = bigrams(unit)
        n, t = len(own), self.threshold
        if n > self.most:
            return
        for i in range(bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)):
            size, name, theirs = self.all[i]
            shared = len(own & theirs)
            if 2 * shared >= t * (n + size):
                yield name, shared, n + size


    def within(self, text: list[bytes]) -> set[int]:
        """The numbers of the templates that a window of the text fits."""
        pairs = list(zip(text, text[1:]))
        shared = self.pairs.intersection(pairs)
        if not self.need or len(shared) < self.need[0]:
            return set()
        many: Counter = Counter()
        for pair in shared:
            many.update(self.having[pair])
        found = set()
        for number, n in many.items():
            if n < self.need[number]:
                continue
            size, _, theirs = self.all[number]
            places, long = self.first[number], self.long[number]
            starts = dict.fromkeys(i - k for i, pair in enumerate(pairs) if (k := places.get(pair)) is not None)
            for start in starts:
                window = set(pairs[max(start, 0) : start + long - 1])
                if 2 * len(window & theirs) >= self.threshold * (len(window) + size):
                    found.add(number)
                    break
        return found


def units(text: str | None) -> Iterator[list[bytes]]:
    """The words of each line and of each paragraph of more than one line."""
    if not text:
        return
    paragraph: list[list[bytes]] = []
    for line in [*text.encode("utf-8", "surrogatepass").translate(_KEEP).split(b"\n"), b""]:
        if found := line.split():
            yield found
            paragraph.append(found)
        else:
            if len(paragraph) > 1:
                yield [w for part in paragraph for w in part]
            paragraph = []


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_units, n_matches (units and templates that fit), n_windows (templates that a window fits), licenses
    (sorted names of both) and best_dice (of units; null without a match)."""
    sent = docs.sparkSession.sparkContext.broadcast((templates or TEMPLATES, threshold))
    kinds = {"n_units": F.lit(0).cast("long"), "n_matches": F.lit(0).cast("long"), "n_windows": F.lit(0).cast("long"), "licenses": F.array().cast("array<string>"), "best_dice": F.lit(None).cast("double")}
    *added, body = fresh(docs, *kinds, "body")
    kept = docs.columns
    source = docs.withColumn(body, F.col(text))
    schema = docs.select(*kept, *[v.alias(k) for k, v in zip(added, kinds.values())]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(*sent.value)
        for batch in slices(batches, body):
            rows = []
            for x in batch.column(body).to_pylist():
                n, hits, names, best = 0, 0, set(), None
                for unit in units(x):
                    n += 1
                    for name, shared, both in known.of(unit):
                        hits += 1
                        names.add(name)
                        best = max(best or 0.0, 2 * shared / both)
                inside = known.within(words(x or ""))
                names.update(known.all[i][1] for i in inside)
                rows.append((n, hits, len(inside), sorted(names), best))
            n, hits, inside, names, best = zip(*rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(inside, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(best, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _sql_words(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the query: every unit against every template, every window that shares a placed bigram."""
    ratio = threshold / (2 - threshold)
    values = ", ".join(f"('{name}', '{t.replace(chr(39), chr(39) * 2)}')" for name, texts in TEMPLATES.items() for t in texts)
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM {table}),
l AS (SELECT rid, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM d),
lw AS (SELECT rid, no, {_sql_words("line")} AS w FROM l),
pg AS (SELECT rid, no, w, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY no) AS g FROM lw),
u AS (SELECT rid, w FROM lw WHERE len(w) > 0
  UNION ALL SELECT rid, flatten(list(w ORDER BY no)) AS w FROM pg WHERE len(w) > 0 GROUP BY rid, g HAVING count(*) > 1),
ub AS (SELECT rid, {pairs} AS b FROM u),
tw AS (SELECT name, w, row_number() OVER () AS tid FROM (SELECT DISTINCT name, {_sql_words("t")} AS w FROM (VALUES {values}) AS v(name, t))),
t AS (SELECT tid, name, len(w) AS long, {pairs} AS b FROM tw),
m AS (SELECT rid, name, 2.0::DOUBLE * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) AS dice FROM ub JOIN t
  ON len(ub.b) > 0 AND len(ub.b) >= {ratio} * len(t.b) - 1 AND len(ub.b) <= {1 / ratio} * len(t.b) + 1),
tp AS (SELECT tid, bg, min(i) AS k FROM (SELECT tid, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bg FROM tw) GROUP BY ALL),
dw AS (SELECT rid, {_sql_words("body")} AS w FROM d),
dp AS (SELECT rid, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bg FROM dw),
hit AS (SELECT rid, tid, dp.bg, i - k AS beg FROM dp JOIN tp USING (bg)),
few AS (SELECT rid, tid FROM hit JOIN t USING (tid) GROUP BY rid, tid, len(t.b) HAVING count(DISTINCT bg) >= {ratio} * len(t.b) - 1e-9),
win AS (SELECT rid, tid, t.name, t.b AS tb, dw.w[greatest(beg, 0) + 1 : beg + t.long] AS w FROM (SELECT DISTINCT rid, tid, beg FROM hit JOIN few USING (rid, tid)) JOIN dw USING (rid) JOIN t USING (tid)),
v AS (SELECT rid, tid, name FROM (SELECT rid, tid, name, tb, {pairs} AS b FROM win) WHERE 2 * len(list_intersect(b, tb)) >= {threshold}::DOUBLE * (len(b) + len(tb)) GROUP BY ALL),
n AS (SELECT rid, count(*) AS n_units FROM u GROUP BY rid),
h AS (SELECT rid, count(*) AS n_matches, max(dice) AS best_dice FROM m WHERE dice >= {threshold} GROUP BY rid),
c AS (SELECT rid, count(*) AS n_windows FROM v GROUP BY rid),
a AS (SELECT rid, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses FROM (SELECT rid, name FROM m WHERE dice >= {threshold} UNION ALL SELECT rid, name FROM v) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, coalesce(licenses, '') AS licenses, best_dice
FROM d LEFT JOIN n USING (rid) LEFT JOIN h USING (rid) LEFT JOIN c USING (rid) LEFT JOIN a USING (rid)
"""
