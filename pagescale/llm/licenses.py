"""Licence scans: word-bigram Dice coefficients between normalised text and licence templates.

Compared are the whole text of a document and each of its lines. Text is normalised to lower-case
ASCII words; Dice is 2 |A and B| / (|A| + |B|) over the different word bigrams. As the
coefficient cannot exceed 2 min(|A|, |B|) / (|A| + |B|), a template is a candidate only for units whose number
of bigrams lies between t / (2 - t) and (2 - t) / t times its own, t being the threshold.
A unit of w words, d of them different, has at most w - 1 and at least d - 1 different
bigrams, so most units are ruled out before their bigrams are made; the rest are held against
the templates whose bounds the exact number meets.

Defined cases: null and blank texts, and units of fewer than two words, match nothing (licence null,
dice 0); ties go to the first template name, then the whole text (unit 0), then the earlier line;
repeated rows each get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9

#: Public licence texts and common notices. More can be given as a parameter.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}


def words(text: str) -> list[str]:
    """Lower-case ASCII words."""
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def bigrams(w: list[str]) -> set[tuple[str, str]]:
    """The different pairs of neighbouring words."""
    return set(zip(w, w[1:], strict=False))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, name, dice) of every unit and template at or above the threshold; unit 0 is the whole text, others are line numbers.

    ``templates`` (name to text) go to the tasks with the function; documents are not shuffled.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = sorted((len(g), name, g) for name, text in (templates or TEMPLATES).items() if (g := bigrams(words(text))))
    sizes = [(m * low - 1e-9, m * high + 1e-9) for m, _, _ in known]

    def matches(body):
        w = words(body)
        if not any(len(w) - 1 >= lo for lo, _ in sizes):
            return
        d = len(set(w)) - 1
        if not any(len(w) - 1 >= lo and d <= hi for lo, hi in sizes):
            return
        own = bigrams(w)
        for (m, name, g), (lo, hi) in zip(known, sizes, strict=True):
            if own and lo <= len(own) <= hi:
                dice = 2.0 * len(own & g) / (len(own) + m)
                if dice >= threshold:
                    yield name, dice

    def run(batches):
        for b in batches:
            ids, units, names, found = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for unit, body in enumerate([text, *text.split("\n")] if text else ()):
                    for name, dice in matches(body):
                        ids.append(i)
                        units.append(unit)
                        names.append(name)
                        found.append(dice)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(units, pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.float64())], ["id", "unit", "name", "dice"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, unit bigint, name string, dice double")


def best_license(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, license, dice, unit, n_matches)."""
    found = scan(docs, templates, threshold, id_col, text_col)
    top = found.groupBy("id").agg(F.min(F.struct((-F.col("dice")).alias("d"), "name", "unit")).alias("b"), F.count_distinct("unit").alias("n_matches"))
    out = docs.select(F.col(id_col).alias("id")).join(top, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("b.name").alias("license"), F.coalesce(-F.col("b.d"), F.lit(0.0)).alias("dice"), F.col("b.unit").alias("unit"), F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"))


def check_sql(threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, every unit against every template."""
    values = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())
    grams = lambda x: f"list_filter(string_split(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""with t as (select name, {pairs} g from (select name, {grams("body")} w from (values {values}) v(name, body))),
    u as (select doc_id, unnest(list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10)))) b, unnest(range(0, 1 + len(string_split(coalesce(text, ''), chr(10))))) unit from documents),
    o as (select doc_id, unit, {pairs} own from (select doc_id, unit, {grams("b")} w from u)),
    m as (select doc_id, unit, name, 2.0 * len(list_intersect(own, g)) / (len(own) + len(g)) dice from o, t where len(own) > 0 and len(own) between len(g) * {threshold} / (2 - {threshold}) - 1e-9 and len(g) * (2 - {threshold}) / {threshold} + 1e-9),
    r as (select *, row_number() over (partition by doc_id order by dice desc, name, unit) k, count(distinct unit) over (partition by doc_id) c from m where dice >= {threshold})
    select documents.doc_id, name "license", cast(coalesce(dice, 0) as double) dice, unit, coalesce(c, 0) n_matches from documents left join r on r.doc_id = documents.doc_id and k = 1"""
