"""Operator 5: license scans, in DataFrame operations only. MinHash bands over overlapping text windows retrieve license templates;
exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are five words (a template of fewer words is one shingle). Templates are put
into classes of length; a class of length n has windows of n + step words every step words, step = n / 4, so a copy of a template
lies whole within one window. A window that holds three quarters of a template's shingles resembles it by at least `alike`
(worked out for each class), and the number of bands of one minimum each makes both meet but for a chance of `miss`. A template
matches if a retrieved window holds at least three quarters of its distinct shingles.

Only texts and windows with an anchor word are scanned: anchors are chosen from the templates so that too few shingles of any template
lack one for a match, so this loses nothing. Templates are a list of the caller: their table of bands is broadcast where its bytes are few.

Cases: null and empty texts match nothing and give a row; texts of any length are scanned whole; rows that repeat an id each get the
matches of all of them; null ids count as one id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents, light, settle

#: Short forms and opening passages of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole public license texts.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES |= {
    "mit-text": TEMPLATES["mit"] + ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": TEMPLATES["isc"] + " " + _AS_IS,
    "bsd-3-clause-text": TEMPLATES["bsd-3-clause"] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD,
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": TEMPLATES["unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "gpl-notice-text": TEMPLATES["gpl-notice"] + ", either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see",
    "apache-2.0-notice-text": TEMPLATES["apache-2.0-notice"] + ' http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}
K = 5
NEED = (3, 4)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def classes(templates: dict[str, str]) -> dict[tuple[int, int], list[str]]:
    """Templates by (shingle length, window class length)."""
    out: dict[tuple[int, int], list[str]] = {}
    for name, text in sorted(templates.items()):
        n = len(words_of(text))
        if n:
            k, size = min(K, n), 4
            while size < n:
                size = math.ceil(size * 1.25)
            out.setdefault((k, n if k < K else size), []).append(name)
    return out


def anchors(templates: dict[str, str]) -> list[str]:
    """Words, long ones first, until no template can match without one."""
    chosen: list[str] = []
    for _, text in sorted(templates.items()):
        w = words_of(text)
        if not w:
            continue
        k = min(K, len(w))
        shingles = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        need = -(-NEED[0] * len(shingles) // NEED[1])
        for word in [x for x in chosen if x in w] + sorted(set(w) - set(chosen), key=lambda x: (-len(x), x)):
            if sum(not any(x in s for x in chosen) for s in shingles) < need:
                break
            if word not in chosen:
                chosen.append(word)
    return sorted(chosen)


def bands_for(k: int, size: int, names: list[str], templates: dict[str, str], miss: float) -> int:
    """Bands that make a window with three quarters of the least template of a class meet it but for a chance of `miss`."""
    step = max(1, size // 4)
    least = min(len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) for w in map(words_of, (templates[n] for n in names)))
    held, window = -(-NEED[0] * least // NEED[1]), size + step - k + 1
    alike = held / (window + least - held)
    return max(1, math.ceil(math.log(miss) / math.log(1 - alike)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k words on end, in order."""
    at = F.sequence(F.lit(1), F.size(w) - (k - 1))
    return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(k)), " ")))).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: Column, bands: int) -> Column:
    """The least of the shingles' hashes under each of the bands' hash functions."""
    seeds = F.array(*[F.lit(b) for b in range(bands)])
    return F.transform(seeds, lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-4) -> DataFrame:
    """(id, license, containment): the templates that the texts of each id hold."""
    templates = TEMPLATES if templates is None else templates
    spark, names = docs.sparkSession, anchors(templates)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.lower("text").rlike("|".join(names) or "(?!)"))
    found = settle(found.select("id", words(F.col("text")).alias("w")))  # one scan serves all classes
    parts = []
    for (k, size), own in classes(templates).items():
        step = max(1, size // 4)
        bands = bands_for(k, size, own, templates, miss)
        table = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, words_of(templates[n]))).alias("w")) for n in own])).alias("t")).select("t.license", F.array_distinct(shingles(F.col("t.w"), k)).alias("holds"))
        table = table.select("license", "holds", F.posexplode(minima(F.col("holds"), bands)).alias("band", "value"))
        starts = F.sequence(F.lit(1), F.size("w"), F.lit(step))
        anchored = F.filter(starts, lambda i: F.arrays_overlap(F.slice("w", i, F.lit(size + step)), F.array(*map(F.lit, names))))
        # as a lambda's variable the shingles of a text are hashed once, not again for each window
        cut = lambda h: F.transform(anchored, lambda i: F.slice(h, i, F.lit(size + step - k + 1)))  # noqa: B023, E731
        windows = found.select("id", F.explode(F.transform(F.array(shingles(F.col("w"), k)), cut)[0]).alias("h")).where(F.size("h") > 0)
        met = windows.select("id", "h", F.posexplode(minima(F.col("h"), bands)).alias("band", "value")).join(light(table, 400), ["band", "value"])
        parts.append(met.select("id", "license", (F.size(F.array_intersect("h", "holds")) / F.size("holds")).alias("containment")).where(F.col("containment") >= NEED[0] / NEED[1]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id", "license").agg(F.max("containment").alias("containment")).withColumnRenamed("id", id_col)


def op5_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    by = scan(docs).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list("license")).alias("found"), F.max("containment").alias("best"))
    out = docs.select("doc_id").join(by, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))


def license_sql(templates: dict[str, str] | None = None) -> str:
    """Containment in every window of every class, without bands."""
    templates = TEMPLATES if templates is None else templates
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = anchors(templates)
    arms = []
    for (k, size), own in classes(templates).items():
        step = max(1, size // 4)
        rows = []
        for n in own:
            w = words_of(templates[n])
            rows.append(f"({quote(n)}, [{', '.join(map(quote, sorted({' '.join(w[i : i + k]) for i in range(len(w) - k + 1)})))}])")
        arms.append(f"""
SELECT doc_id, license, len(list_intersect(h, holds)) / CAST(len(holds) AS DOUBLE) AS containment
FROM (SELECT doc_id, list_transform(range(i, least(i + {size + step - k + 1}, len(w) - {k} + 2)), lambda j: array_to_string(w[j : j + {k - 1}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, {step})) AS i FROM t)), (VALUES {', '.join(rows)}) AS v(license, holds)""")
    return f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(lower(text), '{"|".join(names)}')),
m AS (SELECT doc_id, license, max(containment) AS containment FROM ({' UNION ALL '.join(arms)}) WHERE containment >= 0.75 GROUP BY doc_id, license),
g AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(containment) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(best, 0) AS best FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""


QUERIES = {"op5_license_bands": op5_license_bands}
SQL = {"op5_license_bands": license_sql()}
