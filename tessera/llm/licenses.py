"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Main path: DataFrame expressions alone. Units are lines, runs of up to PARAGRAPHS adjacent paragraphs and whole texts; each
is compared with several templates a license: bodies of the short licences, telling paragraphs of the long ones, standard headers,
titles and short notices. Of each file the best unit counts, and the first identifier of an SPDX line counts with
cosine 1 if it names one of the licenses. Vectors live in the templates' vocabulary: a term's weight is (1 + ln count) x
ln((1 + files) / (1 + files with the term)), with file counts over all files. Units are spelled out where the terms of
the whole text let some unit reach the least cosine; that bound loses none. A directory's license is that of its licensed
file with the smallest path; a file without one takes that of the nearest directory above it, the root included.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import load, small

LEAST = 0.7
PARAGRAPHS = 6
_SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([a-z0-9.-]*[a-z0-9])"

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(title: str, version: str, date: str) -> list[str]:
    head = _GNU.format(title, version)
    return [head, head + _GNU_REST.format(title), f"GNU {title.upper()} Version {version}, {date}", f"This work is licensed under the GNU {title}, version {version}."]


#: Licence texts by SPDX name.
TEMPLATES = {
    "AGPL-3.0": [*_gnu("Affero General Public License", "3", "19 November 2007"), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.", "GNU AGPL version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'],
    "BSD-2-Clause": [_BSD.format(""), "BSD 2-Clause License.", "BSD 2-Clause"],
    "BSD-3-Clause": [_BSD.format(_THIRD), "Redistribution and use in source and binary forms, with or without modification, are permitted. " + _THIRD[3:] + "BSD 3-Clause License.", "BSD 3-Clause License.", "BSD 3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0, Creative Commons Attribution.", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International (CC BY 4.0)", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "GPL-2.0": [*_gnu("General Public License", "2", "June 1991"), "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.", "GNU GPL version 2", "Distributed under GNU GPL version 2"],
    "GPL-3.0": [*_gnu("General Public License", "3", "29 June 2007"), "The GNU General Public License is a free, copyleft license for software and other kinds of works.", "GNU GPL version 3", "Distributed under GNU GPL version 3"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "Licensed under the ISC license."],
    "LGPL-2.1": [*_gnu("Lesser General Public License", "2.1", "February 1999"), "GNU LGPL version 2.1"],
    "LGPL-3.0": [*_gnu("Lesser General Public License", "3", "29 June 2007"), "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "GNU LGPL version 3"],
    "MIT": ["Released under the MIT License.", _MIT, "Licensed under the MIT license.", "The MIT License"],
    "MPL-2.0": [_MPL.split(" If a copy")[0], _MPL, "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. The Unlicense.", _UNLICENSE],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "zlib License"],
}


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _python_terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _runs(text: Column) -> Column:
    """Runs of up to PARAGRAPHS adjacent paragraphs; lines without letters and digits part them."""
    parts = F.split(text, "\n(?:[^A-Za-z0-9\n]*\n)+")
    starts = F.sequence(F.lit(1), F.size(parts))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PARAGRAPHS), F.size(parts) - i + 1)), lambda n: F.array_join(F.slice(parts, i, n), "\n"))))


def scan(files: DataFrame, templates: dict[str, str | list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of files (file_id, path, text): file_id, path, own_license, cosine, license, inherited_from.

    own_license and cosine are null under the least cosine; equal cosines go to the first template by name.
    inherited_from is the directory ('' is the root), null where the license is the file's own. Null and empty texts and
    texts without letters or digits have no license of their own. Files with a null path inherit nothing. Rows that
    repeat a file_id or a path all count and get the results of their own text. Further columns are ignored; an empty table gives no
    rows. The templates are a parameter, so their terms (weights of which come to the driver) are a bounded set.
    Licensed files and licensed directories are broadcast where their measured size allows, else joined.
    """
    templates = TEMPLATES if templates is None else templates
    bodies = _bodies(templates)
    names = [n for n, _ in bodies]
    counts = {i: {t: ts.count(t) for t in ts} for i, (_, b) in enumerate(bodies) for ts in [_python_terms(b)]}
    vocabulary = sorted({t for c in counts.values() for t in c})
    files = files.select("file_id", F.col("path").cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    files = files.withColumn("digest", F.md5("text"))
    known = F.array(*map(F.lit, vocabulary))
    found = files.select(F.explode(F.array_append(F.array_intersect(_terms(F.col("text")), known), F.lit("")))).groupBy("col").count()
    seen = {r["col"]: r["count"] for r in found.collect()}  # the vocabulary's terms, and "" for the files
    idf = _weights(vocabulary, seen)
    vectors = {n: {t: (1 + math.log(c)) * idf[t] for t, c in counts[n].items()} for n in counts}
    norms = {n: math.sqrt(sum(w * w for w in v.values())) for n, v in vectors.items()}
    lookup = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, idf[t])])

    # a unit's cosine is at most the length of the template's part in the text's terms over that of the template
    def reach(i: int) -> Column:
        squares = F.create_map(*[F.lit(x) for t, w in sorted(vectors[i].items()) for x in (t, w * w)])
        return F.aggregate("own", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(squares, t), F.lit(0.0))) >= F.lit(((least - 1e-5) * norms[i]) ** 2)

    key = ["file_id", "path", "digest"]
    own = files.select(*key, "text", F.explode(F.array(F.array_intersect(_terms(F.col("text")), known))).alias("own")).where("size(own) > 0")
    own = own.where(reduce(or_, map(reach, vectors)))
    units = own.select(*key, F.explode(F.array_distinct(F.concat(F.split("text", "\n"), _runs(F.col("text")), F.array("text")))).alias("unit"))
    # explode(array(x)) computes x once a row; as plain columns the optimizer would copy x into each of its uses
    terms = units.select(*key, F.explode(F.array(F.filter(_terms(F.col("unit")), lambda t: F.array_contains(known, t)))).alias("terms"))
    weighed = terms.select(*key, F.explode(F.array(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("t"), ((1 + F.log(F.size(F.filter("terms", lambda x: x == t)).cast("double"))) * lookup[t]).alias("w"))))).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    scored = weighed.select(*key, "vector", F.explode(F.array(length)).alias("length")).where("length > 0")

    def cosine(name: int) -> Column:
        own = F.create_map(*[F.lit(x) for t, w in sorted(vectors[name].items()) for x in (t, w)])
        dot = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(own, x["t"]), F.lit(0.0)))
        return F.round(dot / (F.col("length") * F.lit(norms[name] or 1.0)), 6)

    # the array keeps template order, so the first of equal cosines is found by the greatest (cosine, -place)
    best = F.array_max(F.array(*[F.struct(cosine(i).alias("cosine"), F.lit(-i).alias("place")) for i in vectors]))
    per_unit = scored.select(*key, F.explode(F.array(best)).alias("best")).where(F.col("best.cosine") >= least)
    # as a template, an identifier's line would resemble that of any other license
    places = F.create_map(*[F.lit(x) for i, n in reversed(list(enumerate(names))) if i == names.index(n) for x in (n.lower(), -i)])
    ids = files.select(*key, F.explode(F.regexp_extract_all("text", F.lit(_SPDX), F.lit(1))).alias("spdx"))
    ids = ids.select(*key, F.try_element_at(places, F.regexp_replace(F.lower("spdx"), "-(only|or-later)$", "")).alias("place")).where("place is not null")
    per_unit = per_unit.unionByName(ids.select(*key, F.struct(F.lit(1.0).alias("cosine"), "place").alias("best")))
    own = per_unit.groupBy(key).agg(F.max("best").alias("best"))
    own = own.select(*(F.col(k).alias(f"own_{k}") for k in key), F.element_at(F.array(*map(F.lit, names)), (1 - F.col("best.place")).cast("int")).alias("own_license"), F.col("best.cosine").alias("cosine"))
    own = small(own, F.coalesce(F.octet_length("own_path"), F.lit(0)) + 100)
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    held = own.where("own_path is not null").select(F.regexp_extract("own_path", "^(.*)/[^/]*$", 1).alias("holder"), "own_path", "own_license")
    holders = held.groupBy("holder").agg(F.min(F.struct("own_path", "own_license")).alias("first")).select("holder", F.col("first.own_license").alias("held"))
    above = files.where("path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = above.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))).alias("holder"))
    nearest = above.join(holders, "holder").groupBy("dir").agg(F.max_by(F.struct("held", "holder"), F.length("holder")).alias("near"))
    nearest = small(nearest, F.octet_length("dir") + 100)
    out = files.select(key).join(own, reduce(and_, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in key]), "left")
    out = out.withColumn("dir", directory).join(nearest, "dir", "left")
    return out.select("file_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.held").alias("license"), F.when(F.col("own_license").isNull(), F.col("near.holder")).alias("inherited_from"))


def _bodies(templates: dict[str, str | list[str]]) -> list[tuple[str, str]]:
    return [(n, b) for n in sorted(templates) for b in ([templates[n]] if isinstance(templates[n], str) else templates[n])]


def _weights(vocabulary: list[str], seen: dict[str, int]) -> dict[str, float]:
    files = seen.get("", 0)
    return {t: math.log((1 + files) / (1 + seen.get(t, 0))) for t in vocabulary}


#: Documents as files: in the source's directory, one level below by thousands of doc_id, or two by hundreds, in turn.
_PATH = """concat(coalesce(source, ''), '/', CASE WHEN floor(doc_id / 20) % 3 > 0 THEN concat(cast(floor(doc_id / 1000) as bigint), '/') ELSE '' END,
 CASE WHEN floor(doc_id / 20) % 3 > 1 THEN concat(cast(floor(doc_id / 100) as bigint), '/') ELSE '' END, cast(doc_id as bigint))"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.expr(_PATH).alias("path"), "text")
    return scan(docs).withColumnRenamed("file_id", "doc_id")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(b)})" for i, (n, b) in enumerate(_bodies(TEMPLATES)))
    terms = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
WITH t(place, name, body) AS (VALUES {rows}),
tc AS (SELECT place, name, term, count(*) AS c FROM (SELECT place, name, unnest({terms.format('body')}) AS term FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents),
df AS (SELECT term, count(DISTINCT r) AS n FROM (SELECT r, unnest({terms.format('text')}) AS term FROM d) WHERE term IN (SELECT term FROM tc) GROUP BY term),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) AS w FROM (SELECT DISTINCT term FROM tc) LEFT JOIN df USING (term)),
tw AS (SELECT place, name, term, (1 + ln(c)) * w AS w FROM tc JOIN idf USING (term)),
tn AS (SELECT place, sqrt(sum(w * w)) AS n FROM tw GROUP BY place),
pp AS (SELECT r, regexp_split_to_array(text, '\n(?:[^A-Za-z0-9\n]*\n)+') AS p FROM d),
pr AS (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM pp),
u AS (SELECT DISTINCT r, unit FROM (SELECT r, text AS unit FROM d UNION ALL SELECT r, unnest(string_split(text, chr(10))) FROM d
      UNION ALL SELECT r, array_to_string(p[i:i + k - 1], chr(10)) FROM (SELECT r, p, i, unnest(range(1, least({PARAGRAPHS}, len(p) - i + 1) + 1)) AS k FROM pr))),
uc AS (SELECT r, unit, term, count(*) AS c FROM (SELECT r, unit, unnest({terms.format('unit')}) AS term FROM u) WHERE term IN (SELECT term FROM tc) GROUP BY ALL),
uw AS (SELECT r, unit, term, (1 + ln(c)) * w AS w FROM uc JOIN idf USING (term)),
un AS (SELECT r, unit, sqrt(sum(w * w)) AS n FROM uw GROUP BY ALL HAVING sum(w * w) > 0),
s AS (SELECT r, name, place, round(sum(uw.w * tw.w) / (any_value(un.n) * any_value(tn.n)), 6) AS cosine
      FROM uw JOIN un USING (r, unit) JOIN tw USING (term) JOIN tn USING (place) GROUP BY r, unit, name, place
      UNION ALL SELECT r, name, min(place), 1.0
      FROM (SELECT r, unnest(regexp_extract_all(text, '{_SPDX}', 1)) AS x FROM d) JOIN t ON lower(name) = regexp_replace(lower(x), '-(only|or-later)$', '') GROUP BY r, name),
own AS (SELECT r, name AS own_license, cosine FROM s WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY r ORDER BY cosine DESC, place) = 1),
f AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d LEFT JOIN own USING (r)),
h AS (SELECT dir AS holder, arg_min(own_license, path) AS held FROM f WHERE own_license IS NOT NULL GROUP BY dir),
n AS (SELECT f.r, held, holder FROM f JOIN h ON f.dir = holder OR holder = '' OR starts_with(f.dir, holder || '/') QUALIFY row_number() OVER (PARTITION BY f.r ORDER BY length(holder) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, held) AS license, CASE WHEN own_license IS NULL THEN holder END AS inherited_from
FROM f LEFT JOIN n USING (r)
"""


SQL = _sql()
