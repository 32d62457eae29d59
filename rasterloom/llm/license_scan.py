"""Licences of files: TF-IDF cosine of licence statements to templates, then inheritance from directories.

Every line of a whole text that holds a cue word is a statement, so is every block of lines that does (up to a line
with no more than comment signs), and so is the whole text of a licence file. Each is compared with each template by the
cosine of sparse TF-IDF vectors, whose document frequencies are the templates'; a term that no template has weighs as
the rarest. A licence has several templates: the notice by which it is named, its title, its SPDX line, and its standard
header or, where that is short, its text. The best statement at or above the least cosine is the file's own licence. A
file without one takes the licence of the nearest directory above it that has a licence file: distinct directories are
joined with the licensed directories by each of their ancestors, and the files by their directory.

Statements are scored within their row by built-in expressions. Only distinct directories are exploded into ancestors.
What the directories resolve to is broadcast if counted and small, else joined by a shuffle that Spark can split.

A null text holds no statement; a null path has no directory and inherits nothing. Of several licence files in a
directory the one of the highest cosine counts, then of the first template and path. Repeated rows come back as often
as they came. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, let, materialize

_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.
You should have received a copy of the GNU {name} Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """
_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE."""
# By SPDX identifier, the notices, titles, headers and short texts of public licences.
TEXTS = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "GNU Affero General Public License", _GNU_HEADER.format(name="Affero General", version="3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause Simplified License.", "BSD 2-Clause License", _BSD + _WARRANTY],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", _BSD + """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. """ + _WARRANTY],
    "CC-BY-4.0": ["Licensed under CC BY 4.0, Creative Commons Attribution.", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal Creative Commons Legal Code"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU_HEADER.format(name="General", version="2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License", _GNU_HEADER.format(name="General", version="3")],
    "ISC": ["Released under the ISC License.", "ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _GNU_HEADER.format(name="Lesser General", version="2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Lesser General Public License", _GNU_HEADER.format(name="Lesser General", version="3")],
    "MIT": ["Released under the MIT License.", "The MIT License", _PERMISSION + " " + _AS_IS],
    "MPL-2.0": ["This work is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    "Proprietary": ["All rights reserved. Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. The Unlicense.", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""],
}
#: Every template as (licence, text); SPDX lines are made of the identifiers.
TEMPLATES = [(k, t) for k, ts in TEXTS.items() for t in ts] + [
    (k, f"SPDX-License-Identifier: {k}{suffix}") for k in TEXTS if k != "Proprietary" for suffix in (("", "-only", "-or-later", "+") if "GPL" in k else ("",))
]
CUE = r"(?i)licen[cs]e|copyright|rights reserved|spdx|public domain"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([.-][^/]*)?$"
LEAST_COSINE = 0.6
#: What parts blocks of lines: a line of nothing but blanks and comment signs.
GAP = r"\n[ \t\r/*#;-]*\n"
#: Lists that the templates' terms are dealt to by their hashes.
SLOTS = 1024
#: Directories with a licence up to which they are broadcast.
BROADCAST_DIRECTORIES = 50_000


def model() -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of unknown terms, and each template's weights of unit length."""
    terms = [Counter(re.findall(TERM, t.lower())) for _, t in TEMPLATES]
    in_ = Counter(t for c in terms for t in c)
    n = len(terms)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in in_.items()}
    weights = []
    for c in terms:
        norm = math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items()))
        weights.append({t: f * idf[t] / norm for t, f in c.items()})
    return idf, math.log(1 + n) + 1, weights


def index(spark: SparkSession) -> DataFrame:
    """One row `index`: by the terms' hashes, of each term its inverse document frequency and, by template, its weight times that."""
    idf, _, weights = model()
    rows = [(t, (w, [(k, v[t] * w) for k, v in enumerate(weights) if t in v])) for t, w in sorted(idf.items())]
    terms = spark.createDataFrame(rows, "term string, of struct<idf: double, of: array<struct<k: int, w: double>>>")
    kept = terms.groupBy(slot(F.col("term")).alias("slot")).agg(F.collect_list(F.struct("term", "of")).alias("terms")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "terms"))).alias("kept"))
    return kept.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.try_element_at("kept", k)).alias("index"))


def slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def statement(text: Column, index: Column, least: float = LEAST_COSINE) -> Column:
    """A struct (cosine, licence) of the best template of one statement; ties go to the first licence.

    Null where the least cosine is out of reach: a vector is at least as long as if each of its terms were another one.
    """
    _, unknown, _ = model()
    names = F.array(*(F.lit(k) for k, _ in TEMPLATES))

    def of_terms(terms: Column) -> Column:
        found = F.transform(terms, lambda t: F.struct(t.alias("t"), F.get(F.filter(F.get(index, slot(t)), lambda k: k["term"] == t), F.lit(0))["of"].alias("x")))
        return let(found, of_found)

    def of_found(found: Column) -> Column:
        square = lambda a: F.pow(a["run"] * a["idf"], F.lit(2.0))
        none = F.struct(F.lit("").alias("t"), F.lit(0).alias("run"), F.lit(0.0).alias("idf"), F.lit(0.0).alias("sum"))

        def longer(a: Column, x: Column) -> Column:
            same = a["t"] == x["t"]
            return F.struct(x["t"].alias("t"), F.when(same, a["run"] + 1).otherwise(F.lit(1)).alias("run"), F.coalesce(x["x"]["idf"], F.lit(unknown)).alias("idf"), (a["sum"] + F.when(same, F.lit(0.0)).otherwise(square(a))).alias("sum"))

        length = F.aggregate(F.array_sort(F.transform(found, lambda x: F.struct(x["t"].alias("t"), F.struct(x["x"]["idf"].alias("idf")).alias("x")))), none, longer, lambda a: F.sqrt(a["sum"] + square(a)))
        hits = F.flatten(F.transform(F.filter(found, lambda x: x["x"].isNotNull()), lambda x: x["x"]["of"]))
        shortest = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.pow(F.coalesce(x["x"]["idf"], F.lit(unknown)), F.lit(2.0)), F.sqrt)
        within = lambda h: F.when(best_of(h, shortest)["cosine"] >= least - 1e-6, let(length, lambda n: best_of(h, n)))
        return F.when(F.size(hits) > 0, let(F.array_sort(hits), within))

    def best_of(hits: Column, length: Column) -> Column:
        none = F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("cosine"), F.lit(None).cast("string").alias("licence"))

        def settle(a: Column) -> Column:
            """The better of the best so far and the template whose weights have all come."""
            cosine, licence = F.round(a["dot"] / length, 9), F.get(names, a["k"])
            better = (cosine > a["cosine"]) | ((cosine == a["cosine"]) & (licence < a["licence"]))
            return F.struct(F.when(better, cosine).otherwise(a["cosine"]).alias("cosine"), F.when(better, licence).otherwise(a["licence"]).alias("licence"))

        def step(a: Column, x: Column) -> Column:
            more = F.struct(a["k"].alias("k"), (a["dot"] + x["w"]).alias("dot"), a["cosine"].alias("cosine"), a["licence"].alias("licence"))
            return F.when(a["k"] == x["k"], more).otherwise(let(settle(a), lambda b: F.struct(x["k"].alias("k"), x["w"].alias("dot"), b["cosine"].alias("cosine"), b["licence"].alias("licence"))))

        return F.aggregate(hits, none, step, settle)

    return let(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.when(F.size(t) > 0, of_terms(t)))


def own_licence(text: Column, whole: Column, index: Column, least: float = LEAST_COSINE) -> Column:
    """A struct (cosine, licence) of a text's best statement, null below the least cosine; whole: the text is one."""
    given = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(given, "\n"), lambda x: x.rlike(CUE))
    blocks = F.filter(F.split(given, GAP), lambda x: x.contains("\n") & x.rlike(CUE))
    units = F.array_distinct(F.concat(lines, blocks, F.when(whole, F.array(given)).otherwise(F.array().cast("array<string>"))))
    scored = F.filter(F.transform(units, lambda u: statement(u, index, least)), lambda s: s["cosine"] >= least)
    best = F.aggregate(scored, F.struct(F.lit(0.0).alias("cosine"), F.lit(None).cast("string").alias("licence")), lambda a, s: F.when((s["cosine"] > a["cosine"]) | ((s["cosine"] == a["cosine"]) & (s["licence"] < a["licence"])), s).otherwise(a))
    found = F.when(given.rlike(CUE) | whole, best)
    return let(found, lambda b: F.when(b["licence"].isNotNull(), b))


def scanned(files: DataFrame, path: Column, text: Column, least: float = LEAST_COSINE) -> tuple[DataFrame, str]:
    """files with one more column, a struct (licence, how, directory), and that column's name.

    how is own, inherited or none; directory is the one that a licence was inherited from.
    """
    name, where, mine, file, known = (fresh(n, files) for n in ("licence_found", "licence_dir", "licence_own", "licence_path", "licence_index"))
    is_file = F.coalesce(path.rlike(LICENCE_FILE), F.lit(False))
    given = files.withColumn(file, path).withColumn(known, index(files.sparkSession).scalar())
    own = F.explode_outer(F.array(own_licence(text, is_file & text.isNotNull(), F.col(known), least)))  # a generator, so that it is worked out once
    parted = given.select(*files.columns, file, own.alias(mine)).withColumn(where, F.when(F.col(file).contains("/"), F.regexp_replace(file, "/[^/]*$", "")).when(F.col(file).isNotNull(), F.lit("")))
    held = F.when(F.col(mine).isNotNull() & F.col(file).rlike(LICENCE_FILE), F.struct((-F.col(mine)["cosine"]).alias("c"), F.col(mine)["licence"].alias("licence"), F.col(file)))
    dirs = materialize(parted.where(F.col(where).isNotNull()).groupBy(F.col(where).alias("dir")).agg(F.min(held).alias("best"), F.bool_or(F.col(mine).isNull()).alias("asks")))
    licensed = dirs.where("best is not null").select(F.col("dir").alias("above"), F.col("best.licence").alias("licence"))
    asking = dirs.where("asks").select("dir")
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))
    nearest = asking.select("dir", F.posexplode(chain).alias("depth", "above")).join(licensed, "above").groupBy("dir").agg(F.max_by(F.struct("licence", F.col("above").alias("directory")), "depth").alias("got"))
    resolved = materialize(nearest.select(F.col("dir").alias(where), F.struct("got.licence", F.lit("inherited").alias("how"), "got.directory").alias(name)))
    few = resolved.count() <= BROADCAST_DIRECTORIES
    joined = parted.join(F.broadcast(resolved) if few else resolved, where, "left")
    nothing = F.lit(None).cast("string")
    found = F.when(F.col(mine).isNotNull(), F.struct(F.col(mine)["licence"].alias("licence"), F.lit("own").alias("how"), nothing.alias("directory"))).otherwise(
        F.coalesce(F.col(name), F.struct(nothing.alias("licence"), F.lit("none").alias("how"), nothing.alias("directory")))
    )
    return joined.withColumn(name, found).select(*files.columns, name), name


#: The documents table has no paths: these are made of its source, language and id, at three depths.
PATH = """concat(coalesce(source, ''), '/', case when doc_id % 10 = 0 then '' when doc_id % 10 < 4 then concat(coalesce(lang, ''), '/') else concat(coalesce(lang, ''), '/', cast(cast(floor(doc_id / 100) as bigint) as string), '/') end,
  case when length(text) < 400 and {cue} then 'LICENSE.' else 'file.' end, cast(doc_id as string))"""


def query(docs: DataFrame) -> DataFrame:
    path = F.expr(PATH.format(cue=f"text rlike '{CUE}'"))
    found, name = scanned(docs.select("doc_id", "source", "lang", "text"), path, F.col("text"))
    x = F.col(name)
    return found.select("doc_id", F.coalesce(x["licence"], F.lit("")).alias("licence"), x["how"].alias("how"), F.coalesce(x["directory"], F.lit("")).alias("directory"))


def oracle() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, licence, text.replace("'", "''").replace("\n", " ")) for k, (licence, text) in enumerate(TEMPLATES))
    path = PATH.format(cue=f"regexp_matches(text, '{CUE}')").replace("as string", "as varchar")
    return f"""
WITH given(k, licence, text) AS (VALUES {quoted}),
counts AS (SELECT k, licence, term, count(*) AS f FROM (SELECT k, licence, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM given) GROUP BY ALL),
idfs AS (SELECT term, ln((1 + (SELECT count(*) FROM given)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
unknown AS (SELECT ln(1 + count(*)) + 1 AS idf FROM given),
tpl AS (SELECT k, licence, term, idf, f * idf / sqrt(sum((f * idf) ** 2) OVER (PARTITION BY k)) AS w FROM counts JOIN idfs USING (term)),
f AS (SELECT doc_id, text, {path} AS path FROM documents),
files AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_matches(path, '/LICENSE[.][^/]*$') AS is_file FROM f),
units AS (
  SELECT doc_id, line, row_number() OVER () AS i FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files
    UNION SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{GAP}')) AS line FROM files) WHERE contains(line, chr(10))
  ) WHERE regexp_matches(line, '{CUE}')
  UNION ALL SELECT doc_id, text, 0 FROM files WHERE is_file
), tf AS (
  SELECT doc_id, i, term, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM units) GROUP BY ALL
), norms AS (SELECT doc_id, i, sqrt(sum((n * coalesce(idfs.idf, unknown.idf)) ** 2)) AS norm FROM tf LEFT JOIN idfs USING (term) CROSS JOIN unknown GROUP BY ALL),
dots AS (SELECT doc_id, i, k, licence, sum(n * w * idf) AS dot FROM tf JOIN tpl USING (term) GROUP BY ALL),
scores AS (SELECT doc_id, licence, round(dot / norm, 9) AS cosine FROM dots JOIN norms USING (doc_id, i) WHERE round(dot / norm, 9) >= {LEAST_COSINE}),
own AS (SELECT doc_id, licence, cosine FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
licensed AS (SELECT dir, licence FROM files JOIN own USING (doc_id) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence, path) = 1),
near AS (
  SELECT a.dir, l.licence, l.dir AS directory FROM (SELECT DISTINCT dir FROM files) a JOIN licensed l ON a.dir = l.dir OR starts_with(a.dir, l.dir || '/') OR l.dir = ''
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(l.dir) DESC) = 1
)
SELECT doc_id, coalesce(o.licence, n.licence, '') AS licence, CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN o.licence IS NULL THEN coalesce(n.directory, '') ELSE '' END AS directory
FROM files LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (dir)
"""
