"""License scans: TF-IDF cosine to templates, then directory inheritance.

A unit is a line or sentence that holds a trigger word, the header (the first
``HEADER_LINES`` lines) of a file that has such a line, or the whole text of
a file named as a licence file. Templates are notices and licence texts; of
very long licences their opening. Units and templates are sparse term vectors, weighted by term frequency times inverse document
frequency over all documents. With ``corpus_terms`` that is counted for every
term of a template or unit, so that scores do not fall as a corpus of equal
rates grows; without, for the templates' terms only, and any other term
weighs as one found in a single document. The best template of a document's units
is its own licence if the cosine reaches the threshold; the whole of a licence file
decides before a header, and a header before single lines. A file named as a
licence file gives its licence to its directory; a file without a licence of
its own takes that of the nearest ancestor directory that has one, by joins
on paths.

DataFrame functions only. Scale: texts are read twice and never shuffled
(once for term frequencies, which are combined before the exchange, once for
units, which are few). Tables of the templates and their terms have a fixed
bound and are broadcast; weights of other terms are joined to the units'
terms. Inheritance joins distinct directories with their ancestors
(as many rows as a path has parts); files join back by directory, which
adaptive execution can split where one directory is hot.

Edge cases: null and empty texts have no units; a null path is a file in no
directory; of equal scores the template that comes first in the alphabet
wins; of several licence files in a directory that of the best score, then
of the least path. Repeated rows get equal results. Columns other than those
named in the arguments are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm.storage import materialise

THRESHOLD = 0.6
HEADER_LINES = 30
TRIGGER = r"(?i)licen[cs]e|copyright|copyleft|spdx|public domain|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying"

# fixed values: texts of public licences
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU_TITLE = "GNU {NAME} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Notices and texts of public licences: (identifier, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0 Universal."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _NO_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. \"You\" (or \"Your\") shall mean an individual or Legal Entity exercising permissions granted by this License. \"Source\" form shall mean the preferred form for making modifications. \"Object\" form shall mean any form resulting from mechanical transformation or translation of a Source form. \"Work\" shall mean the work of authorship made available under the License. \"Derivative Works\" shall mean any work that is based on (or derived from) the Work. \"Contribution\" shall mean any work of authorship intentionally submitted to Licensor for inclusion in the Work. \"Contributor\" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor."),
    ("GPL-3.0", _GNU_HEADER.format(name="General Public License", version="3")),
    ("GPL-3.0", _GNU_TITLE.format(NAME="GENERAL PUBLIC LICENSE", version="3")),
    ("GPL-2.0", _GNU_HEADER.format(name="General Public License", version="2")),
    ("GPL-2.0", _GNU_TITLE.format(NAME="GENERAL PUBLIC LICENSE", version="2")),
    ("AGPL-3.0", _GNU_HEADER.format(name="Affero General Public License", version="3")),
    ("AGPL-3.0", _GNU_TITLE.format(NAME="AFFERO GENERAL PUBLIC LICENSE", version="3")),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("LGPL-3.0", _GNU_HEADER.format(name="Lesser General Public License", version="3")),
    ("LGPL-2.1", _GNU_HEADER.format(name="Lesser General Public License", version="2.1")),
    ("LGPL-2.1", _GNU_TITLE.format(NAME="LESSER GENERAL PUBLIC LICENSE", version="2.1")),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
)

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r"


def _terms(text: Column) -> Column:
    """Lower-cased runs between ASCII punctuation and white space."""
    return F.filter(F.split(F.translate(F.lower(text), _MARKS, " " * len(_MARKS)), " "), lambda t: t != "")


def _units(text: Column, named: Column) -> Column:
    """Lines and sentences with a trigger word, the header around them, and the whole of a licence file."""
    told = F.filter(F.split(text, r"\n|(?<=[.!?])\s+"), lambda u: u.rlike(TRIGGER))
    lines = F.slice(F.split(text, "\n"), 1, HEADER_LINES)
    head = F.array_join(lines, "\n")
    none = F.array().cast("array<struct<kind:int,body:string>>")
    of_kind = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))

    def all_units(found: Column) -> Column:
        header = F.when((F.size(found) > 0) & (F.size(lines) > 1) & head.rlike(TRIGGER), F.array(of_kind(1, head))).otherwise(none)
        whole = F.when(named & (text != ""), F.array(of_kind(0, text))).otherwise(none)
        return F.concat(whole, header, F.transform(F.array_distinct(found), lambda u: of_kind(2, u)))

    return F.get(F.transform(F.array(told), all_units), F.lit(0))


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    texts = spark.createDataFrame(rows, "template int, license string, body string")
    return texts.select("template", "license", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(files: DataFrame, text: str = "text", units: DataFrame | None = None) -> DataFrame:
    """``term, idf`` of the templates' terms, those of ``units`` if given, and, as term null, of any other."""
    spark = files.sparkSession
    names = sorted({t for r in _template_rows(spark).select("term").distinct().collect() for t in r})  # fixed: the templates' words
    every = spark.createDataFrame([(t,) for t in [*names, None]], "term string")
    terms = _terms(F.coalesce(F.col(text).cast("string"), F.lit("")))
    held = F.array_distinct(terms) if units is not None else F.array_intersect(terms, F.array(*(F.lit(t) for t in names)))
    # one more entry, null, counts the documents themselves
    found = files.select(F.explode(F.concat(held, F.array(F.lit(None).cast("string")))).alias("term"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if units is not None:
        every = every.union(units.select("term")).distinct()
        counts = counts.join(every.withColumnRenamed("term", "wanted"), F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
    counts = materialise(counts, "frequencies")
    total = F.broadcast(counts.filter("term IS NULL").select(F.col("df").alias("documents")))
    joined = every.join(counts.filter("term IS NOT NULL"), "term", "left").join(total, how="left")
    return joined.select("term", F.log((F.coalesce("documents", F.lit(0)) + 1) / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)) + 1).alias("idf"))


def own_licenses(files: DataFrame, key: str, text: str = "text", path: str = "path", corpus_terms: bool = False) -> DataFrame:
    """``key, license, score`` of each row with a unit over the threshold."""
    spark = files.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.coalesce(F.element_at(F.split(F.col(path), "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    hit = files.select(F.col(key), F.posexplode(_units(body, named)).alias("at", "u")).distinct()
    hit = hit.select(key, F.struct("u.kind", "at").alias("unit"), "u.body")
    terms = hit.select(key, "unit", F.explode(_terms(F.col("body"))).alias("term")).groupBy(key, "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = materialise(terms, "units")

    weights = materialise(term_weights(files, text, terms if corpus_terms else None), "weights")
    other = weights.filter("term IS NULL").select(F.col("idf").alias("other"))
    known = weights.filter("term IS NOT NULL")
    templates = _template_rows(spark).join(known if corpus_terms else F.broadcast(known), "term").withColumn("w", F.col("tf") * F.col("idf"))
    templates = materialise(templates.select("template", "license", "term", "w"), "templates")
    sizes = templates.groupBy("template", "license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))

    terms = terms.join(known if corpus_terms else F.broadcast(known), "term", "left").join(F.broadcast(other), how="left")
    terms = terms.withColumn("w", F.col("tf") * F.coalesce("idf", "other"))
    vectors = terms.groupBy(key, "unit").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", F.col("w").alias("u")))).alias("entries")
    )
    dots = vectors.withColumn("e", F.explode("entries")).select(key, "unit", "norm", "e.*").join(F.broadcast(templates), "term")
    dots = dots.groupBy(key, "unit", "norm", "template", "license").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(F.broadcast(sizes), ["template", "license"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6))
    best = scored.filter(F.col("score") >= THRESHOLD).groupBy(key).agg(F.min(F.struct("unit.kind", (-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select(key, F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def inherit(files: DataFrame) -> DataFrame:
    """Give files without a licence that of the nearest ancestor directory.

    ``files`` has path, license, score. Adds ``basis`` (own, inherited or
    null) and ``license_path`` (the file the licence was read in).
    """
    parts = F.split(F.col("path"), "/")
    dirs = F.when(F.col("path").isNotNull(), F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)))
    files = files.withColumn("dir", dirs)
    named = files.filter(F.col("license").isNotNull() & F.element_at(parts, -1).rlike(LICENCE_FILE) & F.col("dir").isNotNull())
    giving = named.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("path").alias("license_path"), "license")).alias("g"))
    giving = materialise(giving.select("from_dir", "g.license_path", F.col("g.license").alias("given")), "directories")
    distinct = files.filter(F.col("dir").isNotNull() & F.col("license").isNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    up = distinct.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, 1, n)))).alias("depth", "from_dir"))
    nearest = up.distinct().join(giving, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_path", "given")).alias("n"))
    nearest = nearest.select("dir", F.col("n.license_path").alias("from_path"), F.col("n.given").alias("given"))
    out = files.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.withColumn("basis", F.when(own, "own").when(F.col("given").isNotNull(), "inherited")).withColumn(
        "license_path", F.when(own, F.col("path")).otherwise(F.col("from_path"))
    ).withColumn("license", F.coalesce("license", "given")).drop("dir", "from_path", "given")


def license_scan(files: DataFrame, path: str = "path", text: str = "text", corpus_terms: bool = False) -> DataFrame:
    """Licences of files. One row for each row of ``files``.

    Returns doc_id, path, license, score (of an own licence), basis and
    license_path.
    """
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    # rows of different ids never meet, however many there are
    rows = rows.withColumn("row_key", F.struct(F.coalesce("doc_id", F.xxhash64("path", "text")).alias("id"), F.xxhash64("doc_id", "path", "text").alias("hash")))
    own = own_licenses(rows, "row_key", corpus_terms=corpus_terms)
    out = rows.drop("text").join(own, "row_key", "left")
    return inherit(materialise(out, "own")).select("doc_id", "path", "license", "score", "basis", "license_path")
