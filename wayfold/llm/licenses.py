"""Licence scans by canonical digest lookup, in DataFrame functions alone.

A text is normalised line by line: lower case, British spellings and sign variants replaced, everything but letters and
digits turned into single spaces, copyright lines and empty lines dropped. The whole text, each run of lines between empty
ones and each line are then looked up by SHA-256 among the digests of known licences, licence headers and notices. Only
units that are as long as some known text are digested and joined; the known digests, a few hundred rows of fixed number,
are broadcast. A licence text of several paragraphs is known by the whole; ``extra`` adds further texts.

The method finds entire texts: a licence notice on a line of its own, a header in a paragraph of its own however it is
wrapped, or a text that is nothing but a licence. A notice inside a longer line isn't found.

Defined results: null and empty texts match nothing; texts of any length are scanned whole; a licence that a text has
several times counts each line but is named once; a text that several licences share names them all; repeated rows are
scanned each for itself, under their identifier; no rows give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of licences as notices spell them.
NAMES = [
    ("MIT", "the MIT License"),
    ("Apache-1.1", "the Apache License, Version 1.1"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("Unlicense", "the Unlicense"),
    ("Zlib", "the zlib License"),
]
#: Creative Commons: kinds and versions, spelled by rule.
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is released under {}.", "This file is licensed under {}."]

#: Whole licence texts, without their copyright lines.
TEXTS = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": "BSD 2-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "BSD 3-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "The Unlicense\n\nThis is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
}

#: Headers that stand in files under a licence.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
]
#: Headers of the GNU licences: identifier, name, version.
GNU = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
GNU_HEADER = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def known() -> list[tuple[str, str]]:
    """(licence, text) of all known texts and notices."""
    names = NAMES + [(f"CC-{k}-{v}", f"{pre} {k} {v}") for k in CC_KINDS for v in CC_VERSIONS for pre in ("CC", "Creative Commons")] + [("CC0-1.0", "CC0 1.0")]
    notices = [(i, n.format(name)) for i, name in names for n in NOTICES] + [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in names)]
    gnu = [(i, GNU_HEADER.format(what, name, version)) for i, name, version in GNU for what in ("program", "library", "file")]
    return notices + HEADERS + gnu + list(TEXTS.items()) + [(i, t.split("\n\n", 1)[1]) for i, t in TEXTS.items()]


#: Replacements before digits and letters are kept: sign variants and spellings.
SPELLINGS = [("©", " copyright "), ("(c)", " copyright "), ("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("https://", "http://"), ("acknowledgement", "acknowledgment"), ("&", " and ")]
_COPYRIGHT = "^(copyright|all rights reserved)( |$)"


def all_lines(text: Column) -> Column:
    """The normalised lines of a text; copyright lines are dropped, empty ones are not."""

    def line(x: Column) -> Column:
        x = F.lower(x)
        for a, b in SPELLINGS:
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " "))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: ~x.rlike(_COPYRIGHT))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, copyright lines and empty ones dropped."""
    return F.filter(all_lines(text), lambda x: x != "")


def paragraphs(lines: Column) -> Column:
    """Runs of two and more of ``all_lines`` between empty ones, each as one text."""
    runs = F.split(F.array_join(lines, "\n"), "\n\n+")
    return F.transform(F.filter(F.transform(runs, lambda x: F.trim(x, F.lit("\n"))), lambda x: F.contains(x, F.lit("\n"))), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))


def known_digests(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """license_id, digest, size of the known texts, and of those in ``extra`` (license_id, text)."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known()])
    texts = spark.range(1).select(F.inline(rows))
    if extra is not None:
        texts = texts.unionByName(extra.select("license_id", "text"))
    unit = F.array_join(normal_lines(F.col("text")), " ")
    return texts.select("license_id", unit.alias("unit")).select("license_id", F.sha2("unit", 256).alias("digest"), F.length("unit").alias("size")).distinct()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: DataFrame | None = None) -> DataFrame:
    """A row for each document that has a licence: doc_id, license_ids (sorted, by commas), n_lines (lines that are one),
    whole_text (all of it is one). A document whose paragraphs alone are licences has neither."""
    spark = docs.sparkSession
    digests = known_digests(spark, extra)
    sizes = [r[0] for r in digests.select("size").distinct().collect()]
    lines = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), all_lines(F.col(text_col)).alias("lines"))

    def units_of(units: Column, kind: int) -> Column:
        fit = F.filter(units, lambda u: F.length(u).isin(sizes))
        return F.transform(fit, lambda x: F.struct(x.alias("unit"), F.lit(kind).alias("kind")))

    solid = F.filter("lines", lambda x: x != "")
    fit = F.concat(units_of(F.array(F.array_join(solid, " ")), 2), units_of(paragraphs(F.col("lines")), 1), units_of(solid, 0))
    found = lines.select("doc_id", "row", F.inline(fit)).withColumn("digest", F.sha2("unit", 256))
    hits = found.join(F.broadcast(digests), "digest")
    out = hits.groupBy("row", "doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("license_ids"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("n_lines"),
        (F.max("kind") == 2).alias("whole_text"),
    )
    return out.drop("row")


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        e = "lower(x)"
        for a, b in SPELLINGS:
            e = f"replace({e}, {quoted(a)}, {quoted(b)})"
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda x: NOT regexp_matches(x, {quoted(_COPYRIGHT)}))"

    solid = "list_filter(lines, lambda x: x <> '')"
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known())
    return f"""
WITH known(license_id, text) AS (VALUES {values}),
digests AS (SELECT DISTINCT license_id, array_to_string({solid}, ' ') AS unit FROM (SELECT license_id, {lines('text')} AS lines FROM known)),
lines AS (SELECT doc_id, {lines('text')} AS lines FROM documents WHERE text IS NOT NULL),
runs AS (
    SELECT doc_id, unnest(string_split(regexp_replace(array_to_string(lines, chr(10)), '\\n\\n+', chr(1), 'g'), chr(1))) AS run FROM lines),
units AS (
    SELECT doc_id, array_to_string({solid}, ' ') AS unit, 2 AS kind FROM lines
    UNION ALL SELECT doc_id, replace(trim(run, chr(10)), chr(10), ' '), 1 FROM runs WHERE contains(trim(run, chr(10)), chr(10))
    UNION ALL SELECT doc_id, unnest({solid}), 0 FROM lines)
SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids,
       count(*) FILTER (kind = 0) AS n_lines, max(kind) = 2 AS whole_text
FROM units JOIN digests USING (unit) GROUP BY doc_id
"""
