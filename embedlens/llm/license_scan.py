"""License scan: canonical digests of entire texts, hash-joined to the digests of known licence texts.

Canonical form: A-Z lower-cased, copyright lines taken out (of a line that goes on with a notice only the copyright clause), every run of
characters other than a-z and 0-9 made one space, equivalent spellings made one. Its sha256 is looked up. An "entire text" is a document;
each of its lines, since notices often stand in a line of their own; and each run of passages (lines without an empty one between; comment
marks don't count) that is as long as a known text, since licences stand wrapped in larger files. Only DataFrame functions are used; the
known table is small, so it is broadcast.

Defined cases: null or empty text matches nothing. A text that is nothing but copyright lines has the empty canonical form, which
matches nothing. Every input row gives one row with its own counts, whether its doc_id is null or repeated or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch, lower_az

# Known notices and licence texts, in the words of their public sources.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# Equivalent spellings, applied in this order to words of the canonical form.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("neighbouring", "neighboring"), ("https", "http"), ("v", "version"), ("creativecommons", "creative commons")]
#: Mentions of copyright inside a licence's own words, which are no copyright line wherever a line breaks.
MENTION = r"copyright[^a-z0-9]+(notice|holder|owner|law|licen|statement|interest|and |or )"
#: A copyright clause at a line's start that a notice follows after a full stop: the notice stays. Any other copyright line goes.
CLAUSE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*?\.[ \t]+((licen[cs]ed|released|all rights|this|permission|redistribution|use of)[^\n]*)$"
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical_lines(c: Column) -> Column:
    """A text's lines in canonical form but for spellings, empty ones too: A-Z lower-cased, copyright taken out, all else that is not a
    letter a-z or a digit one space, none at a line's ends."""
    c = F.regexp_replace(lower_az(c), MENTION, "copyr $1")
    c = F.regexp_replace(F.regexp_replace(c, CLAUSE, "$2"), COPYRIGHT, "")
    return F.transform(F.split(F.regexp_replace(c, "[^a-z0-9\n]+", " "), "\n"), lambda x: F.trim(x))


def spelled(c: Column) -> Column:
    """One unit of canonical words, equivalent spellings made one."""
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(c)


def whole_text(lines: Column) -> Column:
    return spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def passages(lines: Column) -> Column:
    """The runs of non-empty lines, each as one unit."""
    runs = F.split(F.array_join(lines, "\n"), "\n\n+")
    return F.filter(F.transform(runs, lambda x: spelled(F.trim(F.replace(x, F.lit("\n"), F.lit(" "))))), lambda x: x != "")


def license_scan(documents: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """doc_id, license_id (of the whole text; null: none), n_license_lines, line_licenses, n_license_passages, passage_licenses (names
    distinct, sorted, joined by commas). ``known`` is (license_id, text): a table of at most some thousand texts, which is broadcast."""
    spark = documents.sparkSession
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, known string")
    table = table.toDF("license_id", "known").select("license_id", passages(canonical_lines(F.col("known"))).alias("ps"))
    table = table.where(F.size("ps") > 0).select("license_id", F.sha2(F.element_at("ps", 1), 256).alias("head"), F.size("ps").alias("n"), F.sha2(spelled(F.array_join("ps", " ")), 256).alias("digest"))
    entries = table.collect()  # a row a known text; one text may be known with other passages
    table = F.broadcast(spark.createDataFrame([(r["digest"], r["license_id"]) for r in entries], "digest string, license_id string").groupBy("digest").agg(F.min("license_id").alias("license_id")))
    literal = lambda values, kind: F.array(*map(F.lit, sorted(values))).cast(f"array<{kind}>")
    heads, lengths, digests = literal({r["head"] for r in entries}, "string"), literal({r["n"] for r in entries}, "int"), literal({r["digest"] for r in entries}, "string")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.coalesce("text", F.lit(""))).alias("c"))
    source = source.select("doc_id", "c", passages(F.col("c")).alias("ps"))
    known_only = lambda units: F.filter(units, lambda x: F.array_contains(digests, x))
    lines = F.transform(F.filter("c", lambda x: x != ""), lambda x: F.sha2(spelled(x), 256))
    # windows of as many passages as a known text has are only digested from a passage on that is a known text's first
    starts = F.filter(F.transform("ps", lambda p, i: F.when(F.array_contains(heads, F.sha2(p, 256)), i + 1)), lambda i: i.isNotNull())
    ends = lambda i: F.filter(lengths, lambda n: i + n - 1 <= F.size("ps"))
    windows = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda n: F.sha2(spelled(F.array_join(F.slice("ps", i, n), " ")), 256))))
    # texts are worked off once; what is known of them is written, and joined to its names
    rows = source.select("doc_id", F.sha2(whole_text(F.col("c")), 256).alias("digest"), known_only(lines).alias("line"), known_only(windows).alias("passage"))
    rows = Scratch(spark, "licenses").stash(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # numbers hold once written

    def found(name: str) -> DataFrame:
        hits = rows.select("row", F.explode(name).alias("digest")).join(table, "digest").groupBy("row")
        return hits.agg(F.count("*").alias(f"n_license_{name}s"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias(f"{name}_licenses"))

    whole = rows.select("row", "doc_id", "digest").join(table, "digest", "left").select("row", "doc_id", "license_id")
    both = whole.join(found("line"), "row", "left").join(found("passage"), "row", "left")
    counted = lambda name: (F.coalesce(f"n_license_{name}s", F.lit(0)).cast("long").alias(f"n_license_{name}s"), F.coalesce(f"{name}_licenses", F.lit("")).alias(f"{name}_licenses"))
    return both.select("doc_id", "license_id", *counted("line"), *counted("passage"))


def _sql() -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def form(x: str) -> str:
        c = f"regexp_replace(regexp_replace(regexp_replace(translate({x}, {az}), '{MENTION}', 'copyr \\1', 'g'), '{CLAUSE}', '\\2', 'g'), '{COPYRIGHT}', '', 'g')"
        return f"trim(regexp_replace(regexp_replace({c}, '[^a-z0-9\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ')"

    def spell(x: str) -> str:
        c = f"' ' || regexp_replace({x}, '[ \n]+', ' ', 'g') || ' '"
        for old, new in SPELLINGS:
            c = f"replace({c}, ' {old} ', ' {new} ')"
        return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"

    runs = f"list_filter(list_transform(string_split(regexp_replace(c, '\n\n+', chr(1), 'g'), chr(1)), lambda p: {spell('p')}), lambda p: p <> '')"
    rows = ", ".join("('" + i + "', '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for i, t in KNOWN)
    return f"""
WITH texts AS (
  SELECT i, sha256({spell("array_to_string(ps, ' ')")}) AS digest, sha256(ps[1]) AS head, len(ps) AS n
  FROM (SELECT i, {runs} AS ps FROM (SELECT i, {form("t")} AS c FROM (VALUES {rows}) AS v(i, t)))
), known AS (SELECT digest, min(i) AS license_id FROM texts GROUP BY 1
), d AS (SELECT doc_id, {form("coalesce(text, '')")} AS c FROM documents),
ls AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, sha256({spell("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM d) WHERE line <> '') JOIN known USING (digest) GROUP BY doc_id
), pl AS (SELECT doc_id, {runs} AS ps FROM d),
ws AS (SELECT doc_id, ps, i, sha256(ps[i]) AS head FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM pl)),
pw AS (SELECT w.doc_id, sha256({spell("array_to_string(w.ps[w.i:w.i + k.n - 1], ' ')")}) AS digest FROM (SELECT * FROM ws WHERE head IN (SELECT head FROM texts)) w, (SELECT DISTINCT n FROM texts) k WHERE w.i + k.n - 1 <= len(w.ps)),
pm AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM pw JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, k.license_id, CAST(coalesce(ls.n, 0) AS BIGINT) AS n_license_lines, coalesce(ls.ids, '') AS line_licenses, CAST(coalesce(pm.n, 0) AS BIGINT) AS n_license_passages, coalesce(pm.ids, '') AS passage_licenses
FROM (SELECT doc_id, sha256({spell("c")}) AS digest FROM d) d
LEFT JOIN known k ON d.digest = k.digest LEFT JOIN ls ON d.doc_id = ls.doc_id LEFT JOIN pm ON d.doc_id = pm.doc_id
"""


SQL = _sql()
