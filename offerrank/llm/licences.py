"""License scan by canonical digests.

A text is brought to a canonical form - A-Z in lower case, copyright lines
removed, equivalent spellings made one, everything but letters and digits
turned into single spaces - and its SHA-256 is looked up in a hash join with
the digests of known licences. Whole texts must agree, so a match is certain.
A second lookup does the same for each line of a text: licence notices often
stand in a line of their own.

Null texts count as empty and match nothing, as do texts without letters or
digits. Repeated rows each come back. An empty table gives an empty result;
only the two named columns are read. Everything is built from column
functions; no Python runs in tasks.

The long licences stand in ``licence_texts`` under their SPDX names, and
``SHIPPED`` says which parts of a file are known: the whole, the terms
without the advice after them, the notice that the advice recommends. A text
alone cannot tell "only" from "or later"; whole GNU texts are named without.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that stand for each other.
ALIKE = ("‘’“”–—− ", "''\"\"--- ")
#: A line that begins with ``(c)`` is only one with a year or name of rights after it; otherwise it is item c of a list.
COPYRIGHT_LINE = (r"(^|\n)[^\na-z0-9]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by |[\[<{])|\(c\)[ \t,]*(?:[0-9]{4}|copyright|[\[<{])|©|all rights reserved)"
                  r"[^\n]*")
#: Equivalent spellings, after punctuation has become spaces.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensable", "sublicensable"),
             ("organis", "organiz"), ("favour", "favor"), ("honour", "honor"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
             ("labour", "labor"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"), ("cc by nc 4 0", "creative commons attribution noncommercial 4 0"),
             ("https ", "http "), ("noninfringement", "non infringement"), ("what so ever", "whatsoever"))

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
#: Licence texts and notices under their SPDX names.
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ISC.replace(",\nprovided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_NAMES + BSD_TAIL),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)
#: Parts of the shipped files that are known: SPDX name, file, first words of the part (none: from the start), words it ends before (none: to the end).
SHIPPED = (
    ("Apache-2.0", "Apache-2.0", "", ""), ("Apache-2.0", "Apache-2.0", "", "APPENDIX: How to apply"), ("Apache-2.0", "Apache-2.0", "", "END OF TERMS"),
    ("Artistic-1.0-Perl", "Artistic-1.0-Perl", "", ""), ("BSD-3-Clause", "BSD-3-Clause-UC", "", ""), ("BSL-1.0", "BSL-1.0", "", ""),
    ("BSL-1.0", "BSL-1.0", "Permission is hereby", ""), ("CC0-1.0", "CC0-1.0", "", ""), ("CC0-1.0", "CC0-1.0", "CC0 1.0 Universal", ""),
    ("GFDL-1.2", "GFDL-1.2", "", ""), ("GFDL-1.2", "GFDL-1.2", "", "ADDENDUM: How to use"), ("GFDL-1.3", "GFDL-1.3", "", ""),
    ("GFDL-1.3", "GFDL-1.3", "", "ADDENDUM: How to use"), ("GPL-1.0", "GPL-1.0", "", ""), ("GPL-1.0", "GPL-1.0", "", "END OF TERMS"),
    ("GPL-2.0", "GPL-2.0", "", ""), ("GPL-2.0", "GPL-2.0", "", "END OF TERMS"), ("GPL-3.0", "GPL-3.0", "", ""), ("GPL-3.0", "GPL-3.0", "", "END OF TERMS"),
    ("GPL-1.0-or-later", "GPL-1.0", "This program is free software;", "Also add information"),
    ("GPL-2.0-or-later", "GPL-2.0", "This program is free software;", "Also add information"),
    ("GPL-3.0-or-later", "GPL-3.0", "This program is free software:", "Also add information"),
    ("LGPL-2.0", "LGPL-2.0", "", ""), ("LGPL-2.0", "LGPL-2.0", "", "END OF TERMS"), ("LGPL-2.1", "LGPL-2.1", "", ""), ("LGPL-2.1", "LGPL-2.1", "", "END OF TERMS"),
    ("LGPL-2.0-or-later", "LGPL-2.0", "This library is free software;", "Also add information"),
    ("LGPL-2.1-or-later", "LGPL-2.1", "This library is free software;", "Also add information"),
    ("LGPL-3.0", "LGPL-3.0", "", ""), ("MPL-1.1", "MPL-1.1", "", ""), ("MPL-2.0", "MPL-2.0", "", ""), ("MPL-2.0", "MPL-2.0", "", "Exhibit A - Source Code"),
    ("MPL-2.0", "MPL-2.0", "This Source Code Form is subject to the terms", "If it is not possible or desirable"),
    ("Unlicense", "Unlicense", "", ""),
)


@lru_cache(1)
def all_known() -> tuple:
    """``KNOWN`` and the parts of the shipped files: SPDX name and text."""
    parts = []
    for name, file, start, end in SHIPPED:
        text = (files("offerrank.llm") / "licence_texts" / f"{file}.txt").read_text("utf-8")
        text = text[text.index(start):]
        parts.append((name, text[:text.index(end)] if end else text))
    return KNOWN + tuple(parts)


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends kept."""
    low = F.translate(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), *ALIKE)
    low = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, "$1"), "&", " and ")
    low = F.regexp_replace(low, r"[^\na-z0-9\x{80}-\x{10FFFF}]+", " ")
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    return low


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[\n ]+", " "))


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_digests(spark: SparkSession, licences: tuple | None = None) -> DataFrame:
    """``known`` digest and ``license_id``; of licences with the same canonical text the first by name."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in licences or all_known()])
    listed = spark.range(1).select(F.inline(rows))
    return (listed.select("license_id", digest(whole(canonical_lines(F.col("text")))).alias("known")).filter("known is not null")
            .groupBy("known").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, licences: tuple | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest``, ``license_id`` of the whole text, ``notices`` (licences of single lines, sorted, joined by commas).

    The digests of the listed licences are found once; as many as the list has
    they are broadcast for the whole texts and held in a map for the lines.
    """
    spark = docs.sparkSession
    listed = [(F.lit(r["known"]), F.lit(r["license_id"])) for r in known_digests(spark, licences).collect()]
    by_digest = F.create_map(*[x for kv in listed for x in kv]) if listed else F.create_map().cast("map<string,string>")
    known = F.broadcast(spark.range(1).select(F.explode(by_digest).alias("known", "license_id")))
    lines = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    hashed = lines.select("id", digest(whole(F.col("lines"))).alias("digest"),
                          F.transform(F.split("lines", "\n"), lambda x: F.sha2(F.trim(x), 256)).alias("line_digests"))
    found = hashed.join(known, F.col("digest") == F.col("known"), "left")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("line_digests", lambda x: F.try_element_at(by_digest, x)), F.isnotnull)))
    return found.select("id", "digest", "license_id", F.when(F.size(names) > 0, F.array_join(names, ",")).alias("notices"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def canonical_sql(text: str) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    low = f"translate(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {quoted(ALIKE[0])}, {quoted(ALIKE[1])})"
    low = f"replace(regexp_replace({low}, '{COPYRIGHT_LINE}', '\\1', 'g'), '&', ' and ')"
    low = f"regexp_replace({low}, '[^\\na-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
    for old, new in SPELLINGS:
        low = f"replace({low}, '{old}', '{new}')"
    return low


def plain_canonical(text: str) -> str:
    """The canonical form of a listed licence, line by line in plain Python, apart from the operator."""
    low = text.translate(str.maketrans(UPPER + ALIKE[0], LOWER + ALIKE[1]))
    rights = re.compile(r"[^a-z0-9]*(copyright[ \t]*(\(c\)|©|\d{4}|by |[\[<{])|\(c\)[ \t,]*(\d{4}|copyright|[\[<{])|©|all rights reserved)", re.ASCII)
    kept = "\n".join("" if rights.match(line) else line for line in low.split("\n")).replace("&", " and ")
    # as in the operator, words of a line are one space apart, and a line that begins or ends in other characters has a space there
    kept = re.sub("[^\na-z0-9\x80-\U0010ffff]+", " ", kept)
    for old, new in SPELLINGS:
        kept = kept.replace(old, new)
    return " ".join(x for x in re.split("[\n ]+", kept) if x)


def sql() -> str:
    forms: dict[str, str] = {}
    for name, text in all_known():
        form = plain_canonical(text)
        if form:
            forms[form] = min(name, forms.get(form, name))
    rows = ", ".join(f"('{hashlib.sha256(form.encode()).hexdigest()}', '{name}')" for form, name in forms.items())
    joined = "trim(regexp_replace(lines, '[\\n ]+', ' ', 'g'))"
    return f"""
WITH known(form, license_id) AS (VALUES {rows}),
canon AS (SELECT row_number() OVER () AS r, doc_id, {canonical_sql('text')} AS lines FROM documents),
notices AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT r, trim(unnest(string_split(lines, chr(10)))) AS line FROM canon) JOIN known ON sha256(line) = form GROUP BY r)
SELECT doc_id, CASE WHEN {joined} <> '' THEN sha256({joined}) END AS digest, license_id, notices
FROM canon LEFT JOIN known ON sha256({joined}) = form LEFT JOIN notices USING (r)
"""
