"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings) and its SHA-256 is joined
to the digests of known licences, which went through the same expressions. Texts that differ from a licence only by title lines, list markers
or comment signs are found by a second digest, of what is left without these. Each line's digest is looked up among those
of known one-line notices in the same way.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, replaced wherever they stand.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("https", "http"), ("version 2 0", "version 2"), ("version 3 0", "version 3"),
]
#: A statement: with a mark, a year, a placeholder or "by"; not a clause's line that happens to begin with the word.
COPYRIGHT_LINE = r"(?m)^[ \t\r]*(?:copyright(?:[ \t:,]*(?:\(c\)|©|by |[\[<{])|[^\n]*(?:19|20)[0-9][0-9])|\(c\)[ \t]*(?:copyright|by |(?:19|20)[0-9][0-9])|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: What may stand before a line: bullets and comment signs, and then a number or letter of a list.
BULLET = r"(?m)^[ \t\r*•#/;+-]+"
LIST_MARKER = r"(?m)^\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)][ \t]+"
#: Up to three lines of a few words with "license" near their end, of the canonical text's beginning.
TITLE = r"\A[ \n]*+(?:(?:[\p{L}\p{N}]+ ){0,7}license(?: [\p{L}\p{N}]{1,12}){0,2} *\n[ \n]*+){0,3}"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts by SPDX identifier.
LICENCES = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}""",
    "MIT-0": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

{_WARRANTY}""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_ISC_WARRANTY}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_ISC_WARRANTY}""",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: One-line notices by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: Names by SPDX identifier, and the lines that are notices with each of them, beside NOTICES.
NAMES = [
    ("MIT", "MIT License"), ("MIT-0", "MIT No Attribution License"), ("ISC", "ISC License"), ("0BSD", "Zero-Clause BSD License"), ("Zlib", "zlib License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "Simplified BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "New BSD License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("Unlicense", "Unlicense"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("MPL-1.1", "Mozilla Public License, version 1.1"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
_SAID = [f"{what}licensed under {the}" for what in ("", "This work is ", "This project is ", "This software is ") for the in ("", "the ")] + [f"{how} under {the}" for how in ("Released", "Distributed") for the in ("", "the ")]


def all_notices() -> list[tuple[str, str]]:
    """NOTICES, and each name in each form; every form has the word "license" in it, as said lines or as identifier."""
    said = [(i, f"{form}{name}") for i, name in NAMES for form in _SAID if "licens" in f"{form}{name}".lower()]
    return NOTICES + said + [(i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in NAMES} | {"GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"})]


def _spelled(t: Column) -> Column:
    t = F.regexp_replace(t, PUNCTUATION, " ")
    for one, other in SPELLINGS:
        t = F.replace(t, F.lit(one), F.lit(other))
    return t


def canonical_lines(text: Column) -> Column:
    """Canonical text that keeps its line breaks."""
    return _spelled(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, ""))


def body_text(text: Column) -> Column:
    """Canonical text without bullets, comment signs, list markers and title lines."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BULLET, "")
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), LIST_MARKER, "")
    return canonical_text(F.regexp_replace(F.regexp_replace(_spelled(t), r"(?m)^ +| +$", ""), TITLE, ""))


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, license_id): as many rows as LICENCES has, whatever the input's size."""
    df = spark.createDataFrame(list(LICENCES.items()), "license_id string, text string")
    return df.select(F.sha2(canonical_text(canonical_lines(F.col("text"))), 256).alias("text_digest"), "license_id")


def default_catalogue(spark: SparkSession) -> DataFrame:
    """(license_id, text): LICENCES and the files of licence_texts."""
    files = [f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    rows = list(LICENCES.items()) + sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files)
    return spark.createDataFrame(rows, "license_id string, text string")


def scan_licences(docs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, notice_ids) for each row of ``docs`` (doc_id, text; other columns are ignored).

    text_digest is the canonical text's SHA-256; license_id names the licence of ``catalogue`` (license_id, text) that the
    whole text is, title lines, list markers and comment signs aside, or is null; of several the one whose canonical text is
    equal, then the smallest. notice_ids has the distinct licences named by whole lines that are known notices, sorted and
    comma-joined, else null. A null or empty text has the digest of the empty string and matches nothing. Repeated rows and
    null doc_ids each give a row; an empty table none. The default catalogue is broadcast, so that nothing is shuffled; one
    that is given is hash-joined, of any size.
    """
    spark = docs.sparkSession
    canonical = canonical_text(canonical_lines(F.col("text")))
    notices = spark.createDataFrame(all_notices(), "id string, text string").select("id", canonical.alias("line")).distinct().select("id", F.sha2("line", 256).alias("d"), F.contains("line", F.lit("licens")).alias("said")).collect()
    by_digest = F.create_map(*(F.lit(x) for r in notices for x in (r["d"], r["id"])))
    lines = docs.select("doc_id", "text", canonical_lines(F.col("text")).alias("lines"))
    # a line without a word that all notices have is none
    may = F.split("lines", "\n")
    if all(r["said"] for r in notices):
        may = F.filter(may, lambda x: F.contains(x, F.lit("licens")))
    hit = F.array_intersect(F.transform(may, lambda x: F.sha2(F.trim(x), 256)), F.array(*(F.lit(r["d"]) for r in notices)))
    ids = F.array_sort(F.array_distinct(F.transform(hit, lambda d: by_digest[d])))
    noted = F.when(F.size(may) > 0, F.when(F.size(ids) > 0, F.array_join(ids, ",")))
    out = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical_text(F.col("lines")), 256).alias("text_digest"), F.sha2(body_text(F.col("text")), 256).alias("body_digest"), noted.alias("notice_ids"))
    known = (catalogue if catalogue is not None else default_catalogue(spark)).select("license_id", canonical.alias("whole"), body_text(F.col("text")).alias("body"))
    for text, digest, name in (("whole", "text_digest", "_whole_id"), ("body", "body_digest", "_body_id")):
        by = known.where(F.col(text) != "").groupBy(F.sha2(text, 256).alias(digest)).agg(F.min("license_id").alias(name))
        out = out.join(F.broadcast(by) if catalogue is None else by, digest, "left")
    return out.select("doc_id", "text_digest", F.coalesce("_whole_id", "_body_id").alias("license_id"), "notice_ids")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(lower(coalesce(text, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
    t = f"regexp_replace({t}, {quote(PUNCTUATION)}, ' ', 'g')"
    for one, other in SPELLINGS:
        t = f"replace({t}, {quote(one)}, {quote(other)})"
    whole = "sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g')))"
    return f"""
WITH licences AS (SELECT id, {t} AS lines FROM (VALUES {", ".join(f"({quote(k)}, {quote(v)})" for k, v in LICENCES.items())}) v(id, text)),
known AS (SELECT id AS license_id, {whole} AS text_digest FROM licences),
notices AS (SELECT DISTINCT id, {whole} AS d FROM (SELECT id, {t} AS lines FROM (VALUES {", ".join(f"({quote(k)}, {quote(v)})" for k, v in NOTICES)}) v(id, text))),
own AS (SELECT doc_id, row_number() OVER () AS r, {t} AS lines FROM documents),
hits AS (SELECT r, string_agg(DISTINCT id, ',' ORDER BY id) AS notice_ids FROM (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))))) AS d FROM own) JOIN notices USING (d) GROUP BY r)
SELECT doc_id, text_digest, license_id, notice_ids FROM (SELECT doc_id, r, {whole} AS text_digest FROM own) LEFT JOIN known USING (text_digest) LEFT JOIN hits USING (r)"""
