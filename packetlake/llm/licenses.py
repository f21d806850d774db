"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and white space) and its SHA-256 is joined to the
digests of known licence texts and notices. Whole texts are looked up, and so
is each line, as documents carry notices among other lines. The known table is
a parameter with a fixed number of rows, so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm.common import whole_text

# Steps of the canonical form, as (pattern, replacement), applied
# in this order to the lower-cased text.
# A line is a copyright statement if the word or sign is followed by a sign, a
# year, a placeholder, "by" or "the". Terms that begin a line with the word, as
# they do when wrapped, are none.
COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n]*((copyright|©)[^a-z0-9<\[{\n]*(\(c\)|©|[0-9]{4}|[<\[{]|by |the )"
    r"|\(c\)[^a-z0-9<\[{\n]*([0-9]{4}|[<\[{])|©)[^\n]*"
)
CANONICAL_STEPS = (
    (COPYRIGHT_LINE, r"\1"),
    (r"all[^a-z0-9]+rights[^a-z0-9]+reserved\.?", " "),
    (r"https://", "http://"),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"acknowledgment", "acknowledgement"),
    (r"copyright[^a-z0-9]+owner", "copyright holder"),
    (r"whilst", "while"),
    (r"per[^a-z0-9]+cent", "percent"),
    (r"[^a-z0-9\n]+", " "),
)

# Public licence texts and one-line notices.
WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE."
)
WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n"
)
BSD_1 = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer.\n"
)
BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n"
)
BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.\n"
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted"
)
ISC_NOTICE = (
    ", provided that the above copyright notice and this permission notice appear in all copies.\n"
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions:\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n"
)
APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
    "in compliance with the License. You may obtain a copy of the License at\n"
    "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License."
)
ZLIB_TEXT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the "
    "authors be held liable for any damages arising from the use of this software.\nPermission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If "
    "you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and "
    "must not be misrepresented as being the original software.\n3. This notice may not be removed or "
    "altered from any source distribution."
)
WTFPL_TERMS = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND "
    "MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."
)
KNOWN_TEXTS = (
    ("MIT", MIT_GRANT + WARRANTY_MIT),
    ("MIT", "MIT License\n" + MIT_GRANT + WARRANTY_MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT_GRANT + WARRANTY_MIT),
    ("ISC", ISC_GRANT + ISC_NOTICE + WARRANTY_ISC),
    ("ISC", "ISC License\n" + ISC_GRANT + ISC_NOTICE + WARRANTY_ISC),
    ("0BSD", ISC_GRANT + ".\n" + WARRANTY_ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_1 + BSD_2 + WARRANTY_BSD),
    ("BSD-2-Clause", BSD_HEAD + "1. " + BSD_1 + "2. " + BSD_2 + WARRANTY_BSD),
    ("BSD-3-Clause", BSD_HEAD + BSD_1 + BSD_2 + BSD_3 + WARRANTY_BSD),
    ("BSD-3-Clause", BSD_HEAD + "1. " + BSD_1 + "2. " + BSD_2 + "3. " + BSD_3 + WARRANTY_BSD),
    ("Zlib", ZLIB_TEXT),
    ("WTFPL", WTFPL_TERMS),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
)
SPDX_IDS = (
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "MPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense",
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the table above and a tag line for each identifier."""
    return [*KNOWN_TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name in SPDX_IDS)]


def canonical_lines(text: Column) -> Column:
    """The lines of the canonical form, without empty ones."""
    out = F.lower(text)
    for pattern, replacement in CANONICAL_STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1"))
    return F.filter(
        F.transform(F.split(out, "\n", -1), lambda line: F.trim(line)), lambda line: line != ""
    )


def _digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license), one row per digest. Texts that become empty are left
    out, as every wordless text has that digest."""
    table = spark.createDataFrame(texts or known_texts(), "license string, text string")
    return (
        table.withColumn("form", F.array_join(canonical_lines(F.col("text")), " "))
        .where("form <> ''")
        .groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"))
    )


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices) for every row of ``docs``.

    ``digest`` is the canonical digest of the whole text and ``license`` the
    known licence it belongs to, null if none. ``n_notices`` counts the lines
    that are known notices, ``notices`` lists their licences, sorted and
    comma-joined, empty if none. A null text is an empty one, with the digest
    of the empty form and no licence. How lines are wrapped does not change the
    digest. Texts are of any length. Null ids and repeated rows stay; other
    columns are not looked at; an empty table gives none.
    """
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        canonical_lines(whole_text()).alias("lines"),
    )
    # The whole text first, then each line.
    forms = lines.select(
        "row", "doc_id",
        F.posexplode(F.concat(
            F.array(_digest(F.array_join("lines", " "))), F.transform("lines", _digest)
        )).alias("at", "digest"),
    )
    looked_up = forms.join(F.broadcast(known), "digest", "left").where(
        "at = 0 OR license IS NOT NULL"
    )
    whole = F.col("at") == 0
    notice = F.when(~whole, F.col("license"))
    return looked_up.groupBy("row").agg(
        F.max(F.when(whole, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.count(notice).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(notice)), ",").alias("notices"),
    ).drop("row")


def oracle_sql() -> str:
    """The scan as DuckDB SQL over the view ``documents``."""
    def form(text: str) -> str:
        out = f"lower({text})"
        for pattern, replacement in CANONICAL_STEPS:
            out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    quoted = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts()
    )
    return f"""
WITH known AS (SELECT sha256(array_to_string(f, ' ')) AS digest, min(license) AS license
  FROM (SELECT license, {form("text")} AS f FROM (VALUES {quoted}) t(license, text)) GROUP BY 1),
lines AS (SELECT row_number() OVER () AS row, doc_id, {form("coalesce(text, '')")} AS f FROM documents),
hits AS (SELECT l.row, k.license FROM (SELECT row, sha256(unnest(f)) AS digest FROM lines) l
  JOIN known k USING (digest)),
notices AS (SELECT row, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names
  FROM hits GROUP BY row),
whole AS (SELECT row, doc_id, sha256(coalesce(array_to_string(f, ' '), '')) AS digest FROM lines)
SELECT w.doc_id, w.digest, k.license, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (row)"""
