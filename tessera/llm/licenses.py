"""Licence scan: canonical digests of entire texts and lines, looked up by a hash join.

A text is put into canonical form (lower case, lines that state a copyright
removed, equivalent spellings made one, everything but letters and digits taken
as one blank) and its SHA-256 is joined with the digests of known licence
texts and notices. What is compared is always the entire unit: the whole text
of a document (line 0), or one whole line (numbered from 1). The table of known
texts is fixed and small, so it is the broadcast side whatever the corpus size;
documents are not shuffled. DataFrame functions only.

Null texts count as empty; units that are empty in canonical form match
nothing. Ids may be null or repeat. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Equivalent spellings, applied in this order to lower-cased text. Fixed values.
SPELLINGS = [
    (r"https?://", "http "),
    (r"&", " and "),
    (r"licence", "license"),
    (r"sub[- ]licens", "sublicens"),
    (r"non[- ]commercial", "noncommercial"),
    (r"non[- ]infringement", "noninfringement"),
    (r"copyright holders?", "copyright owner"),
    (r"copyright owners", "copyright owner"),
    (r"merchantibility", "merchantability"),
    (r"per cent", "percent"),
]
#: A line that states a copyright: removed, whoever holds it.
COPYRIGHT = r"(?m)^[^a-z0-9©\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]*(?:copyright|[0-9]{4}|<year>|\[year\]|\[yyyy\])|©|all rights reserved)[^\n]*$"

#: Every text that a spelling or COPYRIGHT changes holds one of these.
SPELLING_ANCHORS = ("http", "&", "licence", "sub-licens", "sub licens", "non-commercial", "non commercial", "non-infringement", "non infringement", "copyright", "(c)", "©", "all rights reserved", "merchantibility", "per cent")
#: Every known text holds one of these words, in any spelling: lines without one need no digest.
KNOWN_ANCHORS = ("licens", "licenc", "redistribution", "software")

#: Known licence texts and notices. Fixed values.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
KNOWN = [
    ("MIT", _MIT),
    ("MIT", f"The MIT License\n\n{_MIT}"),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_TWO}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_TWO}\n{_BSD_THIRD}\n\n{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]


#: Digests of canonical whole texts that are too long to list. Fixed values.
KNOWN_DIGESTS = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "02a121bd244e30cfc02945b4ab6cd6889c41442a58d076deb3bd196c30c61806"),
    ("GFDL-1.3-only", "d2f6b83bca2ec722ccbe6ee61ccf9c409b4597182b2cbdfcbb086c74086abe33"),
    ("GPL-1.0-only", "596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa"),
    ("GPL-2.0-only", "632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec"),
    ("GPL-3.0-only", "6d9d9a5aef0ead5d961185bbca615afe9d91b49edf03203bfb54e5a71f07a03b"),
    ("LGPL-2.0-only", "87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283"),
    ("LGPL-2.1-only", "4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "8b43f0ebc3e4d95bf2763eca63bbd86458f43d516345591663b1186d2d11e18e"),
]


def _has(low: Column, anchors: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for a in anchors:
        out = out | low.contains(a)
    return out


def canonical(low: Column) -> Column:
    """Canonical form of lower-cased text. Only texts that hold what a spelling or the copyright rule starts from go through those."""
    out = F.regexp_replace(low, COPYRIGHT, " ")
    for pattern, plain in SPELLINGS:
        out = F.regexp_replace(out, pattern, plain)
    return F.trim(F.regexp_replace(F.when(_has(low, SPELLING_ANCHORS), out).otherwise(low), r"[^\p{L}\p{N}]+", " "))


def digest(low: Column) -> Column:
    form = canonical(low)
    return F.when(form != "", F.sha2(form, 256))


def digests(texts: DataFrame) -> DataFrame:
    """``known_digest, license_id`` of known texts (``license_id, text``)."""
    return texts.select("license_id", digest(F.lower("text")).alias("known_digest")).filter("known_digest IS NOT NULL").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def known(spark: SparkSession) -> DataFrame:
    """``known_digest, license_id``: of KNOWN and KNOWN_DIGESTS."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in KNOWN)))
    whole = F.explode(F.array(*(F.struct(F.lit(d).alias("known_digest"), F.lit(k).alias("license_id")) for k, d in KNOWN_DIGESTS)))
    return digests(spark.range(1).select(rows.alias("r")).select("r.*")).unionByName(spark.range(1).select(whole.alias("r")).select("r.*"))


def scan(docs: DataFrame, key: str = "doc_id", table_: DataFrame | None = None) -> DataFrame:
    """``doc_id, line, digest, license_id``, by the table of :func:`known` or one that :func:`digests` made of other texts (then every line gets a digest): a row for the whole text of every document (line 0, licence null if unknown), and one for each whole line that is a known text."""
    low = F.col("low")

    def anchored(x: Column) -> Column:
        return F.lit(True) if table_ is not None else _has(x, KNOWN_ANCHORS)

    rows = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit"))), lambda u: anchored(u["unit"]))
    none = F.array().cast("array<struct<line:int,unit:string>>")
    whole = F.array(F.struct(F.lit(0).alias("line"), low.alias("unit")))
    units = rows.select("doc_id", F.explode(F.concat(whole, F.when(anchored(low), lines).otherwise(none))).alias("u")).select("doc_id", "u.line", digest(F.col("u.unit")).alias("digest"))
    found = units.join(known(docs.sparkSession) if table_ is None else table_, F.col("digest") == F.col("known_digest"), "left")
    return found.filter((F.col("line") == 0) | F.col("license_id").isNotNull()).select("doc_id", "line", "digest", "license_id")


def op7_license_lookup(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g')"
    for pattern, plain in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{plain}', 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7_SQL = f"""
WITH k AS (
  SELECT sha256({_sql_form("t")}) AS d, min(id) AS license_id
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}) AS v(id, t) GROUP BY 1
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{i}')" for i, d in KNOWN_DIGESTS)}) AS w(d, license_id)),
u AS (
  SELECT doc_id, 0 AS line, coalesce(text, '') AS unit FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1))::INTEGER, unnest(l) FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
f AS (SELECT doc_id, line, {_sql_form("unit")} AS form FROM u),
d AS (SELECT doc_id, line, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM f)
SELECT doc_id, line, digest, license_id FROM d LEFT JOIN k ON digest = k.d WHERE line = 0 OR license_id IS NOT NULL
"""
