"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to canonical form (case, copyright lines, comment marks, punctuation and white space, then equivalent
spellings of whole words, also across line breaks), hashed, and joined to the digests of known licence texts: the whole
text, and each of its lines as a text of its own, which finds one-line notices. Both sides go through the same
expressions. Nothing is shuffled while the table of known texts is small enough to broadcast; its rows are counted first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .staging import staged

BROADCAST_ROWS = 4_096

# Spellings to be treated as equal, after the matching guidelines of SPDX.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("modernise", "modernize"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

# Public licence texts and notices.
MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = (
    ("MIT", MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", BSD_2),
    ("Zlib", ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    # Ids of the SPDX list, for the line that names one.
    *((i, f"SPDX-License-Identifier: {i}") for i in (
        "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "Unlicense", "BSL-1.0", "MPL-1.1", "MPL-2.0", "EPL-2.0",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    )),
)
# Digests of the canonical forms of whole public licence texts, and the lengths of these forms.
KNOWN_DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", 9887),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2-only", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", 19578),
    ("GFDL-1.3-only", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", 22013),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", 22447),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 14341),
)


def _spellings() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Single words and phrases to replace, punctuation as spaces."""
    pairs = list(dict((re.sub(r"[^a-z0-9]+", " ", old), new) for old, new in SPELLINGS).items())
    return [p for p in pairs if " " not in p[0]], [p for p in pairs if " " in p[0]]


def _respelled(x: Column, pairs: list[tuple[str, str]], gap: str) -> Column:
    """x with words replaced, and their plurals; words have a space of their own on each side. Texts that hold a word
    nowhere are scanned once for it: that is most of them, and a scan for a letter is faster than one for a space."""
    def swapped(old: str, new: str):
        both = lambda c: F.replace(F.replace(c, F.lit(f" {old} "), F.lit(f" {new} ")), F.lit(f" {old}s "), F.lit(f" {new}s "))
        return lambda c: F.when(F.contains(c, F.lit(old)), both(c)).otherwise(c)

    for old, new in pairs:
        x = let(x, swapped(old.replace(" ", gap), new.replace(" ", gap)))
    return x


def _canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, each as a text of its own; lines that only state copyright are empty."""
    x = F.lower(F.coalesce(text, F.lit("")))
    # lines that only state copyright, with their comment marks
    x = F.regexp_replace(x, r"(?m)^[^\p{L}\p{N}\n©]*(?:(?:copyright|\(c\)|©)\s*(?:\(c\)|©|\d{4}|by\b|<|\[)[^\n]*|all rights reserved\.?[ \t]*)$", " ")
    # white space first, so that words are words; two spaces between, so that neighbours don't share one
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    words, phrases = _spellings()
    x = _respelled(_respelled(x, words, " "), phrases, "  ")
    return F.transform(F.split(F.regexp_replace(x, " +", " "), "\n"), lambda c: F.btrim(c, F.lit(" ")))


def _canonical_whole(lines: Column) -> Column:
    """The canonical form of a text from that of its lines: phrases may span lines."""
    x = F.concat(F.lit(" "), F.array_join(F.filter(lines, lambda c: c != ""), " "), F.lit(" "))
    phrases = _spellings()[1]
    # neighbours share a space: every other one goes the first time
    return F.btrim(_respelled(_respelled(x, phrases, " "), phrases, " "), F.lit(" "))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    return _canonical_whole(_canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, text) of the built-in table, without Python rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known])
    return spark.range(1).select(F.inline(rows))


def license_folder(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, text) of a folder of licence texts, one a file, named by their ids (with or without .txt or .md)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.(?:txt|md)$", "")
    return files.select(name.alias("license_id"), F.col("value").alias("text"))


def license_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, size): one row for each digest; of licences with equal texts, the first by id. Texts that
    are null or empty in canonical form are left out."""
    rows = known.select("license_id", canonical(F.col("text")).alias("c")).where("c <> '' AND license_id IS NOT NULL")
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("c")).alias("size"))


def built_in(spark: SparkSession) -> DataFrame:
    """(digest, license_id, size) of all licences that are known without a folder: texts, notices, and digests."""
    more = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id"), F.lit(n).alias("size")) for i, d, n in KNOWN_DIGESTS])
    return license_digests(known_licenses(spark)).unionByName(spark.range(1).select(F.inline(more)))


def license_matches(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each row: doc_id, digest (of the canonical text), license_id (of the whole text, or null), line_licenses
    (sorted ids of known texts that stand on a line of their own).

    known: (license_id, text), by default the built-in table; license_folder() reads more. Null and empty texts have the
    digest of an empty text and match nothing. Repeated rows and null doc_ids stay; other columns are ignored. With an
    empty table of known texts nothing matches.
    """
    known = staged(built_in(docs.sparkSession) if known is None else license_digests(known), "licenses")
    lines = docs.select("doc_id", _canonical_lines(F.col("text")).alias("_lines"))
    rows = lines.select("doc_id", F.sha2(_canonical_whole(F.col("_lines")), 256).alias("digest"), "_lines")
    if known.count() > BROADCAST_ROWS:
        return _by_shuffled_joins(rows, known)
    whole = rows.join(F.broadcast(known.select("digest", "license_id")), "digest", "left")
    # lines of a length that no known text has need no digest
    pairs = known.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"), F.collect_set("size").alias("_sizes"))
    some = F.filter("_lines", lambda c: F.array_contains("_sizes", F.length(c)))
    found = F.transform(some, lambda c: F.try_element_at("_known", F.sha2(c, 256)))
    return whole.crossJoin(F.broadcast(pairs)).select("doc_id", "digest", "license_id", F.sort_array(F.array_distinct(F.array_compact(found))).alias("line_licenses"))


def _by_shuffled_joins(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same for a table that can't be broadcast. Rows are numbered in a written table, digests in place of texts."""
    lines = F.transform(F.array_distinct(F.filter("_lines", lambda c: c != "")), lambda c: F.unhex(F.sha2(c, 256)))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "digest", lines.alias("_lines")), "digests")
    table = known.select("digest", "license_id")
    each = rows.select("_row", F.explode("_lines").alias("_line")).select("_row", F.lower(F.hex("_line")).alias("digest"))
    ids = each.join(table, "digest").groupBy("_row").agg(F.sort_array(F.collect_set("license_id")).alias("line_licenses"))
    out = rows.join(table, "digest", "left").join(ids, "_row", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
