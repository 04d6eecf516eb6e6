"""License scans: canonical texts are looked up among the digests of known licences.

A whole document, and each of its lines, is brought to one canonical form and hashed; the
digests are joined with those of the known texts. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch.llm.text import ascii_lower, stored

# Spellings that licence guidelines treat as equal, British form first.
SPELLINGS = [
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("centre", "center"),
    ("fulfil ", "fulfill "),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]

# Published licence texts and notices.
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2, BSD_3 = BSD_TERMS + BSD_DISCLAIMER, BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER
KNOWN = [
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "All rights reserved.\n\n" + BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "All rights reserved.\n\n" + BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]

# Digests of longer published texts, whole and in canonical form (``whole_digest``).
KNOWN_DIGESTS = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]

# Words that follow "copyright" in the prose of licences, where a statement has a year or a holder.
PROSE = (
    "notices?|holders?|owners?|licen[cs]es?|laws?|statements?|and|or|interests?|permissions?|disclaimers?|"
    "protection|treat(?:y|ies)|rights?|ownership|status|terms|infringements?|acts?|management|registration|"
    "information|is|are|in|on|to|of|for|under|as|that|which|with|applies"
)
#: A line that is a copyright statement. "(c)" alone may number a clause, so it needs a year.
STATEMENT = (
    r"(^|\n)[ \t]*(?:©|\(c\)[ \t]*(?:copyright|©)|\(c\)[^\n]*?(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
    r"|copyright[ \t]*(?:\(c\)|©|:|,?[ \t]*[0-9]{4})"
    rf"|copyright[ \t]+(?!(?:{PROSE})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}<\[{{])[^\n]*"
)

#: Known texts up to this many are broadcast (a digest and a short id each, under 10 MB).
BROADCAST_ROWS = 50_000


def canonical(text: Column) -> Column:
    """Lines of canonical words.

    Lines that are copyright statements go, but not lines of prose that a line break made begin
    with "copyright" (``STATEMENT``); A-Z become lower case; every run
    of other characters than letters, digits and line ends becomes a space; equivalent
    spellings become one. Null counts as empty.
    """
    out = ascii_lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, STATEMENT, r"$1")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for british, one in SPELLINGS:
        out = F.replace(out, F.lit(british), F.lit(one))
    return out


def whole_digest(canonical_text: Column) -> Column:
    out = F.regexp_replace(canonical_text, r"[ \n]+", " ")
    for british, one in SPELLINGS:
        if " " in british:  # may have been broken between two lines
            out = F.replace(out, F.lit(british), F.lit(one))
    return F.sha2(F.trim(out), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, license_text string")


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_DIGESTS, "license_id string, text_digest string")


def digests(licences: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``text_digest, license_id`` of known texts, and of ``more`` digests; of ids with equal texts the smallest stays."""
    text = whole_digest(canonical(F.col("license_text"))).alias("text_digest")
    rows = licences.where("license_text is not null").select(text, "license_id")
    if more is not None:
        rows = rows.union(more.select("text_digest", "license_id"))
    return rows.groupBy("text_digest").agg(F.min("license_id").alias("license_id"))


def scan(
    docs: DataFrame,
    licences: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    more: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, text_digest, license_id, notice_ids, n_notices``.

    ``license_id`` is that of the known text which the whole document equals in canonical
    form, else null. ``notice_ids`` are the ids of known texts that equal a line of it, sorted
    and joined by commas (null if none); ``n_notices`` counts those lines. Empty and null texts
    have the digest of the empty text. Repeated rows are each scanned; texts of any length are
    scanned whole; an empty table gives no rows. ``licences`` has known texts, ``more`` digests of others.
    """
    known = digests(licences, more)
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    empty = F.sha2(F.lit(""), 256)
    lines = known.select(F.unhex("text_digest").alias("line_digest"), F.col("license_id").alias("line_license"))
    canonical_rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canonical"))
    trimmed = F.transform(F.split("canonical", "\n", -1), lambda x: F.trim(x))
    # Texts are read and brought to canonical form once; what follows reads digests only.
    rows = stored(
        canonical_rows.select(
            "doc_id",
            whole_digest(F.col("canonical")).alias("text_digest"),
            F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.unhex(F.sha2(x, 256))).alias("line_digests"),
        ),
        "digests",
    )
    found = (
        rows.select("doc_id", "text_digest", F.explode("line_digests").alias("line_digest"))
        .join(lines, "line_digest")
        .where(F.col("line_digest") != F.unhex(empty))
    )
    # Copies and repeated rows share their notices: lines are counted once per row and text.
    notices = found.groupBy("doc_id", "text_digest").agg(
        F.array_join(F.sort_array(F.collect_set("line_license")), ",").alias("notice_ids"),
        F.count("*").alias("lines"),
    )
    copies = rows.groupBy("doc_id", "text_digest").agg(F.count("*").alias("copies"))
    notices = notices.join(
        copies, notices["doc_id"].eqNullSafe(copies["doc_id"]) & (notices["text_digest"] == copies["text_digest"])
    ).select(
        notices["doc_id"].alias("_id"),
        notices["text_digest"].alias("_digest"),
        "notice_ids",
        (F.col("lines") / F.col("copies")).cast("long").alias("n_notices"),
    )
    same = rows["doc_id"].eqNullSafe(notices["_id"]) & (rows["text_digest"] == notices["_digest"])
    return (
        rows.select("doc_id", "text_digest")
        .join(notices, same, "left")
        .join(known, "text_digest", "left")
        .select(
            "doc_id", "text_digest", "license_id", "notice_ids", F.coalesce("n_notices", F.lit(0)).alias("n_notices")
        )
    )
