"""License scans by canonical digest.

A text is normalised (case, punctuation, title and copyright lines, equivalent spellings)
and the digest of the whole result is hash-joined with the digests of known licences. All
of it is DataFrame functions. Line breaks do not matter: a text that was wrapped anew, or
put in one line, has the same digest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Short lines that hold a copyright notice only, after lower-casing. Such a
# line names a year or has a sign; one that merely begins with the word is licence text.
NOTICE = (
    r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]{0,120}$"
    r"|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
# Titles over a licence text, in canonical words.
TITLES = (
    "the mit license mit", "the mit license", "mit license", "mit no attribution", "isc license isc", "isc license",
    "the isc license", "bsd zero clause license", "zero clause bsd", "bsd 2 clause license", "the 2 clause bsd license",
    "simplified bsd license", "bsd 3 clause license", "the 3 clause bsd license", "new bsd license", "modified bsd license",
    "bsd license", "the zlib license", "zlib license", "the unlicense", "unlicense", "postgresql license", "x11 license",
)
# Words of a notice between the title and the first words of a licence, at most.
NOTICE_WORDS = 60
# Characters that only separate words, and spellings taken as equal.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ©‐-―‘’“”•…]+"
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("programme", "program"),
    ("noninfringment", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https", "http"),
)

# Published licence texts, by their SPDX identifiers.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement is
hereby granted, provided that the above copyright notice and this paragraph and
the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR
DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST
PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF
THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND
THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT,
UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}


# The standard notices by which a file names its licence.
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of all known texts; numbered lists also without numbers."""
    texts = [*KNOWN.items(), *NOTICES.items()]
    plain = [(name, re.sub(r"(?m)^[0-9]\. ", "", text)) for name, text in texts]
    return texts + [pair for pair in plain if pair not in texts]


def _head() -> str:
    """Pattern of a title and a copyright notice before the first words of a licence.

    The first words are those of the known texts themselves, so nothing else is cut.
    """
    starts = sorted({" ".join(re.findall("[a-z0-9]+", text.lower())[:4]) for _, text in known_texts()})
    return f"^(?:(?:{'|'.join(TITLES)}) )?(?:(?:copyright|c) (?:[^ ]+ ){{0,{NOTICE_WORDS}}}?)?({'|'.join(starts)}) "


def canonical(text: Column) -> Column:
    """Words of the text in one spelling, a blank between, without title and notice.

    Equivalent spellings are replaced as whole words; blanks are doubled first so that
    neighbouring words never share one.
    """
    lowered = F.translate(text, UPPER, LOWER)
    plain = F.regexp_replace(F.regexp_replace(lowered, NOTICE, " "), BREAKS, "  ")
    out = F.concat(F.lit(" "), plain, F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.regexp_replace(F.trim(F.regexp_replace(out, " +", " ")), _head(), "$1 ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, n_words and license_id (null: no known licence) of every row.

    ``known`` (license_id, text) is a list kept by people, so its digests are few and
    broadcast; texts that fall on one digest get the smallest license_id. A null text
    has a null digest; a text without words matches nothing; repeated rows stay. Texts of
    any length are read whole, each pattern in one pass.
    """
    table = (
        known.select("license_id", canonical(F.col("text")).alias("_c"))
        .where("_c <> ''")
        .groupBy(F.sha2(F.col("_c").cast("binary"), 256).alias("digest"))
        .agg(F.min("license_id").alias("license_id"))
    )
    seen = docs.select(F.col("doc_id"), canonical(F.col("text")).alias("_c")).select(
        "doc_id",
        F.sha2(F.col("_c").cast("binary"), 256).alias("digest"),
        F.when(F.col("_c") == "", 0).otherwise(
            F.length("_c") - F.length(F.translate("_c", " ", "")) + 1
        ).cast("long").alias("n_words"),
    )
    return seen.join(F.broadcast(table), "digest", "left")


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def oracle() -> str:
    """The same scan in SQL (RE2 patterns, ``g`` for all places)."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    breaks = "".join(chr(int(x, 16)) for x in ("A0", "A9", "2018", "2019", "201C", "201D", "2022", "2026"))
    dashes = "".join(map(chr, range(0x2010, 0x2016)))
    c = f"translate(text, '{UPPER}', '{LOWER}')"
    c = f"regexp_replace({c}, {quoted(NOTICE)}, ' ', 'g')"
    c = f"regexp_replace({c}, {quoted('[' + chr(92) + 'x00-' + chr(92) + 'x2F' + chr(92) + 'x3A-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F' + breaks + dashes + ']+')}, '  ', 'g')"
    c = f"(' ' || {c} || ' ')"
    for other, usual in SPELLINGS:
        c = f"replace({c}, ' {other} ', ' {usual} ')"
    c = f"trim(regexp_replace({c}, ' +', ' ', 'g'), ' ')"
    c = f"regexp_replace({c}, {quoted(_head())}, '\\1 ')"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known_texts())
    return f"""
WITH known(license_id, text) AS (VALUES {values}),
k AS (SELECT sha256(c) AS digest, min(license_id) AS license_id
      FROM (SELECT license_id, {c} AS c FROM known) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, c, sha256(c) AS digest FROM (SELECT doc_id, {c} AS c FROM documents))
SELECT d.doc_id, d.digest, k.license_id,
       CAST(CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END AS BIGINT) AS n_words
FROM d LEFT JOIN k ON d.digest = k.digest"""
