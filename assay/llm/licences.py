"""Licence scans: canonical texts looked up by digest among known licences.

A canonical text has no copyright lines, no title lines, no numbers or marks of list items, no
punctuation and no capitals, one space between words and one spelling of words that licences
spell in several ways, however its lines are broken. Its SHA-256 is
joined with the digests of the known texts: of the document as a whole, and of each of its
lines, which finds notices such as "Released under the MIT License." inside other text.

Everything is DataFrame functions; the known texts are few and broadcast by their size.

Cases: NULL, empty and wordless texts have no digest and match nothing, and so do those of titles
and copyright lines alone. Every row has a row of its own, with or without an id, repeated or not. Known texts
that are equal in canonical form are reported under all their names. Texts of any length are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings taken as equal, replaced in this order in lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("noncommercial", "non commercial"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https://", ""),
    ("http://", ""),
    ("www.", ""),
    ("&", " and "),
]
#: Fixed value: lines that name the holder of a copyright, in lower-case text.
COPYRIGHT_LINE = "^[ \t]*(copyright|[(]c[)]|©|all rights reserved)"
#: Fixed value: how lines begin that speak of copyright and name no holder.
ABOUT_COPYRIGHT = "^[ \t]*copyright[ \t]+(notice|holder|owner|interest|and|law|license|statement)"
#: Fixed value: the number or mark of a list item.
LIST_MARK = "^[ \t]*([0-9]{1,2}[.)]|[*-])[ \t]+"
#: Canonical lines that are a licence's title.
TITLES = [
    "mit license",
    "mit license mit",
    "the mit license",
    "the mit license mit",
    "expat license",
    "mit no attribution",
    "mit no attribution license",
    "isc license",
    "isc license isc",
    "the isc license",
    "bsd zero clause license",
    "zero clause bsd",
    "bsd 2 clause license",
    "bsd 2 clause simplified license",
    "the 2 clause bsd license",
    "simplified bsd license",
    "bsd 3 clause license",
    "bsd 3 clause new or revised license",
    "the 3 clause bsd license",
    "new bsd license",
    "zlib license",
    "the zlib license",
    "boost software license version 1 0",
    "boost software license version 1 0 august 17th 2003",
    "the unlicense",
    "unlicense",
]
_BSD_ITEMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Names and texts of known licences and notices.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        'permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_ITEMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_ITEMS + _BSD_THIRD + _BSD_DISCLAIMER),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from "
        "any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this "
        "entire statement, including the above license grant, this restriction and the following disclaimer, must be included "
        "in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language "
        'processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        'copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_line(line: Column) -> Column:
    """A line's canonical form; letters beyond ASCII part words like punctuation does."""
    lower = F.translate(line, _UPPER, _SMALL)
    out = F.regexp_replace(lower, LIST_MARK, "")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    holder = F.regexp_like(lower, F.lit(COPYRIGHT_LINE)) & ~F.regexp_like(lower, F.lit(ABOUT_COPYRIGHT))
    return F.when(holder | out.isin(TITLES), "").otherwise(out)


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines that have words; put together by spaces they are the text's."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda form: form != "")


def _sha(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def _whole(forms: Column) -> Column:
    return F.when(F.size(forms) > 0, _sha(F.array_join(forms, " ")))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence string, text string")


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` of the whole text, ``licence`` if the whole is a known text, ``notices`` of its lines.

    Names are sorted and joined by commas; no match is NULL.
    """
    forms = F.col("forms")
    names = known.select("licence", canonical_lines(F.col("text")).alias("forms")).select("licence", _whole(forms).alias("known"))
    names = names.filter("known IS NOT NULL").groupBy("known").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("name"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("forms"))
    # rows with the same id and lines have the same answer, which is given as often as there are such rows
    rows = rows.select("doc_id", _whole(forms).alias("digest"), _sha(F.array_join(forms, "\n")).alias("lines"), F.transform(forms, _sha).alias("blocks")).select(
        "doc_id", "digest", "lines", F.explode_outer(F.array_distinct(F.array_append("blocks", F.col("digest")))).alias("block")
    )
    found = rows.join(names, F.col("block") == F.col("known"), "left")
    is_whole = F.col("block") == F.col("digest")
    named = lambda values: F.nullif(F.array_join(F.array_sort(values), ","), F.lit(""))
    answers = found.groupBy("doc_id", "digest", "lines").agg(
        F.count_if(F.col("block").eqNullSafe(F.col("digest"))).alias("n"),
        named(F.collect_set(F.when(is_whole, F.col("name")))).alias("licence"),
        named(F.collect_set("name")).alias("notices"),
    )
    return answers.select("doc_id", "digest", "licence", "notices", F.explode(F.sequence(F.lit(1), "n")).alias("nth")).drop("nth")


def scan_sql() -> str:
    """The same over ``documents`` in DuckDB."""
    titles = ", ".join(f"'{title}'" for title in TITLES)

    def form(column: str) -> str:
        lower = f"translate({column}, '{_UPPER}', '{_SMALL}')"
        out = f"regexp_replace({lower}, '{LIST_MARK}', '')"
        for spelling, one in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{one}')"
        out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
        holder = f"regexp_matches({lower}, '{COPYRIGHT_LINE}') AND NOT regexp_matches({lower}, '{ABOUT_COPYRIGHT}')"
        return f"CASE WHEN ({holder}) OR {out} IN ({titles}) THEN '' ELSE {out} END"

    def whole(column: str) -> str:
        forms = f"list_filter(list_transform(string_split({column}, chr(10)), lambda x: {form('x')}), lambda x: x <> '')"
        return f"CASE WHEN len({forms}) > 0 THEN sha256(array_to_string({forms}, ' ')) END"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT licence, {whole("text")} AS known FROM (VALUES {values}) AS k(licence, text)),
names AS (SELECT known, string_agg(licence, ',' ORDER BY licence) AS name FROM known GROUP BY known),
whole AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, {whole("text")} AS digest FROM documents),
blocks AS (
    SELECT DISTINCT r, sha256({form("line")}) AS block
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM whole)
    UNION SELECT r, digest FROM whole
),
found AS (SELECT DISTINCT r, name FROM blocks JOIN names ON block = known),
notices AS (SELECT r, string_agg(name, ',' ORDER BY name) AS notices FROM found GROUP BY r)
SELECT w.doc_id, w.digest, names.name AS licence, n.notices
FROM whole w LEFT JOIN names ON w.digest = names.known LEFT JOIN notices n ON n.r = w.r
"""
