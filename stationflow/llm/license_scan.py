"""Licences by canonical digests.

A licence's text is brought to a canonical form: lower case, owners' copyright
lines left out, punctuation and white space made single blanks, equivalent spellings
made one. Its SHA-256 is its key. Documents are looked up whole and line by
line (notices are lines), in the same form, by a hash join of digests. A whole
text may be wrapped in any way, as lines are joined again before hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence texts use alike; the first becomes the second.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("https", "http"),
)

#: Words that follow "copyright" in licences' sentences, where an owner's notice has a year, a sign or a name.
SENTENCE_WORDS = (
    "notices?", "holders?", "owners?", "authors?", "licen[cs]es?", "laws?", "statements?", "permissions?", "protections?", "interests?", "rights?",
    "claims?", "disclaimers?", "information", "treaty", "treaties", "acts?", "infringement", "ownership", "materials?", "works?", "interfaces?",
    "and", "or", "patents?", "trademarks?", "on", "in", "of", "to", "is", "are", "for", "under", "as", "that", "which", "this",
)
OWNER = (
    r"^[^\p{L}\p{N}(]*(©|\(c\)|copyright(?:s|ed)?(?!\p{L})(?![^\p{L}\p{N}©(]*$)"
    r"(?![\s,/\-]+(?:" + "|".join(SENTENCE_WORDS) + r")(?![\p{L}\p{N}])(?!\s*[:©]|\s+\d)))"
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

_BSD = (
    "Copyright (c) year holder\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Licence texts and notices (the texts their owners publish).
LICENSES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "MIT",
        "MIT License\n\nCopyright (c) year holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in "
        'all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nCopyright year holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    ),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n\n" + _BSD_AS_IS,
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; blank lines and owners' notices left out."""
    lines = F.split(F.lower(text), "\r\n|[\n\r]")
    # "(c) 2020 someone" and "copyright someone" at a line's start name an owner; "copyright notice" is the licence's words.
    lines = F.filter(lines, lambda x: ~F.rlike(x, F.lit(OWNER)))

    def form(line: Column) -> Column:
        plain = F.concat(F.lit(" "), F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        for old, new in SPELLINGS:
            plain = F.replace(plain, F.lit(f" {old}"), F.lit(f" {new}"))
        return F.trim(F.regexp_replace(plain, " +", " "))

    return F.filter(F.transform(lines, form), lambda x: x != "")


def whole_form(lines: Column) -> Column:
    """The canonical form of a whole text; spellings of two words are also met where a line ends between them."""
    plain = F.concat(F.lit(" "), F.array_join(lines, " "))
    for old, new in SPELLINGS:
        if " " in old:
            plain = F.replace(plain, F.lit(f" {old}"), F.lit(f" {new}"))
    return F.trim(plain)


def registry(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """(digest, license, size) of the known texts, by the same form as documents'."""
    known = spark.createDataFrame(licenses, "license string, text string")
    whole = whole_form(canonical_lines(F.col("text")))
    return known.select("license", whole.alias("form")).groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("size"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """One row per document: the id, ``digest`` (of the whole canonical text),
    ``whole_license`` (the licence that it is, or NULL), ``n_notices`` (lines that are
    a known text) and ``licenses`` (the distinct ones found, by name, comma-joined).

    NULL and empty texts, and texts of copyright lines alone, have the digest of the
    empty text and no licence. A line that occurs several times counts each
    time. Repeated rows stay; ids may be NULL; an empty table gives no rows; other
    columns are left out. A very long text is read whole, a row for each of its lines.
    """
    known = registry(docs.sparkSession, licenses)
    names = sorted({name for name, _ in licenses})
    # The known texts are a fixed list.
    table = F.broadcast(known.select("digest", "license", F.array_position(F.array(*map(F.lit, names)), F.col("license")).alias("number")))
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    digests = F.transform("lines", lambda x: F.sha2(x, 256))
    rows = rows.select(id_col, "_row", F.sha2(whole_form(F.col("lines")), 256).alias("digest"), digests.alias("digests"))
    rows = rows.select(id_col, "_row", "digest", F.explode_outer("digests").alias("line"))
    rows = rows.join(table.select("digest", F.col("license").alias("whole_license")), "digest", "left")
    rows = rows.join(table.select(F.col("digest").alias("line"), "number"), "line", "left")
    # Found licences as bits, so that a document's lines are put together where they are read.
    words = range(-(-len(names) // 62))
    bit = F.when(F.col("number").isNotNull(), F.expr("shiftleft(1L, cast((number - 1) % 62 as int))"))
    of_word = [F.coalesce(F.bit_or(F.when(F.floor((F.col("number") - 1) / 62) == w, bit)), F.lit(0)).alias(f"w{w}") for w in words]
    found = rows.groupBy(id_col, "_row", "digest", "whole_license").agg(F.count("number").alias("n_notices"), *of_word)
    held = [
        F.when((F.col("whole_license") == name) | (F.shiftright(f"w{i // 62}", i % 62).bitwiseAND(F.lit(1)) == 1), F.lit(name)) for i, name in enumerate(names)
    ]
    return found.select(id_col, "digest", "whole_license", "n_notices", F.concat_ws(",", *held).alias("licenses"))


def oracle_sql(table: str = "documents", licenses: tuple[tuple[str, str], ...] = LICENSES) -> str:
    """DuckDB SQL for ``scan``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = "' ' || regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        form = f"replace({form}, ' {old}', ' {new}')"
    form = f"trim(regexp_replace({form}, ' +', ' ', 'g'))"
    # The other engine's patterns can't look ahead, so "this and not that" is two patterns, for a sign and for the word.
    blank, names = "^[^\\p{L}\\p{N}(]*", f"(?:{'|'.join(SENTENCE_WORDS)})"
    sign, word = "^[^\\p{L}\\p{N}(©]*(?:©|\\(c\\))", f"{blank}copyright(?:s|ed)?"
    owner = []
    for start, more in ((sign, ""), (word, "(?:[\\p{N}©(]|[^\\p{L}\\p{N}©(]+[\\p{L}\\p{N}©(])")):
        sentence = f"{start}[\\s,/\\-]+{names}"
        said = f"regexp_matches(x, '{sentence}(?:[^\\p{{L}}\\p{{N}}]|$)') AND NOT regexp_matches(x, '{sentence}(?:\\s*[:©]|\\s+\\d)')"
        owner.append(f"(regexp_matches(x, '{start}{more}') AND NOT ({said}))")
    lines = (
        "list_filter(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\r\n|[\n\r]'), "
        f"lambda x: NOT ({' OR '.join(owner)})), lambda x: {form}), lambda x: x <> '')"
    )
    whole = "' ' || coalesce(array_to_string(lines, ' '), '')"
    for old, new in SPELLINGS:
        if " " in old:
            whole = f"replace({whole}, ' {old}', ' {new}')"
    whole = f"sha256(trim({whole}))"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses)
    return f"""
WITH known_texts(license, text) AS (VALUES {values}),
known AS (SELECT {whole} AS digest, min(license) AS license
  FROM (SELECT license, {lines} AS lines FROM known_texts) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS lines FROM {table}),
whole AS (SELECT d.r, d.doc_id, {whole} AS digest FROM docs d),
found AS (SELECT l.r, k.license FROM (SELECT r, sha256(unnest(lines)) AS digest FROM docs) l JOIN known k USING (digest)),
per AS (SELECT r, count(*) AS n FROM found GROUP BY r),
named AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (
    SELECT r, license FROM found UNION SELECT w.r, k.license FROM whole w JOIN known k USING (digest)) GROUP BY r)
SELECT w.doc_id, w.digest, k.license AS whole_license, coalesce(p.n, 0)::BIGINT AS n_notices, coalesce(n.licenses, '') AS licenses
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN per p USING (r) LEFT JOIN named n USING (r)"""
