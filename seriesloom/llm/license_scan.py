"""License scans by canonical digests.

A text's canonical form has lower case, straight spelling variants (licence, sublicence, organisation, ...), no copyright lines, and single
spaces where punctuation and white space were. Its digest is joined to the digests of known licence texts and notices; two
texts match if and only if their whole canonical forms are equal. The same join finds documents that are a licence as a whole and,
over the digests of their lines, those that carry one as a line of its own. All of it is DataFrame functions.

The table of known digests has one row per entry of ``known_texts`` (or of the caller's table), and is broadcast only below ``BROADCAST_ROWS``.

Defined results: null counts as empty; a text without letters or digits matches nothing; repeated rows match alike; lines that repeat in a
document count once per licence; of licences with equal digests the first by name counts; very long texts are canonicalised whole, in
memory for a few times one text; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import text_of
from seriesloom.plans.scratch import Scratch

#: Spellings that count as equal, as (as found, as kept) after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("percent", "per cent"),
]

#: Known licence texts and notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]

#: Longer licences, one file each, named by their ids; read on the driver.
FOLDER = Path(__file__).parent / "licenses"
#: Headings that the short licences often have, and the line after which a licence's appendix may be left out.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"],
}
TERMS_END = "END OF TERMS AND CONDITIONS"
#: Known entries up to which their digests are broadcast.
BROADCAST_ROWS = 100_000
#: A copyright line, after any comment marks: "copyright" before a mark, a year, a blank to fill in or a capitalised name; "(c)" before a
#: year (else it may be an item of a list); ©; or nothing but "all rights reserved". Running text that wraps before "copyright notice" is none.
OWNED = r"(?m)^[^\p{L}\p{N}\n\r]*(?:" + "|".join([
    r"(?i:copyright)[ \t:,.-]*(?:(?i:\(c\)|&copy;)|©|[<\[{]|(?:19|20)\d\d)",
    r"[Cc]opyright[ \t:]+(?:by[ \t]+)?(?!(?i:holder|owner|notice|licen[sc]e|law|act|statement|interest|right|treaty|and|or|in|to|is|of|on|permission)s?\b)\p{Lu}",
    r"(?i:\(c\))[ \t]*(?:(?i:copyright)\b|(?:19|20)\d\d)", r"©", r"(?i:&copy;)", r"(?i:all rights reserved)(?![^\n\r]*[\p{L}\p{N}])",
]) + r")[^\n\r]*"
#: The same in the SQL, more coarsely; on the test tables both find the same lines.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n\r]*$"
MARKS = r"[^\p{L}\p{N}\n\r]+"


def respellings() -> list[tuple[str, str]]:
    """(pattern, spelling) for each kept spelling."""
    kept: dict[str, list[str]] = {}
    for found, keep in SPELLINGS:
        kept.setdefault(keep, []).append(found)
    return [(rf"\b(?:{'|'.join(found)})\b", keep) for keep, found in kept.items()]


def _any_spelling() -> str:
    """A pattern that finds a word of ``SPELLINGS`` behind a space or a line's end, by its first letter first."""
    rest: dict[str, list[str]] = {}
    for found, _ in SPELLINGS:
        rest.setdefault(found[0], []).append(found[1:])
    return r"[ \n](?:" + "|".join(f"{c}(?:{'|'.join(words)})" for c, words in sorted(rest.items())) + ")"


def canonical(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with __lines, the lines of ``text`` in which equal licences are equal strings, without blank ones and copyright lines, and
    __form, the whole canonical form, however the lines were wrapped.

    Each step is a column of its own, so no step is computed twice; only texts that hold another spelling are respelled.
    """
    plain = F.translate(F.lower(F.regexp_replace(text, OWNED, " ")), "\r", "\n")
    t = docs.withColumn("__t", F.concat(F.lit("\n"), F.regexp_replace(plain, MARKS, " ")))
    spelled = F.col("__t")
    for pattern, keep in respellings():
        spelled = F.regexp_replace(spelled, pattern, keep)
    t = t.withColumn("__t", F.when(F.col("__t").rlike(_any_spelling()), spelled).otherwise(F.col("__t")))
    t = t.withColumn("__lines", F.filter(F.transform(F.split("__t", "\n"), lambda x: F.trim(x)), lambda x: x != "")).drop("__t")
    t = t.withColumn("__form", F.array_join("__lines", " "))
    for found, keep in SPELLINGS:
        if " " in found:  # may have been cut by a line's end
            t = t.withColumn("__form", F.when(F.col("__form").contains(found), F.regexp_replace("__form", rf"\b{found}\b", keep)).otherwise(F.col("__form")))
    return t


def digest(form: Column) -> Column:
    """A canonical form's digest; null for nothing."""
    return F.nullif(F.sha2(form, 256), F.lit(hashlib.sha256(b"").hexdigest()))


def known_texts() -> list[tuple[str, str]]:
    """(license, text): ``KNOWN`` and the longer licences, with and without headings and appendices."""
    texts = KNOWN + [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    titled = [(name, f"{title}\n{text}") for name, text in texts if len(text) > 200 for title in TITLES.get(name, [])]
    cut = [(name, text.partition(TERMS_END)[0] + end) for name, text in texts if TERMS_END in text for end in ("", TERMS_END)]
    return texts + titled + cut


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of a table (license, text), by default the built-in one."""
    known = known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")
    whole = canonical(known.select("license", "text"), text_of()).select(digest(F.col("__form")).alias("digest"), "license")
    return whole.where("digest is not null and license is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_digest, license, line_licenses): the licence that the whole text is, and the sorted ones that single lines are."""
    known = scratch.keep(known)
    table = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    forms = canonical(docs.select("doc_id", "text"), text_of())
    # both kinds of form pass through the same join; one row a document is kept apart from the lines' hits
    lines = F.array_distinct(F.transform("__lines", digest))
    forms = scratch.keep(forms.select("doc_id", F.md5(text_of()).alias("key"), digest(F.col("__form")).alias("text_digest"), lines.alias("lines")))
    lines = forms.select("doc_id", "key", F.explode("lines").alias("digest")).join(table, "digest")
    hits = lines.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("license")).alias("line_licenses"))
    hits = hits.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "line_licenses")
    whole = forms.select("doc_id", "key", "text_digest").join(table.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    same = (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    return whole.join(hits, same, "left").select("doc_id", "text_digest", "license", "line_licenses")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; line_licenses is joined with commas, null without any."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, known_digests(spark), Scratch(spark, "op1")).withColumn("line_licenses", F.array_join("line_licenses", ","))


def _sql() -> str:
    spelled = "t"
    for pattern, keep in respellings():
        spelled = f"regexp_replace({spelled}, '{pattern}', '{keep}', 'g')"

    def lines(table: str, columns: str) -> str:
        return f"""
  SELECT {columns}, list_filter(list_transform(regexp_split_to_array(t, '[\n\r]+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM (
    SELECT {columns}, {spelled} AS t FROM (
      SELECT {columns}, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', ' ', 'g'), '{MARKS}', ' ', 'g') AS t FROM {table}))"""

    def known() -> str:
        quoted = lambda x: x.replace("'", "''")
        return ", ".join(f"('{name}', '{quoted(text)}')" for name, text in KNOWN)

    return f"""
WITH k AS (SELECT sha256(array_to_string(lines, ' ')) AS digest, min(license) AS license FROM ({lines(f"(VALUES {known()}) AS v(license, text)", "license")}) GROUP BY 1),
d AS ({lines("documents", "doc_id")}),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN k ON sha256(line) = digest GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS text_digest, license, line_licenses
FROM d LEFT JOIN k ON len(lines) > 0 AND sha256(array_to_string(lines, ' ')) = digest LEFT JOIN h ON d.doc_id = h.doc_id
"""


OP1_SQL = _sql()
