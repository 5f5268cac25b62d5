"""Licence scans by canonical digest lookup, in built-in expressions only.

A unit of text is the whole text, each of its paragraphs of several lines, and each of its lines. A unit is brought to a
canonical form: lower case, copyright notices away, `https` as `http`, letters and digits only with single spaces between, and equivalent
spellings as one. A notice is a line with the word or sign and a year or a placeholder; other lines are part of the terms. A second form keeps
the notices, so that a published text is found also where its lines are broken anew and a notice shares one with the terms. The digest of the canonical unit, in either form, is looked up among those of known licence texts and notices by a hash join; the
known ones are a fixed list in this module and the complete texts in the folder `licenses`, so it is small enough to be broadcast whatever the corpus.

Defined cases: NULL and empty texts have no match, nor have NULL or empty known texts. A text that is one line is no line besides. A
unit that occurs several times matches each time. Repeated rows give their matches each; NULL ids are kept. An empty table
gives no rows. Further columns are ignored.
"""

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import text_of

#: Spellings that the SPDX matching guidelines call equivalent, in canonical form: (form found, form kept).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Titles that licences without one in their text are given.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense"],
}


def published_forms(name: str, text: str) -> list[str]:
    """A complete text as it is handed on: in lines as published or a paragraph a line, with clauses numbered or not, up to the end of the
    terms or with what follows, and with a title and a reservation of rights where these are usual."""
    ends = [m.end() for m in re.finditer(r"END OF TERMS AND CONDITIONS", text)]
    out = [text, *[text[:end] for end in ends]]
    out += [re.sub(r"(?m)^[ \t]*\d\.[ \t]+", "", t) for t in out] if name.startswith(("BSD", "Zlib")) else []
    out += ["\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t\f]*\n", t)) for t in out]
    out += [f"All rights reserved.\n\n{t}" for t in out] if name.startswith("BSD") else []
    return [*out, *[f"{title}\n\n{t}" for title in TITLES.get(name, []) for t in out]]


#: Complete texts: the name up to a first `.txt`, `.spdx.txt` (as SPDX words it) or `.regents.txt` is the licence.
COMPLETE = [
    (name, form)
    for path in sorted(Path(__file__).with_name("licenses").glob("*.txt"))
    for name in [re.sub(r"(\.spdx|\.regents)?\.txt$", "", path.name)]
    for form in published_forms(name, path.read_text(encoding="utf-8"))
]

#: Licence texts and notices as published: (licence, text).
KNOWN = [
    ("MIT", "MIT License\n\n" + _GRANT + _AS_IS),
    ("MIT", _GRANT + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\n\n" + _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("ISC", _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _PERMIT + ".\n\n" + _ISC_AS_IS),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    *[(name, f"SPDX-License-Identifier: {name}{which}") for name in ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("-only", "-or-later")],
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("Zlib", "MPL-1.1", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")],
    *[("MIT", form) for form in published_forms("MIT", _GRANT + _AS_IS)],
    *COMPLETE,
]

#: A line that is a notice: the word or sign with a year or a placeholder for it, or the word with the sign. List items "(c)" and lines of
#: the terms that begin with the word are none.
NOTICE = r"(?:^|\n)[ \t]*(?:copyright[ \t]*(?:\(c\)|©)|(?:copyright|\(c\)|©)[ \t:,]*(?:19[0-9][0-9]|20[0-9][0-9]|<year>|\[year\]|<yyyy>|\[yyyy\]|yyyy))[^\n]*"


def without_notices(lower: Column) -> Column:
    return F.regexp_replace(lower, NOTICE, "\n")


def plain(lower: Column) -> Column:
    """The canonical form of a unit of lower-case text, but for notices and spellings."""
    return F.trim(F.regexp_replace(F.replace(lower, F.lit("https"), F.lit("http")), "[^a-z0-9]+", " "))


def with_forms(rows: DataFrame) -> DataFrame:
    """Adds `form`, without notices, and `whole`, with them, of the column `text`. The second differs only where there are notices."""
    low = rows.withColumn("_low", F.lower("text"))
    bare = low.withColumn("_bare", without_notices(F.col("_low"))).withColumn("form", plain(F.col("_bare")))
    whole = F.when(F.col("_bare") == F.col("_low"), F.col("form")).otherwise(plain(F.col("_low")))
    return bare.withColumn("whole", whole).drop("_low", "_bare")


def spelled(form: Column) -> Column:
    """Equivalent spellings as one. A fold over the list, since nested replacements make expressions that take long to compile."""
    pairs = F.array(*[F.struct(F.lit(rf"\b{found}\b").alias("found"), F.lit(kept).alias("kept")) for found, kept in SPELLINGS])
    return F.aggregate(pairs, form, lambda text, pair: F.regexp_replace(text, pair["found"], pair["kept"]))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licenses, first) of the known texts in both forms, through the same expressions as the units; `first` is the first word."""
    rows = with_forms(spark.createDataFrame([k for k in known if k[1]], "license string, text string"))
    forms = rows.select("license", F.explode(F.array("form", "whole")).alias("form")).where("form <> ''").withColumn("form", spelled(F.col("form")))
    first = F.substring_index("form", " ", 1).alias("first")
    return forms.groupBy(F.sha2("form", 256).alias("digest"), first).agg(F.array_sort(F.collect_set("license")).alias("licenses"))


def first_words(digests: DataFrame) -> list[str]:
    """What a unit that is a known text can begin with, before spellings are made one."""
    words = {r["first"] for r in digests.select("first").distinct().collect()}  # of the fixed list
    return sorted(words | {found.split(" ")[0] for found, kept in SPELLINGS if kept.split(" ")[0] in words})


def units(text: Column) -> Column:
    """Array of (unit, position, text) of a text."""
    lines, paragraphs = F.split(text, "\n"), F.split(text, "\n[ \\t]*\n")
    named = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("position"), x.alias("text"))
    none = F.array().cast("array<struct<unit:string,position:int,text:string>>")
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("position"), text.alias("text")))
    several = F.filter(F.transform(paragraphs, named("paragraph")), lambda p: F.contains(p["text"], F.lit("\n")))
    return F.concat(
        whole,
        F.when(F.size(paragraphs) > 1, several).otherwise(none),
        F.when(F.size(lines) > 1, F.transform(lines, named("line"))).otherwise(none),
    )


def license_matches(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, unit, position, license) of every unit that is a known licence text or notice."""
    digests = known_digests(docs.sparkSession, known)
    words = first_words(digests)
    found = with_forms(docs.select(F.col(f"`{id_column}`").alias("_id"), F.inline(units(text_of(text_column)))))
    # Spellings are costly, and only a unit that begins like a known text can be one.
    begins = lambda c: F.substring_index(c, " ", 1).isin(words)
    begun = found.where(begins("form") | begins("whole")).select("_id", "unit", "position", "form", "whole")
    # The known list is part of the code: a bounded broadcast.
    for form in ("form", "whole"):
        table = digests.select(F.col("digest").alias(f"_{form}"), F.col("licenses").alias(f"_by_{form}"))
        begun = begun.withColumn(f"_{form}", F.sha2(spelled(F.col(form)), 256)).join(F.broadcast(table), f"_{form}", "left")
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("_by_form", none), F.coalesce("_by_whole", none))
    return begun.select(F.col("_id").alias(id_column), "unit", "position", F.explode(both).alias("license"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LINE = r"^[ \t]*((copyright|\(c\)|©)[ \t:,]*((19|20)[0-9]{2}|[<\[]?yyyy|[<\[]year[>\]])|copyright[ \t]*(\(c\)|©))"


def _canonical_sql(column: str, notices: bool) -> str:
    """Line by line, where the main path replaces in the whole text."""
    form = f"lower({column})"
    if not notices:
        form = f"array_to_string([x FOR x IN string_split({form}, chr(10)) IF NOT regexp_matches(x, {_text(_LINE)})], chr(10))"
    form = f"trim(regexp_replace(replace({form}, 'https', 'http'), '[^a-z0-9]+', ' ', 'g'))"
    for found, kept in SPELLINGS:
        form = rf"regexp_replace({form}, '\b{found}\b', '{kept}', 'g')"
    return form


ORACLE_SQL = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), lines AS (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS u, unnest(range(len(string_split(t, chr(10))))) AS p, len(string_split(t, chr(10))) AS n FROM texts
), paragraphs AS (
    SELECT doc_id, unnest(regexp_split_to_array(t, '\\n[ \\t]*\\n')) AS u, unnest(range(len(regexp_split_to_array(t, '\\n[ \\t]*\\n')))) AS p,
           len(regexp_split_to_array(t, '\\n[ \\t]*\\n')) AS n FROM texts
), units AS (
    SELECT doc_id, 'text' AS unit, 0 AS position, t AS u FROM texts
    UNION ALL SELECT doc_id, 'paragraph', p, u FROM paragraphs WHERE n > 1 AND contains(u, chr(10))
    UNION ALL SELECT doc_id, 'line', p, u FROM lines WHERE n > 1
), known AS (
    SELECT license, unnest([{_canonical_sql("t", False)}, {_canonical_sql("t", True)}]) AS form
    FROM (VALUES {", ".join(f"({_text(n)}, {_text(t)})" for n, t in KNOWN)}) AS v(license, t)
), known_forms AS (
    SELECT DISTINCT license, form FROM known
), unit_forms AS (
    SELECT row_number() OVER () AS r, *, [{_canonical_sql("u", False)}, {_canonical_sql("u", True)}] AS forms FROM units
), found AS (
    SELECT DISTINCT r, license FROM (SELECT r, unnest(forms) AS form FROM unit_forms) JOIN known_forms USING (form) WHERE form <> ''
)
SELECT doc_id, unit, CAST(position AS INTEGER) AS position, license FROM unit_forms JOIN found USING (r)
"""
