"""Licence texts and notices found by the digest of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmat.session import settle

#: Texts and notices of public licences, by SPDX identifier. Longer texts may be given as a table.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
]

#: Spellings that count as the same, in the order they are replaced, after lower-casing.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("https://", "http://"),
    ("creative commons attribution-noncommercial", "cc by-nc"),
    ("creative commons attribution", "cc by"),
]

#: A line that only names the owner of rights; what is neither a letter nor a digit.
COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©)[^\n]*$"
NOT_WORD = "[^a-z0-9]+"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines taken out, equivalent spellings made one, everything but a-z and 0-9 one space."""
    out = F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT_LINE}", " ")
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, digest) of known texts; a text listed twice counts once.

    Settled, so that Spark knows its size and can send a small table to all tasks.
    """
    frame = spark.createDataFrame(texts, "license string, body string")
    return settle(frame.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit, license, n_found: the licences that entire texts and entire lines of them are.

    The digest of each whole text (unit text) and of each of its lines (unit line) is joined to the known digests;
    parts of lines do not count. A null or empty text, and one of which only copyright lines are left, has no
    row. Rows with the same doc_id, null included, are counted together; other columns are left out. While the known
    digests are few, only what has matched is shuffled, and it is counted before.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select("doc_id", F.lit("text").alias("unit"), body.alias("body"))
    lines = docs.select("doc_id", F.lit("line").alias("unit"), F.explode(F.split(body, "\n")).alias("body"))
    units = whole.union(lines).where(F.col("body") != "").select("doc_id", "unit", digest(F.col("body")).alias("digest"))
    nothing = digest(F.lit(""))
    return (
        units.join(known.where(F.col("digest") != nothing), "digest")
        .groupBy("doc_id", "unit", "license")
        .agg(F.count(F.lit(1)).alias("n_found"))
    )


def scan_sql() -> str:
    """The same for DuckDB over the table documents."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted('(?m)' + COPYRIGHT_LINE)}, ' ', 'g')"
        for spelling, same in SPELLINGS:
            out = f"replace({out}, {quoted(spelling)}, {quoted(same)})"
        return f"trim(regexp_replace({out}, {quoted(NOT_WORD)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
        WITH known AS (
            SELECT form, min(license) AS license
            FROM (SELECT license, {form("body")} AS form FROM (VALUES {values}) AS k(license, body))
            WHERE form <> '' GROUP BY form
        ), units AS (
            SELECT doc_id, 'text' AS unit, {form("coalesce(text, '')")} AS form FROM documents
            UNION ALL
            SELECT doc_id, 'line', {form("body")}
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body FROM documents)
        )
        SELECT doc_id, unit, license, count(*) AS n_found
        FROM units JOIN known USING (form) GROUP BY doc_id, unit, license
    """
