"""Licence scan by canonical digests.

A text is brought into a canonical form (case, punctuation, copyright lines and
equivalent spellings do not matter) and its SHA-256 digest is joined with the
digests of known licence texts. The units are whole texts and, for notices inside longer
documents, single lines, paragraphs and runs of paragraphs as whole texts of their own.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known notices and short licence texts, by identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
     "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
     "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# The whole texts in the folder licenses, by file name; titles that stand before texts without one, and clauses that other texts leave out.
TEXTS = Path(__file__).with_name("licenses")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "The MIT License:"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License", "BSD License", "The BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"), "Unlicense": ("The Unlicense", "Unlicense"),
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
FREE_SOFTWARE = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3}\n\n"
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {2} for more details.\n\nYou should have received a copy of the GNU {2} along with {4}{5}")
# Spellings that count as one, after case and punctuation are gone.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"), ("version", "v"), ("http", "https"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that only states a copyright, by a mark with a year or holder; wrapped licence lines begin with the word too.
_WORD, _MARK, _YEAR = r"(?:[Cc]opyright|COPYRIGHT)", r"(?:\([cC]\)|©)", r"(?:[\[<{(]?(?:(?:19|20)[0-9][0-9]|yyyy|YYYY|year|YEAR)\b)"
_OTHER = r"(?i:holders?|owners?|notices?|licen[cs]es?|laws?|acts?|and|or|statements?|interests?|rights?|treat(?:y|ies)|permissions?|infring[a-z]*|protection|in|to|of|on|for|is)\b"
COPYRIGHT_LINE = (
    rf"(^|\n)[ \t]*(?:[Pp]ortions )?(?:{_WORD}[ \t:,]*(?:{_MARK}|{_YEAR}|[Bb][Yy]\b|[\[<{{]|(?!{_OTHER})[A-Z])|{_MARK}[ \t:,]*(?:{_WORD}|{_YEAR})|©)[^\n]*"
    r"(?:\n[ \t]*[Aa]ll [Rr]ights [Rr]eserved\.?[ \t]*(?=\n|$))?")
# Fixed value: a comment mark at the beginning of a line.
COMMENT_MARK = r"(?m)^[ \t]*(?:/\*+|\*+/|\*{1,2}(?!\*)|//+[!/]*|#+|;+|--(?!-)|%+|<!--)"


def canonical(text: Column) -> Column:
    """The canonical form: words of a-z, 0-9 and non-ASCII characters, one space between."""
    out = F.translate(F.regexp_replace(text, COPYRIGHT_LINE, "$1"), UPPER, LOWER)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def uncommented(text: Column) -> Column:
    """The text with plain line breaks and without comment marks."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), COMMENT_MARK, "")


def _headers() -> list[tuple[str, str]]:
    """The notices that the GNU licences and the MPL ask for in each source file."""
    out = [("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at http://mozilla.org/MPL/2.0/.")]
    names = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))
    web = tuple(f". If not, see {a}https://www.gnu.org/licenses/{b}." for a, b in (("", ""), ("<", ">")))
    post = tuple(f"; if not, write to the Free Software Foundation, Inc., {a}" for a in (
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
        "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"))
    for short, name, versions in names:
        for version in versions:
            number = version if "." in version else f"{version}.0"
            for tail, which in (("or-later", f"either version {version} of the License, or (at your option) any later version."), ("only", f"version {version} of the License.")):
                for what, it in (("This program", "this program"), ("This library", "this library"), ("This file", "this file")):
                    for end in web + post:
                        for link in (", ", "; "):
                            out.append((f"{short}-{number}-{tail}", FREE_SOFTWARE.format(what, ":", name, link + which, it, end)))
    return out


def license_table() -> list[tuple[str, str]]:
    """(license, body): KNOWN, the whole texts with and without title and what follows their terms, and the notices for source files."""
    out = [*KNOWN, *_headers()]
    texts = {f.stem: f.read_text() for f in sorted(TEXTS.glob("*.txt"))}
    third = re.compile(r"\* Neither the name.*?\n\n", re.S)
    texts["BSD-2-Clause"] = third.sub("", texts["BSD-3-Clause"])
    for name, text in texts.items():
        license = name.removesuffix("-UC")
        forms = [text]
        if license.startswith("BSD"):
            numbers = iter("123")
            forms += [re.sub(r"(?m)^\* ", lambda _: f"{next(numbers)}. ", text)]
            forms += [x.replace(" HOLDER OR", " OWNER OR") for x in forms] + [x.replace(" HOLDER OR", " HOLDERS OR") for x in forms]
            forms += [x.replace("the copyright holder nor", "the copyright holders nor") for x in forms]
        if END_OF_TERMS in text:
            before = text.partition(END_OF_TERMS)[0]
            forms += [before, before + END_OF_TERMS]
        if license in TITLES:
            forms += [f"{title}\n\n{form}" for title in TITLES[license] for form in forms]
        else:  # the first paragraph is the title
            forms += [form.strip().partition("\n\n")[2] for form in forms]
        out += [(license, form) for form in dict.fromkeys(forms)]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(license_table(), "license string, body string")


def _runs(text: Column, known: DataFrame) -> Column:
    """Canonical forms of the runs of two or more paragraphs that begin with the first word of a known text and are as long."""
    forms = known.select(F.split("form", " ").alias("w")).select(F.col("w")[0].alias("first"), F.size("w").alias("n"))
    sizes = {r["first"]: sorted(r["sizes"]) for r in forms.groupBy("first").agg(F.collect_set("n").alias("sizes")).collect()}  # a few numbers for each known text
    none = F.array().cast("array<string>")
    if not sizes:
        return none
    lengths = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in sizes.items() for x in pair))
    paragraphs = F.filter(F.transform(F.split(text, "\n[ \t]*\n"), canonical), lambda p: p != "")
    ends = F.aggregate(paragraphs, F.array(F.lit(0)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.size(F.split(p, " ")))))

    def found(row: Column) -> Column:
        words, at = F.split(F.array_join(row["paragraphs"], " "), " "), row["ends"]
        # a run that begins at paragraph i (from 0 on) ends behind paragraph i + 1 or later
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 2), lambda i: F.transform(
            F.filter(F.coalesce(F.try_element_at(lengths, F.get(words, F.get(at, i - 1))), F.array().cast("array<int>")),
                     lambda n: F.array_contains(F.slice(at, i + 2, F.size(at)), F.get(at, i - 1) + n)),
            lambda n: F.array_join(F.slice(words, F.get(at, i - 1) + 1, n), " "))))

    rows = F.filter(F.array(F.struct(paragraphs.alias("paragraphs"), ends.alias("ends"))), lambda row: F.size(row["ends"]) > 2)
    return F.when(F.rlike(text, F.lit("\n[ \t]*\n")), F.flatten(F.transform(rows, found))).otherwise(none)


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``id_col``, text_sha256, license, n_notices, notices.

    text_sha256 is the digest of the canonical whole text; license is the known
    licence with that digest, or null. n_notices counts the lines and paragraphs
    (runs of non-blank lines, where longer than one line) that are, canonically, a
    whole known text; notices holds their identifiers, distinct, sorted,
    comma-joined. ``known`` has license and body; of equal canonical bodies the
    smallest identifier counts, a null or wordless body matches nothing.

    A null text is empty and matches nothing; repeated rows are scanned one by one;
    a null identifier stays null; an empty table gives no rows; other columns are ignored.
    """
    forms = known.select("license", canonical(uncommented(F.col("body"))).alias("form")).filter("form <> ''")
    digests = (
        forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))
    )
    text = uncommented(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    lines, paragraphs = F.split("text", "\n"), F.filter(F.split("text", "\n[ \t]*\n"), lambda p: F.contains(p, F.lit("\n")))
    plain = F.transform(F.concat(F.array("text"), lines, paragraphs), lambda u: F.struct(u.alias("text"), F.lit(False).alias("done")))
    units = F.concat(plain, F.transform(_runs(F.col("text"), forms), lambda u: F.struct(u.alias("text"), F.lit(True).alias("done"))))
    one = rows.select("id", "row", F.posexplode(units).alias("place", "unit")).select(
        "id", "row", "place", F.sha2(F.when(F.col("unit.done"), F.col("unit.text")).otherwise(canonical(F.col("unit.text"))), 256).alias("digest"))
    hit = one.join(digests, "digest", "left")
    return hit.groupBy("id", "row").agg(
        F.max(F.when(F.col("place") == 0, F.col("digest"))).alias("text_sha256"),
        F.max(F.when(F.col("place") == 0, F.col("license"))).alias("license"),
        F.count(F.when(F.col("place") > 0, F.col("license"))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("place") > 0, F.col("license")))), ",").alias("notices"),
    ).select(F.col("id").alias(id_col), "text_sha256", "license", "n_notices", "notices")
