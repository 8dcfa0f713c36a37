"""Licence scans: canonical texts are hashed and looked up among the digests of known licences.

A text is made canonical by lower-casing, dropping copyright lines, turning everything but letters and digits into
single blanks and unifying equivalent spellings. The whole text is looked up, and so is each of its lines, which finds
one-line notices. The known table is a small parameter; it is broadcast while its measured size allows. ``KNOWN`` holds the
published texts (``licence_texts``), the usual forms of MIT, ISC and BSD, and notices made of an opening and a licence's name.

Null and empty texts, and texts of copyright lines alone, have an empty canonical text, which matches nothing. A known
text that is empty is ignored; equal known texts under several names give the least name. Repeated rows are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe.llm.common import broadcast_if_small

#: Spellings that count as equal, in canonical form.
SPELLINGS = (
    (" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" sub license ", " sublicense "),
    (" sub licence ", " sublicense "), (" sublicence ", " sublicense "), (" non commercial ", " noncommercial "),
    (" organisation ", " organization "), (" fulfil ", " fulfill "), (" merchantability ", " merchantability "),
    (" copyright owner ", " copyright holder "), (" https ", " http "), (" per cent ", " percent "), (" c copyright ", " copyright "),
)
#: Letters of a line that are compared before it is hashed.
START = 8
#: A line that begins like this names a holder, not a term.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\s*(?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{terms}

THIS SOFTWARE IS PROVIDED BY THE {holders} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: The texts that their publishers name by version, one file each.
_FILES = (
    "Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense",
)
#: The instructions after the terms, which many copies leave out, begin like this.
_INSTRUCTIONS = r"(?m)^[ \t]*(?:APPENDIX: How to apply|Appendix: How to Apply|How to Apply These Terms|ADDENDUM: How to use)"
#: The addresses under which the GNU texts of before 2007 were issued.
_ADDRESS = r"51 Franklin (?:Street|St), Fifth Floor, Boston,? MA\s+02110-1301\s+USA"
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA", "<https://fsf.org/>",
)
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License", "GFDL": "GNU Free Documentation License"}
#: Names by which notices call the licences.
_NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License"), "ISC": ("ISC License", "ISC"), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache-2.0"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Artistic-1.0-Perl": ("Artistic License", "Artistic License 1.0"), "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0", "CC0"),
    **{f"{short}-{v}": tuple(x for n in (v.removesuffix(".0"), v) for x in (f"{_GNU[short]}, version {n}", f"{_GNU[short]} version {n}", f"{_GNU[short]} v{n}", f"{short} v{n}", f"{short}-{n}", f"{short} version {n}"))
       for short, v in (("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"), ("GFDL", "1.2"), ("GFDL", "1.3"))},
    **{f"CC-{short}-{v}": (f"CC {short} {v}", f"Creative Commons {full} {v} {of} License", f"Creative Commons {full} {v} {of}", f"Creative Commons {full} {v} License", f"Creative Commons {full} {v}")
       for short, full in _CC.items() for v, of in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))},
}
#: What stands before the name in a notice; "the", "a" or nothing comes between.
_OPENINGS = (
    "Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This work is released under",
    "This project is licensed under", "This project is released under", "This software is licensed under", "This software is released under",
    "This software is distributed under", "This program is licensed under", "This code is licensed under", "This file is licensed under",
    "This document is licensed under", "Licensed under the terms of", "Released under the terms of", "Distributed under the terms of", "License:", "SPDX-License-Identifier:",
)
_FREE = "This {thing} is free software; you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


def _files() -> Iterator[tuple[str, str]]:
    """Every file's text with and without its instructions, the copyright line filled in, and the GNU texts under each address."""
    for name in _FILES:
        text = files("transitframe.llm").joinpath("licence_texts", f"{name}.txt").read_text("utf-8")
        forms = [text, re.split(_INSTRUCTIONS, text)[0], re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text)]
        if name == "MPL-2.0":
            forms.append(re.split(r"(?m)^Exhibit A - ", text)[0])
        if re.search(_ADDRESS, text):
            forms += [re.sub(_ADDRESS, address, form) for form in forms for address in _ADDRESSES]
        for form in dict.fromkeys(forms):
            # an item "(c)" at the start of a line counts as a copyright line, so the forms differ
            yield from ((name, x) for x in (form, "\n\n".join(" ".join(p.split()) for p in form.split("\n\n")), " ".join(form.split())))


def _bsd() -> Iterator[tuple[str, str]]:
    titles = {2: ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), 3: ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License")}
    for clauses in (2, 3):
        for name in ("copyright holder", "copyright holders", "author", "University", "<organization>")[: 1 if clauses == 2 else None]:
            for holders, holder in (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("AUTHOR", "AUTHOR"), ("REGENTS", "REGENTS")):
                for mark in ("{}. ", "({}) ", "* "):
                    terms = "\n".join(mark.format(i + 1) + t.format(name=name) for i, t in enumerate(_BSD_TERMS[:clauses]))
                    text = _BSD.format(terms=terms, holders=holders, holder=holder)
                    yield from ((f"BSD-{clauses}-Clause", title + text) for title in ("", *(f"{t}\n\n" for t in (*titles[clauses], "BSD License"))))


def _notices() -> Iterator[tuple[str, str]]:
    for name, called in _NAMES.items():
        for text in (*called, name):
            yield from ((name, f"{opening} {article}{text}") for opening in _OPENINGS for article in ("", "the ", "a "))
    for name in _FILES:
        yield name, f"SPDX-License-Identifier: {name}"
    for short in ("GPL", "LGPL", "AGPL"):
        for version in ("2", "3") if short == "GPL" else ("2.1", "3") if short == "LGPL" else ("3",):
            for suffix in ("-only", "-or-later"):
                full = version if "." in version else f"{version}.0"
                yield f"{short}-{full}", f"SPDX-License-Identifier: {short}-{full}{suffix}"
            for thing in ("program", "library", "software", "file"):
                yield f"{short}-{full}", _FREE.format(thing=thing, gnu=_GNU[short], version=version)
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");'
    yield from (("Apache-2.0", x) for x in (apache, f"{apache} you may not use this file except in compliance with the License."))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    yield from (("MPL-2.0", x) for x in (mpl, f"{mpl} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."))
    yield "BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"
    yield "Unlicense", "This is free and unencumbered software released into the public domain."


#: Known licences: full texts, and the one-line notices that stand for them.
KNOWN = tuple(dict.fromkeys((
    *(("MIT", title + _MIT) for title in ("", "The MIT License\n\n", "MIT License\n\n", "The MIT License (MIT)\n\n")),
    *(("ISC", title + text) for title in ("", "ISC License\n\n", "The ISC License\n\n") for text in (_ISC, _ISC.replace("and/or", "and"))),
    *(("0BSD", title + _ZERO_BSD) for title in ("", "Zero-Clause BSD\n\n", "BSD Zero Clause License\n\n")),
    *_files(), *_bsd(), *_notices(),
)))


def canonical_lines(text: Column) -> Column:
    """Canonical lines, each with a blank at both ends, joined by newlines."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r" ?\n ?", " \n "), F.lit(" "))
    for spelling, unified in SPELLINGS:
        if spelling != unified:
            out = F.replace(out, F.lit(spelling), F.lit(unified))
    return out


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "licence_id string, text string")


def known_digests(known: DataFrame, id_col: str = "licence_id", text_col: str = "text") -> DataFrame:
    """(digest, licence, length, start) of the distinct canonical texts."""
    text = canonical_text(canonical_lines(F.col(text_col)))
    rows = known.select(F.col(id_col).alias("licence"), text.alias("text")).where("text <> '' and licence is not null")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.first(F.length("text")).alias("length"), F.first(F.substring("text", 1, START)).alias("start"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_digest (of the canonical whole text), licence of the whole text (or null)
    and line_licences, the sorted distinct licences of its lines, comma-joined.

    Lines whose length or first letters no known text has are left out before hashing: they cannot be equal.
    """
    digests = known_digests(known).cache()
    lengths, starts = ([r[0] for r in digests.select(c).distinct().collect()] for c in ("length", "start"))
    slim = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.col(text_col)).alias("lines"))
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths) & F.substring(x, 1, START).isin(starts) if lengths else F.lit(False))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.sha2(canonical_text(F.col("lines")), 256).alias("digest")))
    units = F.concat(whole, F.transform(F.array_distinct(lines), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest"))))
    rows = slim.select("id", "row", F.explode(units).alias("unit")).select("id", "row", "unit.whole", "unit.digest")
    rows = rows.join(broadcast_if_small(digests.select("digest", "licence"), ["digest", "licence"]), "digest", "left")
    found = rows.where("whole or licence is not null").groupBy("row", "id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("line_licences"))
    return found.select(F.col("id").alias(id_col), "text_digest", "licence", "line_licences")
