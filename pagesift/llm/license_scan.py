"""Licence scan: segments of a text against licence notices by the Dice coefficient of word bigrams.

Segments are the lines of a text, its paragraphs of several lines (runs of lines between blank ones),
and the sentences of both: parts of a line of several sentences, and sentences that run over
a line break. Text is normalised to lower-case ASCII letters and digits with single spaces. With a
bigrams in the segment's set and b in a template's, the coefficient is 2 * shared / (a + b); it can
reach t only if t * b / (2 - t) <= a <= (2 - t) * b / t, so those bounds decide which templates
a segment is compared with at all.

Templates of one family (GNU, CC, Apache, BSD, MPL) differ by a word or a version only, so
each family has marks: bigrams that tell its members apart. A segment counts for the best template
whose marks are also its own; if it reaches only templates of other marks, it counts for the family
of the best (a version or variant without template is reported as ``GNU`` or ``CC``, never as another
version). Ties go to the first by name.

A template of b bigrams shares at least t * b / (2 - t) of them with whatever reaches t, so any
set of one more than the others has one of the shared. The longest make that set, as long words are rare in prose;
only a text, and in it a segment, with a word of such a bigram is compared with anything.

Column functions only. One scan, no shuffle but for the last grouping of the few hits, which is
combined before; the templates are literals of the plan.

Input cases: null or empty text has no hits; a segment of one word has no bigram; rows that
repeat an id add to its counts; a null id is a document of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75

# Usual notices of common licences, by SPDX name, or by family where members share the text.

_GNU = [
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ("GPL-1.0", "GNU General Public License", "1"),
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
]
_GNU_NOTICES = [
    "This work is licensed under the {}, version {}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
]
_CC = [
    ("BY", "Attribution"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-SA", "Attribution-ShareAlike"),
]
_CC_VERSIONS = [("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]

_BSD_INTRO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: (licence or family, text)
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", _BSD_INTRO),
    ("BSD", _BSD_DISCLAIMER),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_INTRO} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", _BSD_NAMES),
    ("BSD-3-Clause", f"{_BSD_INTRO} {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "GNU",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, notice.format(words, version)) for name, words, version in _GNU for notice in _GNU_NOTICES),
    *((f"CC-{code}-{version}", f"Licensed under CC {code} {version}.") for code, _ in _CC for version, _ in _CC_VERSIONS),
    *(
        (f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {words} {version} {kind} License.")
        for code, words in _CC
        for version, kind in _CC_VERSIONS
    ),
]

#: Families, the start of their members' names, and the bigrams that tell members apart.
FAMILIES: dict[str, tuple[str, list[str]]] = {
    "Apache": ("Apache", ["1 0", "1 1", "2 0"]),
    "BSD": ("BSD", ["0 clause", "2 clause", "3 clause", "4 clause", "advertising materials", "neither the"]),
    "CC": (
        "CC-BY",
        [
            "1 0", "2 0", "2 1", "2 5", "3 0", "4 0", "attribution noncommercial", "attribution noderivatives", "attribution noderivs",
            "attribution sharealike", "by nc", "by nd", "by sa", "nc nd", "nc sa", "noncommercial noderivatives", "noncommercial noderivs",
            "noncommercial sharealike",
        ],
    ),
    "GNU": ("AGPL GPL LGPL GNU", ["2 1", "gnu affero", "gnu lesser", "gnu library", "version 1", "version 2", "version 3"]),
    "MPL": ("MPL", ["1 0", "1 1", "2 0"]),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "\\n[ \\t\\r]*\\n[ \\t\\r\\n]*"
LINE_STOP, STOP = "[.;:!?][ \\t]+", "[.;:!?][ \\t\\r\\n]+"
EDGE = " \t\r\n"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, sorted."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def family_of(name: str) -> tuple[str, list[str]]:
    """The family of a licence and the family's marks; a licence of none is its own, without marks."""
    return next(((family, marks) for family, (starts, marks) in FAMILIES.items() if name.startswith(tuple(starts.split()))), (name, []))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set that can reach the threshold against a set of n."""
    sizes = [a for a in range(1, int((2 - threshold) * n / threshold) + 2) if 2 * min(a, n) >= threshold * (a + n)]
    return sizes[0], sizes[-1]


def key_bigrams(template: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every set that reaches the threshold has one: the longest ones."""
    shared = math.ceil(threshold * len(template) / (2 - threshold) - 1e-9)
    return sorted(template, key=lambda g: (-len(g), g))[: len(template) - shared + 1]


def _trigger(bigram: str) -> str:
    return max(bigram.split(" "), key=len)


def _quoted(values: list[str]) -> str:
    """SQL of an array of names or bigrams, which hold no quote."""
    return "cast(array(" + ", ".join(f"'{v}'" for v in values) + ") as array<string>)"


def _templates(notices: list[tuple[str, list[str]]], threshold: float) -> Column:
    """One literal: name, family, bounds, marks of the family, the template's own, and its bigrams, of each template."""
    rows = []
    for name, grams in notices:
        (family, marks), (low, high) = family_of(name), size_bounds(len(grams), threshold)
        own = _quoted([m for m in marks if m in grams])
        rows.append(f"named_struct('license', '{name}', 'family', '{family}', 'low', {low}, 'high', {high}, 'marks', {_quoted(marks)}, 'own', {own}, 'grams', {_quoted(grams)})")
    return F.expr("array(" + ", ".join(rows) + ")")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", F.lit(" "))), " ")


def _segments(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the sentences that are neither."""

    def sentences(whole: Column, stop: str) -> Column:
        parts = F.filter(F.split(whole, stop), lambda x: F.rlike(x, F.lit("[A-Za-z0-9]")))
        return _let(parts, lambda found: F.when(F.size(found) > 1, found).otherwise(F.expr(_quoted([]))))

    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, BLANK), lambda x: F.contains(x, F.lit("\n")))
    inside = F.flatten(F.transform(lines, lambda x: sentences(x, LINE_STOP)))
    across = F.filter(F.flatten(F.transform(paragraphs, lambda x: sentences(x, STOP))), lambda x: F.contains(F.btrim(x, F.lit(EDGE)), F.lit("\n")))
    return F.concat(lines, paragraphs, inside, across)


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, license (or family), n_segments, dice (of the best segment), for each licence found in a document."""
    named = [(name, bigrams(text)) for name, text in sorted(notices or NOTICES)]
    templates = _templates(named, threshold)
    bounds = [size_bounds(len(t), threshold) for _, t in named]
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
    keys = sorted({g for _, t in named for g in key_bigrams(t, threshold)})
    triggers = sorted({_trigger(g) for g in keys})
    text = F.col("text").cast("string")

    def best(grams: Column) -> Column:
        size = F.size(grams)

        def score(t: Column) -> Column:
            dice = 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (size + F.size(t["grams"]))
            return F.when(dice >= threshold, F.struct((-dice).alias("low"), t.alias("t")))

        def name(s: Column) -> Column:
            # marks of the segment are those of the template: as many, and none that the template lacks
            found, own = F.array_intersect(grams, s["t"]["marks"]), s["t"]["own"]
            other = (F.size(found) != F.size(own)) | (F.size(F.array_except(found, own)) > 0)
            return F.struct(other.alias("other"), s["low"].alias("low"), F.when(other, s["t"]["family"]).otherwise(s["t"]["license"]).alias("license"))

        near = F.array_compact(F.transform(F.filter(templates, lambda t: size.between(t["low"], t["high"])), score))
        likely = size.between(least, most) & F.exists(grams, lambda g: g.isin(keys))
        return F.when(likely, F.array_min(F.transform(near, name)))

    def pairs(words: Column) -> Column:
        firsts, seconds = F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1)
        # a set of bigrams has at most one less than the words, so shorter segments cannot reach the least bound
        likely = (F.size(words) > least) & F.exists(words, lambda w: w.isin(triggers))
        return F.when(likely, _let(F.array_distinct(F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b))), best))

    matched = F.array_compact(F.transform(_segments(text), lambda segment: _let(_words(segment), pairs)))
    hits = F.when(F.exists(_words(text), lambda w: w.isin(triggers)), matched)
    # the outer form keeps the optimizer from evaluating the hits a second time as a filter
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode_outer(hits).alias("best")).where("best IS NOT NULL")
    return found.groupBy("doc_id", F.col("best.license").alias("license")).agg(F.count("*").alias("n_segments"), F.max(-F.col("best.low")).alias("dice"))
