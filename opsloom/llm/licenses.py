"""License scans: an exact set-similarity join of text blocks with a table of license templates.

Templates may be of any length. Those of one length class (up to 32, 64, 128 ... words: its stride) share blocks: windows of
two strides of words at every stride, so each run of up to a stride of words lies inside one. A block matches a template if it holds at least ``threshold`` of the template's words. Template words are ordered by
their frequency in the corpus, the rarest first, and three filters go before the exact overlap:

* prefix: a match must hold one of the ``|T| - need + 1`` rarest words of the template;
* length: the block must hold ``need`` template words of any kind;
* position: the words behind the first shared one, on either side, must suffice to reach ``need``.

Only blocks that hold a prefix word are looked at, and there an inverted index from prefix words to templates names the
candidates. Words outside all templates never add to an overlap, so the join works on the template vocabulary. The template
side is a parameter, not data; it travels as a literal, and the join is a projection: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.text import let

#: Stride of the shortest length class, in words.
STRIDE = 32
#: What separates words: ASCII other than letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A license text. With ``exact`` its words must also stand consecutively; the places where they do are reported."""

    label: str
    text: str
    threshold: float = 0.8
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(BREAKS, self.text.translate(str.maketrans(UPPER, LOWER))) if w]

    @property
    def stride(self) -> int:
        """The smallest power of two, from ``STRIDE``, that is no less than the number of words."""
        return max(STRIDE, 1 << (len(self.words) - 1).bit_length())


# The base phrases, usual notices, and the bodies of short licenses.
PHRASES = (Template("mit", "mit license", 1.0, True), Template("apache", "apache license", 1.0, True),
           Template("gpl", "general public license", 1.0, True))
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", 1.0),
    Template("mit-release", "released under the mit license"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("all-rights", "all rights reserved"),
)
_PROVIDED = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including,
but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event
shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential
damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business
interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including
negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
BODIES = (
    Template("mit-body", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. The Software is provided "as is", without warranty of any
kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and
noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether
in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings
in the Software."""),
    Template("bsd-body", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. """ + _PROVIDED),
    Template("bsd-disclaimer", _PROVIDED),
    Template("isc-body", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as
is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages
whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action,
arising out of or in connection with the use or performance of this software."""),
    Template("zlib-body", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be
removed or altered from any source distribution."""),
    Template("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    Template("gpl-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program."""),
)
TEMPLATES = PHRASES + NOTICES + BODIES


def license_words(text: str | Column) -> Column:
    """Words of the text with A-Z lowered; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def frequency_order(docs: DataFrame, text: str, templates: Sequence[Template]) -> list[str]:
    """The template words, the rarest in the corpus first. As many rows come back as the templates have words."""
    words = vocabulary(templates)
    found = docs.select(F.explode(F.filter(license_words(text), lambda w: w.isin(words))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@dataclass(frozen=True)
class _Class:
    """Templates of one stride: as an array literal, each with its words in global order, its prefix and the overlap it needs;
    their words and prefix words; and the inverted index, for each prefix word the numbers of the templates that it heads."""

    stride: int
    templates: Column
    order: list[str]
    prefixes: list[str]
    postings: Column


def _classes(templates: Sequence[Template], order: Sequence[str]) -> list[_Class]:
    place = {w: i for i, w in enumerate(order)}
    found = []
    for stride in sorted({t.stride for t in templates}):
        rows, index, words = [], {}, set()
        for number, t in enumerate(t for t in templates if t.stride == stride):
            tokens = sorted(set(t.words), key=place.__getitem__)
            need = math.ceil(t.threshold * len(tokens) - 1e-9)
            prefix = tokens[: len(tokens) - need + 1]
            words.update(tokens)
            for w in prefix:
                index.setdefault(w, []).append(number)
            rows.append(F.struct(F.lit(t.label).alias("label"), _texts(tokens).alias("tokens"), _texts(prefix).alias("prefix"),
                                 F.lit(need).alias("need"), _texts(t.words if t.exact else []).alias("phrase")))
        prefixes = sorted(index)
        postings = F.map_from_arrays(_texts(prefixes), F.array(*[F.array(*map(F.lit, index[w])) for w in prefixes]))
        found.append(_Class(stride, F.array(*rows), sorted(words, key=place.__getitem__), prefixes, postings))
    return found


def _match(template: Column, block: Column, held: Column, start: Column, stride: int) -> Column:
    """A match struct, or null."""
    overlap = F.size(F.array_intersect(template["tokens"], held))

    def positioned(first: Column) -> Column:
        behind = F.least(F.size(template["tokens"]) - F.array_position(template["tokens"], first),
                         F.size(held) - F.array_position(held, first))
        return first.isNotNull() & (behind + 1 >= template["need"])

    candidate = (F.size(held) >= template["need"]) & let(F.get(F.array_intersect(template["prefix"], held), F.lit(0)), positioned)
    places = F.filter(F.sequence(F.lit(0), F.lit(stride - 1)),
                      lambda s: F.slice(block, s + 1, F.size(template["phrase"])) == template["phrase"])
    exact = F.when(F.size(template["phrase"]) > 0, F.transform(places, lambda s: (s + start).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    found = F.when(overlap >= template["need"], F.struct(
        template["label"].alias("label"), start.cast("long").alias("start"), F.size(block).cast("long").alias("n_words"),
        (overlap / F.size(template["tokens"])).alias("containment"), (F.size(template["phrase"]) > 0).alias("exact"),
        exact.alias("places")))
    return F.when(candidate, found)


def match_templates(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES,
                    out: str = "licenses") -> DataFrame:
    """``docs`` with ``out``: ``n_words`` and ``matches``, an array of (label, start, n_words, containment, exact, places).

    ``start`` and ``n_words`` describe the block; ``places`` are the first words of the phrase of an exact template (such a
    template matches only where it has one). Null and empty texts have no words and no match. Rows are independent, so
    repeated rows and null ids make no difference, an empty table gives no rows; a column named as ``out`` is replaced.
    """
    order = frequency_order(docs, text, templates)
    classes = _classes(templates, order)
    prefixes = sorted({w for c in classes for w in c.prefixes})

    def in_block(c: _Class, tokens: Column, number: Column) -> Column:
        start = number * c.stride

        def matches(block: Column) -> Column:
            def joined(held: Column) -> Column:
                heads = F.array_intersect(_texts(c.prefixes), held)
                candidates = F.array_sort(F.array_distinct(F.flatten(F.transform(heads, lambda w: F.element_at(c.postings, w)))))
                found = F.transform(candidates, lambda n: _match(F.get(c.templates, n), block, held, start, c.stride))
                return F.filter(found, lambda m: m.isNotNull() & (~m["exact"] | (F.size(m["places"]) > 0)))
            return let(F.array_intersect(_texts(c.order), block), joined)
        return let(F.slice(tokens, start + 1, 2 * c.stride), matches)

    def in_class(c: _Class, tokens: Column, heads: Column) -> Column:
        blocks = F.transform(F.filter(heads, lambda h: h["word"].isin(c.prefixes)), lambda h: F.floor(h["at"] / c.stride).cast("int"))
        numbers = let(F.array_distinct(blocks), lambda a: F.array_distinct(F.concat(
            a, F.filter(F.transform(a, lambda b: b - 1), lambda b: b >= 0))))
        return F.flatten(F.transform(numbers, lambda b: in_block(c, tokens, b)))

    def scan(tokens: Column) -> Column:
        heads = F.filter(F.transform(tokens, lambda w, i: F.when(w.isin(prefixes), F.struct(w.alias("word"), i.alias("at")))),
                         lambda h: h.isNotNull())
        matches = let(heads, lambda hs: F.concat(*[in_class(c, tokens, hs) for c in classes]))
        return F.struct(F.size(tokens).cast("long").alias("n_words"), matches.alias("matches"))

    return docs.withColumn(out, let(license_words(text), scan))
