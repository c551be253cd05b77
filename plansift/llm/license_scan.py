"""License scans by Dice coefficient over word bigrams, with DataFrame functions only.

Texts are normalised (letters A-Z lower, other characters than a-z and 0-9 to one space) and their units compared with
licence templates as sets of word bigrams.  Units are lines, sentences of a line, paragraphs, the whole text, and, since
licences are wrapped, runs of lines that have about as many words as a template.  Dice of sets of sizes a and b is at
most 2 min(a, b) / (a + b), so a template is only compared with units whose size lies within [t / (2 - t), (2 - t) / t]
times its own.

Before that, units without enough of a template's words are left out.  A unit of Dice t or more has at least
t / (2 - t) of a template's bigrams.  The marks stand in more bigrams than the rest, so that every such unit has one of
them: most texts have none and are not even split into lines.  Of a template's longer words a unit must have many.

Scale: one map over the texts; only units that were found are grouped by their text.  The templates are a fixed list
and travel in the plan.
"""

from __future__ import annotations

import math
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the licence texts below.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CONDITIONS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Notices, short forms and texts of well-known public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", BSD_GRANT),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", ISC_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("MIT", MIT_WARRANTY),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_NAME} {BSD_WARRANTY}"),
    ("ISC", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("All-Rights-Reserved", "All rights reserved."),
)


#: Parts of words that licences have more often than other texts.
MARKS = (
    "licens", "copyright", "software", "warrant", "distribut", "merchantab", "infring", "liab", "damage", "permission", "permitted", "reserved", "disclaim", "contribut", "foundation", "encumber",
    "mozilla", "eclipse", "apache", "gnu", "attribution", "noncommercial", "sharealike", "negligen", "neighboring", "waived",
)
#: The most lines of a wrapped licence.
LINES = 40
LONG = 5
SENTENCE = "[.!?] +"


def words_of(text: str) -> list[str]:
    """The words of a normalised template."""
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams that a text of Dice ``threshold`` or more to ``size`` bigrams can have."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def telling(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which a unit of Dice ``threshold`` or more has some, whatever it lacks.

    The templates' words with one of ``MARKS``, and where they are too few for a template, greedily further words, longer
    ones first.
    """
    words = sorted({w for g in grams for x in g for w in x.split()})
    marks = {w for w in words if any(m in w for m in MARKS)}
    for least in (9, 7, 5, 1):
        while True:
            short = {}
            for n, g in enumerate(grams):
                left = [x for x in g if marks.isdisjoint(x.split())]
                if len(left) >= bounds(len(g), threshold)[0]:
                    short[n] = left
            gain = {w: sum(w in x.split() for left in short.values() for x in left) for w in words if len(w) >= least}
            best = max(gain, key=lambda w: gain[w])
            if not gain[best]:
                break
            marks.add(best)
    return sorted(marks)


def own_words(grams: list[list[str]], threshold: float) -> tuple[list[str], list[int]]:
    """Words of the templates, and how many of them a unit has that is like each template.

    The unit lacks few of the template's bigrams, and one word stands in two at most.  Words have ``LONG`` letters or
    more, except where a template has too few of those.
    """
    spare = [len(g) - bounds(len(g), threshold)[0] for g in grams]
    words = {w for g in grams for x in g for w in x.split() if len(w) >= LONG}
    covered = lambda g: sum(not words.isdisjoint(x.split()) for x in g)
    for g, n in zip(grams, spare, strict=True):
        if covered(g) <= n:
            words.update(w for x in g for w in x.split())
    return sorted(words), [math.ceil((covered(g) - n) / 2) for g, n in zip(grams, spare, strict=True)]


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(``id_col``, ``line_no``, ``line_to``, ``license``, ``dice``, ``n_bigrams``) of each unit that is a licence.

    Lines count from 1, from ``line_no`` to ``line_to``; 0 is the whole text, compared where it has more than one line.
    A unit's template is the best, ties to the first in the list.  Of units that share a line only those are given that
    no better one overlaps: the larger Dice, then the earlier template, start and end.  Null and empty texts and units
    of one word have no bigrams and give no row; null ids are carried; repeated rows give repeated results; an empty
    table gives an empty one; very long texts are read whole; other columns are not read.
    """
    sizes = [len(words_of(t)) for _, t in templates]
    grams = [bigrams_of(t) for _, t in templates]
    limits = [bounds(len(g), threshold) for g in grams]
    marks = telling(grams, threshold)
    vocabulary, needed = own_words(grams, threshold)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # the Kelvin sign is the one character beside A-Z that lower() makes a letter of
    words = F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit(" "))), "[^a-z0-9]+")
    told = F.arrays_overlap(words, F.array(*map(F.lit, marks)))
    picked = docs.where(told).select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), text.alias("text"))
    lines = _once(picked, "row", "id", raw=F.split("text", "\n"))
    lines = _once(lines, "row", "id", "raw", norm=F.transform("raw", _normal))
    known = F.array(*map(F.lit, vocabulary))
    lines = _once(lines, "row", "id", "raw", "norm", told=F.transform("norm", lambda x: F.size(F.filter(F.split(x, " "), lambda w: F.array_contains(known, w)))))
    lines = _once(lines, "row", "id", "raw", "norm", "told", n=F.transform("norm", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1)))

    # from every line on the lines that follow, and the whole text as one line before them
    def start(at: Column, line: Column, after: Column, told: Column, n: Column, opens: Column) -> Column:
        return F.struct(at.alias("at"), line.alias("line"), after.alias("next"), told.alias("told"), n.alias("n"), opens.alias("opens"))

    total = lambda xs, k: F.aggregate(F.slice(xs, 1, k), F.lit(0), lambda a, x: a + x)
    every_word, every_told = total("n", F.size("n")), total("told", F.size("told"))
    whole = F.when(F.size("raw") > 1, F.array(start(F.lit(-1), F.lit(""), F.array(_joined(F.col("norm"))), F.array(every_told), F.array(every_word), F.lit(False))))
    ahead = lambda name, i: F.slice(name, i + 1, LINES)
    each = F.transform("raw", lambda x, i: start(i, x, ahead("norm", i), ahead("told", i), ahead("n", i), F.coalesce(F.get("norm", i - 1) == "", F.lit(True))))
    each = F.filter(each, lambda s: (F.get(s["n"], F.lit(0)) > 0) & F.exists(s["told"], lambda n: n > 0))
    ahead = lines.select("row", "id", F.inline(F.concat(F.coalesce(whole, F.slice(each, 1, 0)), each)))
    upto = F.transform(F.sequence(F.lit(1), F.size("n")), lambda k: F.struct(total("n", k).alias("words"), total("told", k).alias("told")))
    ahead = _once(ahead, "row", "id", "at", "line", "next", "told", "n", "opens", upto=upto)

    # units: one line, its sentences, the paragraph that it opens, and the runs that come nearest to a template's number of words
    def unit(x: Column, k: Column | int, pick: Column | int) -> Column:
        return F.struct(x.alias("x"), F.lit(k).cast("int").alias("k"), F.lit(pick).cast("int").alias("pick"))

    no_units = F.array().cast("array<struct<x:string,k:int,pick:int>>")
    first = F.get("next", F.lit(0))
    sentences = F.when(F.col("line").rlike(SENTENCE), F.transform(F.split("line", SENTENCE), lambda x: unit(_normal(x), 1, -1)))
    single = F.when(F.get("told", F.lit(0)) > 0, F.concat(F.array(unit(first, 1, -1)), F.coalesce(sentences, no_units)))
    blank = F.array_position("n", 0).cast("int")
    ends = F.when(blank > 0, blank - 1).when(F.size("n") < LINES, F.size("n"))
    run = lambda k: _joined(F.slice("next", 1, k))
    paragraph = F.when(F.col("opens") & (ends > 1), F.array(unit(run(ends), ends, -1)))
    spec = F.array(*(F.struct(F.lit(n).alias("pick"), F.lit(sizes[n]).alias("size"), F.lit(limits[n][0]).alias("least"), F.lit(needed[n]).alias("needed")) for n in range(len(templates))))

    def runs(t: Column) -> Column:
        below = F.size(F.filter("upto", lambda u: u["words"] < t["size"]))
        return F.transform(F.array(below, below + 1), lambda k: F.struct(k.alias("k"), t["pick"].alias("pick"), t["least"].alias("least"), t["needed"].alias("needed")))

    def enough(u: Column) -> Column:
        sums = F.get("upto", u["k"] - 1)
        return u["k"].between(2, F.size("n")) & (sums["words"] > u["least"]) & (sums["told"] >= u["needed"])

    wrapped = F.transform(F.filter(F.flatten(F.transform(spec, runs)), enough), lambda u: unit(run(u["k"]), u["k"], u["pick"]))
    units = F.concat(F.coalesce(single, no_units), F.coalesce(paragraph, no_units), F.coalesce(wrapped, no_units))
    every = ahead.select("row", "id", (F.col("at") + 1).alias("line_no"), F.inline(units))
    least, most = min(a for a, _ in limits), max(b for _, b in limits)
    line_to = F.when(F.col("line_no") == 0, 0).otherwise(F.col("line_no") + F.col("k") - 1).alias("line_to")
    words = every.select("row", "id", "line_no", line_to, "pick", F.split("x", " ").alias("words")).where(F.size("words") > least)
    sized = _once(words, "row", "id", "line_no", "line_to", "pick", grams=_bigrams(F.col("words"))).where(F.size("grams").between(least, most))

    def compared(n: int) -> Column:
        shared = F.size(F.array_intersect("grams", F.array(*map(F.lit, grams[n]))))
        fits = F.size("grams").between(*limits[n]) & F.col("pick").isin(-1, n)
        dice = F.when(fits, 2.0 * shared / (F.size("grams") + len(grams[n])))
        return F.struct(dice.alias("dice"), F.lit(-n).alias("order"), F.lit(templates[n][0]).alias("license"))

    best = F.array_max(F.array(*map(compared, range(len(templates)))))
    found = _once(sized, "row", "id", "line_no", "line_to", "grams", best=best).where(F.col("best.dice") >= threshold)
    rank = F.struct((-F.col("best.dice")).alias("loss"), (-F.col("best.order")).alias("order"), F.col("line_no"), F.col("line_to"), F.size("grams").alias("n_bigrams"), F.col("best.license").alias("license"))
    # the best of each start, in order: what overlaps stands within LINES places of one another; a text's units at most
    starts = found.groupBy("row", "id", "line_no").agg(F.min(rank).alias("u")).groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("line_no", "u"))).alias("us"))

    def stays(s: Column, k: Column) -> Column:
        u = s["u"]
        near = F.slice("us", F.greatest(k + 1 - LINES, F.lit(1)), 2 * LINES)
        beaten = F.exists(near, lambda v: (v["line_no"] > 0) & (v["line_no"] <= u["line_to"]) & (v["u"]["line_to"] >= u["line_no"]) & (v["u"] < u))
        return (u["line_no"] == 0) | ~beaten

    kept = starts.select("id", F.explode(F.filter("us", stays)["u"]).alias("u"))
    return kept.select(F.col("id").alias(id_col), "u.line_no", "u.line_to", "u.license", (-F.col("u.loss")).alias("dice"), "u.n_bigrams")


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _once(df: DataFrame, *names: str, **value: Column) -> DataFrame:
    """A computed column that later steps read several times: the one-element explode keeps the optimiser from copying it into each."""
    (name, expr), = value.items()
    return df.select(*names, F.explode(F.array(expr)).alias(name))
