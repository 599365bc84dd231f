"""Operator 6: licence scans with DataFrame functions only.

Lines, blocks of lines between blank lines, windows of a few blocks, and whole texts are normalised to words of a-z and
0-9 and compared with licence templates by the Dice coefficient over sets of word bigrams. A template is a candidate
only if its number of bigrams lies within the bounds that the threshold puts on it: t / (2 - t) to (2 - t) / t times the
unit's own. Before anything is normalised, texts and units must hold one of a few marker words: so many bigrams of every
template contain one that a unit without them cannot reach the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence texts and notices; fixed values.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
TEMPLATES = {
    "MIT-text": [f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"],
    "ISC-text": [f"{ISC_GRANT} {ISC_WARRANTY}"],
    "BSD-2-Clause-text": [f"{BSD_GRANT} {BSD_ONE} {BSD_TWO} {BSD_WARRANTY}"],
    "BSD-3-Clause-text": [f"{BSD_GRANT} {BSD_ONE} {BSD_TWO} {BSD_THREE} {BSD_WARRANTY}"],
    "Zlib-text": [ZLIB],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0-header": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MIT-permission": [MIT_GRANT],
    "ISC": [ISC_GRANT],
    "BSD-2-Clause": [BSD_GRANT],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-header": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
#: Common words, which are no markers where others will do.
COMMON = frozenset("the of or and to in for by under with without this that any all not be is are as at on from into may shall must you your its work use".split())
#: Numbers of blocks in a window.
WINDOWS = (2, 3, 4, 5, 6)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    words = re.findall("[0-9a-z]+", text.translate(str.maketrans(UPPER, LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates() -> list[tuple[str, list[str]]]:
    return [(name, bigrams(t)) for name, texts in TEMPLATES.items() for t in texts]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and largest number of bigrams of a unit that can reach the threshold with a template of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


@lru_cache(4)
def markers(threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one."""
    known = [set(g) for _, g in templates()]
    # a unit must share at least so many bigrams with the template, so it cannot do without more than the rest
    shared = [math.ceil(threshold * (len(g) + size_bounds(len(g), threshold)[0]) / 2 - 1e-9) for g in known]
    chosen: list[str] = []
    while still := [(g, len(g) - n + 1) for g, n in zip(known, shared, strict=True) if len(g) >= n]:
        votes: Counter = Counter()
        for grams, excess in still:
            for w, n in Counter(w for g in grams for w in set(g.split())).items():
                votes[w] += min(1.0, n / excess)
        word = min(votes, key=lambda w: (w in COMMON, max(0, 6 - len(w)), -votes[w], w))
        chosen.append(word)
        known = [{g for g in grams if word not in g.split()} for grams in known]
    return chosen


def marked(text: Column, threshold: float) -> Column:
    low = F.lower(text)  # of A to Z the same as in words_of
    long = [F.contains(low, F.lit(w)) for w in markers(threshold) if len(w) > 4]
    short = [w for w in markers(threshold) if len(w) <= 4]  # whole words only
    return reduce(lambda a, b: a | b, [*long, low.rlike(f"(?<![0-9a-z])(?:{'|'.join(short)})(?![0-9a-z])")] if short else long)


def words_of(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^0-9a-z]+", " ")), " ")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per match: doc_id, unit, unit_no from 0, license, dice, n_bigrams.

    A unit is a line, a block of more than one line, a window of 2 to 6 blocks (block2 to block6, numbered by the first)
    or the whole text of more than 6 blocks. Of several templates of one licence the best counts; a unit may
    match several licences. Null and empty texts have no matches; a null doc_id is kept; repeated rows repeat their
    matches; an empty table gives none. Very long texts are cut into units like others and scanned whole; a licence of
    equal dice as another is returned beside it. Columns other than doc_id and text are not read.
    """
    known = templates()
    bounds = [size_bounds(len(b), threshold) for _, b in known]
    least, most = min(a for a, _ in bounds), max(b for _, b in bounds)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(marked(F.col("text"), threshold))
    own = once(own, "parts", F.split("text", r"\n[ \t\r]*\n"))
    unit = lambda kind, no, body: F.struct(F.lit(kind).alias("unit"), no.alias("unit_no"), body.alias("body"))
    every = [F.transform(F.split("text", "\n"), lambda x, i: unit("line", i, x)), F.transform("parts", lambda x, i: unit("block", i, x))]
    every[1] = F.filter(every[1], lambda u: F.contains(u["body"], F.lit("\n")))

    def windowed(k: int) -> Callable[[Column, Column], Column]:
        return lambda x, i: unit(f"block{k}", i, F.array_join(F.slice("parts", i + 1, F.lit(k)), "\n\n"))

    for k in WINDOWS:
        window = F.transform("parts", windowed(k))
        every.append(F.when(F.size("parts") >= k, F.slice(window, 1, F.size("parts") - (k - 1))).otherwise(F.slice(window, 1, 0)))
    whole = F.array(unit("text", F.lit(0), F.col("text")))
    every.append(F.when(F.size("parts") > WINDOWS[-1], whole).otherwise(F.slice(whole, 1, 0)))
    units = own.select("doc_id", F.explode(F.concat(*every)).alias("u")).select("doc_id", "u.*").where(marked(F.col("body"), threshold))
    units = once(units, "words", words_of(F.col("body"))).drop("body")
    # each distinct word but the last begins a distinct bigram
    units = units.where((F.size("words") > least) & (F.size(F.array_distinct("words")) - 1 <= most))
    pairs = F.zip_with(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))
    units = once(units, "own", F.array_distinct(pairs)).drop("words").withColumn("n_bigrams", F.size("own"))
    units = units.where((F.col("n_bigrams") >= least) & (F.col("n_bigrams") <= most))
    scores: dict[str, list[Column]] = {}
    for name, grams in known:
        k = len(grams)
        within = F.col("n_bigrams").between(*size_bounds(k, threshold))
        dice = F.size(F.array_intersect("own", F.array(*map(F.lit, grams)))) * 2.0 / (F.col("n_bigrams") + k)
        scores.setdefault(name, []).append(F.when(within, dice))
    each = [F.struct(F.lit(name).alias("license"), (F.greatest(*own) if len(own) > 1 else own[0]).alias("dice")) for name, own in scores.items()]
    hits = units.select("doc_id", "unit", "unit_no", "n_bigrams", F.explode(F.filter(F.array(*each), lambda s: s["dice"] >= threshold)).alias("h"))
    return hits.select("doc_id", "unit", "unit_no", "h.license", "h.dice", "n_bigrams")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and columns read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def oracle(threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in templates())
    windows = "".join(f"""
  UNION ALL SELECT doc_id, 'block{k}', list_transform(range(1, len(parts) - {k - 2}), lambda i: array_to_string(parts[i:i + {k - 1}], chr(10))) FROM blocks WHERE len(parts) >= {k}""" for k in WINDOWS)
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
blocks AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents),
split AS (
  SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS bodies FROM documents
  UNION ALL SELECT doc_id, 'block', parts FROM blocks{windows}
  UNION ALL SELECT doc_id, 'text', [text] FROM blocks WHERE len(parts) > {WINDOWS[-1]}),
units AS (
  SELECT doc_id, unit, CAST(i - 1 AS INTEGER) AS unit_no, bodies[i] AS body
  FROM (SELECT doc_id, unit, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM split)
  WHERE unit != 'block' OR contains(bodies[i], chr(10))),
worded AS (
  SELECT doc_id, unit, unit_no, string_split(trim(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[^0-9a-z]+', ' ', 'g')), ' ') AS w FROM units),
own AS (
  SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, unit_no, license, CAST(len(own.grams) AS INTEGER) AS n_bigrams,
         2.0::DOUBLE * len(list_intersect(own.grams, t.grams)) / (len(own.grams) + len(t.grams)) AS dice
  FROM own JOIN templates t ON len(own.grams) BETWEEN ceil(len(t.grams) * {threshold}::DOUBLE / (2 - {threshold}::DOUBLE) - 1e-9) AND floor(len(t.grams) * (2 - {threshold}::DOUBLE) / {threshold}::DOUBLE + 1e-9))
SELECT doc_id, unit, unit_no, license, max(dice) AS dice, n_bigrams FROM scored WHERE dice >= {threshold}::DOUBLE
GROUP BY doc_id, unit, unit_no, license, n_bigrams"""
