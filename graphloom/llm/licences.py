"""Licence statements: Dice coefficient over the word bigrams of normalised text and of templates.

What is compared with the templates is every line of a document, the document as a whole, and windows:
for each template, every run of as many words as it has, wherever lines end, that begins with one of its
bigrams (or what is left of the text from there). So a notice is found that is wrapped over lines, or
stands among other words. Text is normalised by lower-casing A-Z and taking runs of a-z and 0-9 as words.
With A and B the sets of bigrams, the coefficient is 2 |A and B| / (|A| + |B|). It can reach a threshold t
only if |A| lies between t / (2 - t) and (2 - t) / t times |B|, so a template is compared only with units
of such a size; and since a unit has at least as many bigrams as distinct words but one, long units go
before their bigrams are made. Nor can it without t / (2 - t) of the template's bigrams, which needs a
least number of its words, so windows are made only of documents that hold so many words, then bigrams.

Null, empty and one-word texts hold no licence. Repeated rows stay. The best unit of a document counts;
ties go to the template that comes first in order of its name. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: Fixed texts: licence notices by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

LEAST = 0.8


def template_words(text: str) -> list[str]:
    """The words of a template, normalised as texts are."""
    import re

    return [x for x in re.split("[^a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]


def template_bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template."""
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once; within a lambda a column may be made anew at each turn."""
    return F.transform(F.array(value), body)[0]


def least_words(bigrams: list[str], least: int) -> int:
    """Distinct words that any `least` of the bigrams have, at the fewest: k words are in no more bigrams
    than half the sum of the k largest counts of bigrams that a word is in."""
    count = Counter(w for b in bigrams for w in b.split(" "))
    held = k = 0
    for n in sorted(count.values(), reverse=True):
        if held >= 2 * least:
            break
        held, k = held + n, k + 1
    return k


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that may reach the threshold with a template of n."""
    return math.ceil(least / (2 - least) * n - 1e-9), math.floor((2 - least) / least * n + 1e-9)


def normalised(text: Column) -> Column:
    """Words of a text; upper-case letters are lowered after the cut, word by word, so no others change."""
    return F.array_remove(F.split(text, "[^A-Za-z0-9]+"), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licence, dice (of the best unit; null if none reaches the threshold), n_units (lines, and the
    document, that do), n_windows (that do)."""
    known = [(name, len(template_words(text)), template_bigrams(text)) for name, text in sorted(templates.items())]
    bounds = [size_bounds(len(b), least) for _, _, b in known]
    lo, hi = min(b[0] for b in bounds), max(b[1] for b in bounds)
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(n).alias("n_words"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(x).alias("lo"), F.lit(y).alias("hi"), F.array(*map(F.lit, sorted({w for g in b for w in g.split(" ")}))).alias("words"), F.lit(least_words(b, x)).alias("least_words")) for (name, n, b), (x, y) in zip(known, bounds, strict=True)))
    bigrams = sorted({x for _, _, b in known for x in b})
    firsts, seconds = (sorted({x.split(" ")[k] for x in bigrams}) for k in (0, 1))

    df = docs.select(column(docs, id_col).alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    # a document of one line is its own only line: it counts once
    lines = F.split("text", "\n")
    lowered = lambda w: F.split(F.lower(F.array_join(w, " ")), " ")
    df = df.withColumn("words", lowered(normalised(F.col("text"))))
    none = F.array().cast("array<array<string>>")
    known_words = F.array_intersect(F.array(*map(F.lit, sorted({*firsts, *seconds}))), F.col("words"))
    df = df.withColumn("near", let(known_words, lambda held: F.filter(table, lambda t: F.size(F.array_intersect(t["words"], held)) >= t["least_words"])))
    # a place for each word: the bigram that begins there, null where no template has it
    after = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    at = F.zip_with("words", after, lambda a, b: F.when(a.isin(firsts) & b.isin(seconds), F.concat_ws(" ", a, b)))
    df = df.withColumn("at", F.when(F.size("near") > 0, F.transform(at, lambda x: F.when(x.isin(bigrams), x))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("near", let(F.array_distinct(F.array_compact("at")), lambda held: F.filter("near", lambda t: F.size(F.array_intersect(t["bigrams"], held)) >= t["lo"])))

    # no unit of a document can come near a template that the document itself isn't near
    units = F.transform(F.filter(F.transform(lines, normalised), lambda w: F.size(w) > lo), lowered)
    units = F.concat(units, F.when((F.size(lines) > 1) & (F.size("words") > lo), F.array("words")).otherwise(none))
    units = F.filter(units, lambda w: F.size(F.array_distinct(w)) - 1 <= hi)
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    units = F.filter(F.transform(units, pairs), lambda b: F.size(b).between(lo, hi))
    df = df.withColumn("units", F.when(F.size("near") > 0, units).otherwise(none))

    def score(bigrams: Column, t: Column) -> Column:
        return (F.lit(2.0) * F.size(F.array_intersect(t["bigrams"], bigrams))) / (F.size(bigrams) + F.size(t["bigrams"]))

    def best(bigrams: Column) -> Column:
        near = F.filter("near", lambda t: F.size(bigrams).between(t["lo"], t["hi"]))
        # least of (-dice, name): the best, the first name if tied
        return F.array_min(F.transform(near, lambda t: F.struct((-score(bigrams, t)).alias("minus"), t["name"].alias("name"))))

    def windows(t: Column) -> Column:
        begins = F.array_compact(F.transform("at", lambda x, i: F.when(F.array_contains(t["bigrams"], x), i)))
        word = lambda j: F.get("words", j)
        bigrams = lambda i: F.array_distinct(F.transform(F.sequence(i, F.least(i + t["n_words"], F.size("words")) - 2), lambda j: F.concat_ws(" ", word(j), word(j + 1))))
        return F.transform(F.transform(begins, bigrams), lambda b: F.struct((-score(b, t)).alias("minus"), t["name"].alias("name")))

    reach = lambda x: -x["minus"] >= least
    df = df.select("doc_id", F.filter(F.transform("units", best), reach).alias("found"), F.filter(F.flatten(F.transform("near", windows)), reach).alias("seen"))
    top = F.array_min(F.concat("found", "seen"))
    return df.select("doc_id", top["name"].alias("licence"), (-top["minus"]).alias("dice"), F.size("found").cast("long").alias("n_units"), F.size("seen").cast("long").alias("n_windows"))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)


VALUES = ", ".join(f"($q${name}$q$, {len(template_words(text))}, [{', '.join(f'$q${b}$q$' for b in template_bigrams(text))}])" for name, text in sorted(TEMPLATES.items()))

SQL = rf"""
WITH t(name, n, tb) AS (VALUES {VALUES}), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), u AS (
  SELECT r, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS unit FROM d
), w AS (
  SELECT r, row_number() OVER () AS k, list_filter(regexp_split_to_array(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u
), b AS (
  SELECT r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1
), c AS (
  SELECT r, k, name, 2.0::DOUBLE * len(list_intersect(tb, b)) / (len(b) + len(tb)) AS dice FROM b, t WHERE len(b) BETWEEN 0.6 * len(tb) AND 1.6 * len(tb)
), f AS (
  SELECT r, k, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM c WHERE dice >= 0.8 GROUP BY r, k
), tw AS (
  SELECT r, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM d
), g AS (
  SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM tw WHERE len(w) > 1
), v AS (
  SELECT r, name, tb, unnest(list_transform(list_filter(range(1, len(g) + 1), lambda i: list_contains(tb, g[i])), lambda i: list_distinct(g[i:i + n - 2]))) AS b
  FROM g, t WHERE 3 * len(list_intersect(tb, g)) >= 2 * len(tb)
), z AS (
  SELECT r, name, 2.0::DOUBLE * len(list_intersect(tb, b)) / (len(b) + len(tb)) AS dice FROM v
), a AS (
  SELECT r, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice, count(*) FILTER (line) AS n_units, count(*) FILTER (NOT line) AS n_windows
  FROM (SELECT r, dice, name, true AS line FROM f UNION ALL SELECT r, dice, name, false FROM z WHERE dice >= 0.8) GROUP BY r
)
SELECT doc_id, licence, dice, coalesce(n_units, 0) AS n_units, coalesce(n_windows, 0) AS n_windows FROM d LEFT JOIN a USING (r)
"""
