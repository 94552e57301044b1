"""Licence scans: passages of documents compared to licence templates by the Dice coefficient of their
word bigrams, in DataFrame operations alone.

A passage is a line of a document, a run of lines between blank ones if it has several, or the whole
document if that has several runs. What these do not bring up is looked for in windows: runs of words of
any place and length that begin and end with a bigram of the template, so a licence is found in a part of
a line and across blank lines too. Passages and templates are normalised alike: A-Z to lower case,
everything but letters and digits to blanks. With a and b distinct bigrams, of which c are common,
Dice is 2c / (a + b); for it to reach t, a must lie between b * t / (2 - t) and b * (2 - t) / t, which
rules most templates out by size, and at least t / (2 - t) * b of the template's bigrams must occur, so
one of any b - need + 1 of them does. Such a set of each template is probed first: documents without a
word of these bigrams are done with at once, passages without one of the bigrams before any is counted.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

LEAST = 0.8
#: Public licence texts and the notices by which they are commonly applied.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    """Python's form of the normalisation, for the templates."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isalnum() else " " for c in low).split()


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a text, in order of code points."""
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def probes(templates, least: float = LEAST) -> list[str]:
    """Bigrams of which every passage that reaches least with some template has one: of each template
    as many as that takes, those with the longest words first, as these are the rarest in other texts.
    """
    out: set[str] = set()
    for _, t in templates:
        own = bigrams_of(t)
        need = ceil(least / (2 - least) * len(own) - 1e-9)
        out.update(sorted(own, key=lambda b: (-max(map(len, b.split())), b))[: len(own) - need + 1])
    return sorted(out)


def looked_for(found: list[str]) -> tuple[list[str], str]:
    """Beginnings of words and a pattern of which every text with one of the bigrams has one: words of at
    least four letters that few of them cover all bigrams, and a pattern for bigrams of shorter words.
    """
    left = [b for b in found if max(map(len, b.split())) >= 4]
    short = [r"[^\p{L}\p{N}]+".join(b.split()) for b in found if b not in left]
    words = []
    while left:
        cover = Counter(w[:6] for b in left for w in {x for x in b.split() if len(x) >= 4})
        best = max(cover, key=lambda w: (cover[w], len(w), w))
        words.append(best)
        left = [b for b in left if not any(w.startswith(best) for w in b.split())]
    return words, "|".join(short)


RUNS = r"\n[ \t\r]*(?:\n[ \t\r]*)+"


def passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, kind, nth, passage, whole): lines, runs of several lines, whole documents of several lines; whole: the passage is all of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = F.split(text, RUNS)
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("nth"), x.alias("passage")))
    blocks = F.filter(F.transform(runs, lambda x, i: F.struct(F.lit("block").alias("kind"), i.alias("nth"), x.alias("passage"))), lambda s: F.contains(s["passage"], F.lit("\n")) & (F.size(runs) > 1))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(F.struct(F.lit("document").alias("kind"), F.lit(0).alias("nth"), text.alias("passage")))).otherwise(F.array().cast("array<struct<kind:string,nth:int,passage:string>>"))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.concat(lines, blocks, whole)).alias("p"), (~F.contains(text, F.lit("\n"))).alias("one")).select("doc_id", "p.kind", "p.nth", "p.passage", (F.col("one") | (F.col("p.kind") == "document")).alias("whole"))


def words_in(text):
    """Spark's form of the normalisation; a text without words has one empty word."""
    return F.split(F.trim(F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def pairs_in(w):
    """The bigrams of an array of two words or more, in their order."""
    return F.transform(F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w) - 1).alias("b")), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))


def hits_in(g, templates, bigrams: list[list[str]], least: float):
    """(licence, template, dice) of the templates that an array of distinct bigrams reaches least with."""
    made = []
    for k, ((licence, _), b) in enumerate(zip(templates, bigrams, strict=True)):
        if b:
            low, high = len(b) * least / (2 - least), len(b) * (2 - least) / least
            common = F.size(F.array_intersect(g, F.array(*(F.lit(x) for x in b))))
            dice = F.when((F.size(g) >= low - 1e-9) & (F.size(g) <= high + 1e-9), 2.0 * common / (F.size(g) + F.lit(len(b))))
            made.append(F.struct(F.lit(licence).alias("licence"), F.lit(k).alias("template"), dice.alias("dice")))
    return F.filter(F.array(*made), lambda s: s["dice"] >= least)


def _let(value, use):
    """use(value), evaluating value once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


WINDOW = "array<struct<licence:string,template:int,dice:double,first:int,last:int>>"


def windows_in(s, own, template: int, licence: str, text: str, least: float):
    """The best windows of a text for one template that do not overlap: first and last are places of bigrams.

    s: the text's bigrams; own: (x, i), those of them that some template has, with their places. From
    each of the template's bigrams windows reach as far as the bound on Dice allows; of windows that
    overlap the one with the largest Dice stays, then the first.
    """
    b = bigrams_of(text)
    need = ceil(least / (2 - least) * len(b) - 1e-9)
    reach = int((len(words_of(text)) - 1) * (2 - least) / least + 1e-9)

    def from_start(p, reached):
        def to(m):
            last = F.get(reached, m - 1)["i"]
            common = F.size(F.array_distinct(F.transform(F.slice(reached, F.lit(1), m), lambda x: x["x"])))
            size = F.size(F.array_distinct(F.slice(s, p["i"] + 1, last - p["i"] + 1)))
            return F.struct((2.0 * common / (size + len(b))).alias("dice"), (-p["i"]).alias("back"), (-last).alias("end"))

        enough = F.size(F.array_distinct(F.transform(reached, lambda x: x["x"]))) >= need
        return F.when(enough, F.array_max(F.transform(F.sequence(F.lit(need), F.size(reached)), to)))

    def found(o):
        starts = F.transform(o, lambda p, k: _let(F.filter(F.slice(o, k + 1, F.lit(reach)), lambda e: e["i"] - p["i"] < reach), lambda reached: from_start(p, reached)))
        ordered = F.sort_array(F.filter(starts, lambda x: x["dice"] >= least), asc=False)
        made = F.transform(ordered, lambda x: F.struct(F.lit(licence).alias("licence"), F.lit(template).alias("template"), x["dice"].alias("dice"), (-x["back"]).alias("first"), (-x["end"]).alias("last")))
        apart = F.aggregate(made, F.array().cast(WINDOW), lambda kept, x: F.when(F.exists(kept, lambda y: (y["first"] <= x["last"] + 1) & (x["first"] <= y["last"] + 1)), kept).otherwise(F.concat(kept, F.array(x))))
        return F.when(F.size(o) >= need, apart).otherwise(F.array().cast(WINDOW))

    return _let(F.filter(own, lambda h: h["x"].isin(b)), found)


def reported(text, pattern: str, templates, bigrams: list[list[str]], least: float):
    """(first, last, licences) of the parts of a text that reach least with some template; first and last are places of words."""
    parts = F.transform(F.split(text, pattern), lambda x: _let(words_in(x), lambda w: F.filter(w, lambda y: y != "")))
    blank = F.array().cast("array<struct<at:int,w:array<string>>>")
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("n"), blank.alias("ps")), lambda acc, w: F.struct((acc["n"] + F.size(w)).alias("n"), F.when(F.size(w) > 1, F.concat(acc["ps"], F.array(F.struct(acc["n"].alias("at"), w.alias("w"))))).otherwise(acc["ps"]).alias("ps")))["ps"]
    told = F.transform(placed, lambda p: F.struct(p["at"].alias("first"), (p["at"] + F.size(p["w"]) - 1).alias("last"), _let(F.array_distinct(pairs_in(p["w"])), lambda g: F.transform(hits_in(g, templates, bigrams, least), lambda h: h["licence"])).alias("licences")))
    return F.filter(told, lambda t: F.size(t["licences"]) > 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, kind, nth, licence, template, dice): each passage with each template it reaches least with.

    kind and nth say which passage (line, block or document, counted from 0; for a window nth is the
    number of words before it), template which of the templates. Windows within a line that is reported,
    or within a block or document that is reported with the same licence, are left to these. Null and
    empty texts and passages of less than two words match nothing; repeated rows give repeated matches;
    templates of less than two words are not looked for. Nothing is shuffled.
    """
    bigrams = [bigrams_of(t) for _, t in templates]
    longest = max(map(len, bigrams)) * (2 - least) / least
    probed = probes(templates, least)
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words, pattern = looked_for(probed)
    seen = low.rlike(pattern) if pattern else F.lit(False)
    for word in words:
        seen = seen | F.contains(low, F.lit(word))
    own = passages(docs.filter(seen), id_col, text_col).withColumn("w", words_in(F.col("passage")))
    own = own.filter(F.size("w") > 1)
    probe = F.array(*(F.lit(b) for b in probed))
    own = own.withColumn("s", pairs_in(F.col("w"))).filter(F.arrays_overlap("s", probe)).withColumn("g", F.array_distinct("s")).filter("size(g) <= {} or whole".format(longest))
    own = own.withColumn("hits", hits_in(F.col("g"), templates, bigrams, least))
    every = sorted({x for b in bigrams for x in b})
    placed = F.filter(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(every))
    none = F.array().cast(WINDOW)
    own = own.withColumn("h", F.when(F.col("whole"), placed))
    each = [windows_in(F.col("s"), F.col("h"), k, name, t, least) for k, ((name, t), b) in enumerate(zip(templates, bigrams, strict=True)) if b]
    own = own.withColumn("v", F.when(F.col("whole"), F.concat(*each)).otherwise(none))
    # Only texts with windows are looked through for the lines and blocks that are reported anyway.
    any_ = F.size("v") > 0
    own = own.withColumn("lines", F.when(any_, reported(F.col("passage"), "\n", templates, bigrams, least))).withColumn("runs", F.when(any_, reported(F.col("passage"), RUNS, templates, bigrams, least)))

    def within(v, t):
        return (t["first"] <= v["first"]) & (v["last"] + 1 <= t["last"])

    def new(v):
        by_line = F.exists("lines", lambda t: within(v, t))
        by_run = F.exists("runs", lambda t: within(v, t) & F.array_contains(t["licences"], v["licence"]))
        return ~(by_line | by_run | F.exists("hits", lambda h: h["licence"] == v["licence"]))

    fixed = F.transform("hits", lambda h: F.struct(F.col("kind").alias("kind"), F.col("nth").alias("nth"), h["licence"].alias("licence"), h["template"].alias("template"), h["dice"].alias("dice")))
    free = F.when(any_, F.transform(F.filter("v", new), lambda v: F.struct(F.lit("window").alias("kind"), v["first"].alias("nth"), v["licence"].alias("licence"), v["template"].alias("template"), v["dice"].alias("dice")))).otherwise(F.array().cast("array<struct<kind:string,nth:int,licence:string,template:int,dice:double>>"))
    return own.select("doc_id", F.explode(F.concat(fixed, free)).alias("hit")).select("doc_id", "hit.kind", "hit.nth", "hit.licence", "hit.template", "hit.dice")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for op8_licences: every passage against every template."""
    quoted = ", ".join(f"({k}, '{name}', [{', '.join(chr(39) + b + chr(39) for b in bigrams_of(t))}])" for k, (name, t) in enumerate(TEMPLATES))
    return rf"""
WITH t(template, licence, b) AS (VALUES {quoted}),
x AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\n[ \t\r]*(?:\n[ \t\r]*)+') AS runs FROM x),
p AS (
  SELECT doc_id, 'line' AS kind, unnest(generate_series(0, len(lines) - 1)) AS nth, unnest(lines) AS passage FROM l
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'block' AS kind, unnest(generate_series(0, len(runs) - 1)) AS nth, unnest(runs) AS passage FROM l WHERE len(runs) > 1) WHERE contains(passage, chr(10))
  UNION ALL
  SELECT doc_id, 'document', 0, text FROM l WHERE contains(text, chr(10))
), w AS (
  SELECT doc_id, kind, nth, string_split(trim(regexp_replace(translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\pL\pN]+', ' ', 'g')), ' ') AS w FROM p
), g AS (
  SELECT doc_id, kind, nth, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
), d AS (
  SELECT doc_id, kind, nth, licence, template, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice
  FROM g JOIN t ON len(g) BETWEEN len(b) * {LEAST} / (2 - {LEAST}) - 1e-9 AND len(b) * (2 - {LEAST}) / {LEAST} + 1e-9
)
SELECT doc_id, kind, CAST(nth AS INTEGER) AS nth, licence, CAST(template AS INTEGER) AS template, dice FROM d WHERE dice >= {LEAST}
"""
