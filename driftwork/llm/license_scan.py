"""License scan: lines, whole texts and passages against licence templates by the Dice coefficient over word bigrams, in SQL functions only.

A text is put in lower case (A-Z), everything but a-z, 0-9 and line ends becomes a blank, and its lines, and the whole text where it has
several, are sets of distinct bigrams of words. A template is a candidate only for sets whose size lies within the bounds that its own
size and the threshold allow: t/(2-t) to (2-t)/t of it. All happens within the row: nothing is shuffled or exploded.

Passages find a notice that is wrapped within a longer text or stands inside a longer line. They are runs of consecutive lines within the
same bounds, and runs of words from every start that have at least the template's number of distinct bigrams (a shorter one would only
leave out the words that differ); both have at most (2-t)/t times the template's bigrams, repeats counted. Only texts that hold
t/(2-t) of a template's bigrams are searched for it, since no passage of another can match.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known public licence notices and short licence texts, by SPDX-like name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pairs(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _bigrams(text: str) -> list[str]:
    return sorted(set(_pairs(text)))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _adjacent(words: Column) -> Column:
    """The bigrams of a list of words, in its order, repeats included."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once, since a lambda's argument is."""
    return F.transform(F.array(value), use)[0]


def _passages(lines: Column, x: Column, t: float) -> Column:
    """(start, end, dice) of passages that match the template x, by places of bigrams: every run of lines, and the shortest run of words from each start."""

    def of(lined: Column, gram: Column) -> Column:
        # a bigram of the template has a mark
        marked = F.transform(gram, lambda g: F.when(F.array_contains(x["grams"], g), F.concat(F.lit("*"), g)).otherwise(g))
        ends = F.aggregate(lined, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.size(w))))

        def run(g: Column, start: Column, n: Column) -> Column:
            common = F.size(F.filter(g, lambda v: v.startswith("*")))
            return F.struct(start.alias("start"), (start + n - 1).alias("end"), (2.0 * common / (F.size(g) + x["n"])).alias("dice"))

        def runs(b: Column, ends: Column) -> Column:
            reach = F.transform(ends, lambda s, a: F.transform(F.filter(F.slice(ends, a + 2, x["span"] + 1), lambda e: (e - s - 1).between(x["least"], x["span"])), lambda e: F.struct((s + 1).alias("start"), (e - s - 1).alias("n"))))
            return F.transform(F.flatten(reach), lambda r: _bound(F.array_distinct(F.slice(b, r["start"], r["n"])), lambda g: run(g, r["start"], r["n"])))

        def windows(b: Column) -> Column:
            # a start at another bigram is no better than the next one, except where the text ends
            starts = F.filter(F.transform(b, lambda g, k: F.when(g.startswith("*") | (k >= F.size(b) - x["span"]), k + 1)), lambda k: k.isNotNull())
            return F.flatten(F.transform(starts, lambda k: _bound(F.slice(b, k, x["span"]), lambda part: _bound(F.array_distinct(part), lambda d: window(k, part, d)))))

        def window(k: Column, part: Column, d: Column) -> Column:
            # the distinct bigrams of the words up to any end are the first ones of d
            places = F.filter(F.transform(d, lambda g, p: F.when(g.startswith("*"), p + 1)), lambda p: p.isNotNull())
            scored = F.transform(F.when(F.size(d) >= x["n"], places).otherwise(F.slice(places, 1, 0)), lambda p, r: F.struct((2.0 * (r + 1) / (F.greatest(p, x["n"]) + x["n"])).alias("dice"), F.greatest(p, x["n"]).alias("m")))
            fit = F.filter(scored, lambda v: v["dice"] >= t - 1e-12)
            return F.transform(F.slice(fit, 1, 1), lambda v: F.struct(k.alias("start"), (k - 1 + F.array_position(part, F.element_at(d, v["m"])).cast("int")).alias("end"), F.array_max(F.transform(fit, lambda u: u["dice"])).alias("dice")))

        found = _bound(marked, lambda b: F.concat(_bound(ends, lambda e: runs(b, e)), windows(b)))
        return F.array_sort(F.filter(found, lambda v: v["dice"] >= t - 1e-12))

    return _bound(F.filter(F.transform(lines, _words), lambda w: F.size(w) > 0), lambda lined: of(lined, _adjacent(F.flatten(lined))))


def _apart(found: Column) -> Column:
    """The most passages (sorted by start) of which no two overlap."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    return F.aggregate(found, none, lambda a, v: F.when(v["start"] > a["last"], F.struct((a["n"] + 1).alias("n"), v["end"].alias("last"))).otherwise(F.struct(a["n"].alias("n"), F.least(a["last"], v["end"]).alias("last"))), lambda a: a["n"])


def license_scan(docs: DataFrame, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_units (lines, or the whole text, that match, and further passages), licenses (distinct names, sorted), best_dice.

    Every template within the threshold counts for its unit. Further passages are, for each template, those that can lie apart from
    each other beyond the number of lines and whole texts that match it. Null and empty texts, and units of fewer than two words, match nothing: 0 units,
    an empty array, 0.0. Repeated rows give a row each; other columns are not read; an empty table gives no row.
    """
    t = Fraction(threshold)
    rows = []
    for name, text in TEMPLATES.items():
        grams = _bigrams(text)
        least, most = t / (2 - t) * len(grams), (2 - t) / t * len(grams)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(-(-least.numerator // least.denominator)).alias("least"), F.lit(int(most)).alias("most"), F.lit(len(grams)).alias("n"), F.lit(int((2 - t) / t * len(_pairs(text)))).alias("span"), F.array(*map(F.lit, grams)).alias("grams")))
    templates = F.array(*rows)
    smallest = min(-(-(t / (2 - t) * len(_bigrams(x))).numerator // (t / (2 - t) * len(_bigrams(x))).denominator) for x in TEMPLATES.values())

    every = F.array(*map(F.lit, sorted({g for x in TEMPLATES.values() for g in _bigrams(x)})))

    def grams(line: Column) -> Column:
        return _bound(_words(line), lambda w: F.array_distinct(_adjacent(w)))

    def found(gram: Column) -> Column:
        fits = F.filter(templates, lambda x: F.size(gram).between(x["least"], x["most"]))
        scored = F.transform(fits, lambda x: F.struct(x["name"].alias("name"), (2.0 * F.size(F.array_intersect(gram, x["grams"])) / (F.size(gram) + x["n"])).alias("dice")))
        return F.filter(scored, lambda x: x["dice"] >= float(t) - 1e-12)

    plain = F.regexp_replace(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER), "[^a-z0-9\n]+", " ")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(plain, "\n").alias("lines"))
    units = F.when(F.size("lines") > 1, F.concat("lines", F.array(F.array_join("lines", " ")))).otherwise(F.col("lines"))
    base = base.select("doc_id", "lines", F.transform(units, grams).alias("units"))
    near = _bound(F.array_intersect(F.element_at("units", -1), every), lambda g: F.filter(templates, lambda x: F.size(F.array_intersect(g, x["grams"])) >= x["least"]))
    base = base.select("doc_id", "lines", near.alias("near"), F.filter(F.transform(F.filter("units", lambda g: F.size(g) >= smallest), found), lambda m: F.size(m) > 0).alias("hits"))

    def searched(x: Column) -> Column:
        units = F.size(F.filter("hits", lambda u: F.exists(u, lambda m: m["name"] == x["name"])))
        return _bound(_passages(F.col("lines"), x, float(t)), lambda v: F.struct(x["name"].alias("name"), F.array_max(F.transform(v, lambda p: p["dice"])).alias("dice"), F.greatest(_apart(v) - units, F.lit(0)).alias("more")))

    base = base.select("doc_id", "hits", F.filter(F.transform("near", searched), lambda m: m["dice"].isNotNull()).alias("passages"))
    names = F.concat(F.transform(F.flatten("hits"), lambda m: m["name"]), F.transform("passages", lambda m: m["name"]))
    dice = F.concat(F.transform(F.flatten("hits"), lambda m: m["dice"]), F.transform("passages", lambda m: m["dice"]))
    return base.select(
        "doc_id",
        (F.size("hits") + F.aggregate("passages", F.lit(0), lambda a, m: a + m["more"])).cast("long").alias("n_units"),
        F.array_sort(F.array_distinct(names)).alias("licenses"),
        F.coalesce(F.array_max(dice), F.lit(0.0)).alias("best_dice"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Lines and whole texts by unnesting, without further passages, over the view documents; for ids that do not repeat.
ORACLE = f"""
WITH template(name, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
unit AS (
  SELECT 'd' AS kind, doc_id, NULL AS name, unnest(CASE WHEN len(l) > 1 THEN list_append(l, array_to_string(l, ' ')) ELSE l END) AS u
  FROM (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9' || chr(10) || ']+', ' ', 'g'), chr(10)) AS l FROM documents)
  UNION ALL
  SELECT 't', NULL, name, regexp_replace(translate(body, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g') FROM template
),
worded AS (SELECT kind, doc_id, name, list_filter(string_split(u, ' '), lambda x: x <> '') AS w FROM unit),
gram AS (SELECT kind, doc_id, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
hit AS (
  SELECT d.doc_id, d.g AS unit, d.rid, t.name, 2.0::DOUBLE * len(list_intersect(d.g, t.g)) / (len(d.g) + len(t.g)) AS dice
  FROM (SELECT *, row_number() OVER () AS rid FROM gram WHERE kind = 'd') d
  JOIN (SELECT * FROM gram WHERE kind = 't') t ON len(d.g) BETWEEN 0.5 * len(t.g) AND 2 * len(t.g)
)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(licenses, '') AS licenses, coalesce(best_dice, 0.0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN (
  SELECT doc_id, count(DISTINCT rid) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice
  FROM hit WHERE dice >= 0.8 - 1e-12 GROUP BY doc_id
) h USING (doc_id)
"""
