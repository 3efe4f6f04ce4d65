"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame functions only.

The units of a text are its lines, its paragraphs (between blank lines) and the whole of it, each once. A unit is
normalised (A-Z lower-cased, everything but a-z and 0-9 a space) and becomes its set of word bigrams. A template of n
bigrams can reach a Dice coefficient of d only with units of d / (2 - d) * n to (2 - d) / d * n bigrams, so units outside
all bounds go first, then those that share too few bigrams with all templates together, and a template is compared only
with units within its own bounds. A unit counts for the template that it is most like.

Edge cases: null and empty texts, and units of under two words, match nothing; rows of one doc_id count together; a null
doc_id is a group of its own; ties keep every template; empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, table

#: Short public licence notices, in the words that their owners recommend.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
MIN_DICE = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text; fewer than two words: none."""
    pairs = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(F.split(text, " ")), pairs), 1)


def template_bigrams(text: str) -> list[str]:
    w = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def units(text: Column) -> Column:
    """Lines, paragraphs and the whole of a text, each once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))


def licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, license, n_units (how many units match), dice (the best) for each licence found in docs (doc_id, text)."""
    sets = {name: template_bigrams(t) for name, t in templates.items()}
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    smallest, largest = min(map(len, sets.values())), max(map(len, sets.values()))
    every = F.array(*[F.lit(b) for b in sorted(set().union(*sets.values()))])
    own = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(units(F.col("text"))).alias("unit")).select("doc_id", normalised(F.col("unit")).alias("unit"))
    # repeated bigrams make a set smaller than the words suggest, so the words give an upper bound only
    spaces = F.length("unit") - F.length(F.translate("unit", " ", ""))
    own = own.where(spaces >= low * smallest).select("doc_id", bigrams(F.col("unit")).alias("bigrams"))
    own = own.where((F.size("bigrams") >= low * smallest) & (F.size("bigrams") <= high * largest))
    own = own.select("doc_id", F.size("bigrams").alias("n"), F.array_intersect("bigrams", every).alias("shared"))
    own = own.where(2 * F.size("shared") >= min_dice * (F.col("n") + smallest))

    def compared(name: str, b: list[str]) -> Column:
        both = F.size(F.array_intersect("shared", F.array(*[F.lit(x) for x in b])))
        inside = (F.col("n") >= low * len(b)) & (F.col("n") <= high * len(b))
        return F.struct(F.lit(name).alias("license"), F.when(inside, 2.0 * both / (F.col("n") + len(b))).otherwise(0.0).alias("dice"))

    own = own.select("doc_id", F.array(*[compared(n, b) for n, b in sets.items()]).alias("all"))
    own = own.withColumn("best", F.array_max(F.transform("all", lambda h: h["dice"]))).where(F.col("best") >= min_dice)
    hits = own.select("doc_id", F.explode(F.filter("all", lambda h: h["dice"] == F.col("best"))).alias("h"))
    return hits.groupBy("doc_id", F.col("h.license").alias("license")).agg(F.count("*").alias("n_units"), F.round(F.max("h.dice"), 6).alias("dice"))


#: What ``notices`` looks for besides.
NOTICES = TEMPLATES | {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD short": "Released under the BSD License.",
    "BSD short licensed": "Licensed under the BSD License.",
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause short": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0-or-later header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT short licensed": "Licensed under the MIT License.",
    "MIT short project": "This project is licensed under the MIT License.",
    "MIT short released": "This project is released under the MIT License.",
}
#: Where a run may begin or end: lines, sentences and their parts.
CUTS = r"\n|(?<=[.!?;:,)])\s+|\s+(?=\()"


def notices(docs: DataFrame, templates: dict[str, str] = NOTICES, min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, license, n_units, dice as ``licences``, where the units are all runs of consecutive parts of a text (see
    ``CUTS``; empty parts do not count) of at most (2 - d) / d times a template's words. Of runs that overlap, the one most
    like its template counts, of equal ones the longest.

    A run shares d / (2 - d) of a template's bigrams at least, and so must the whole text: only such pairs of text and template
    are cut into runs.
    """
    sets = {name: template_bigrams(t) for name, t in templates.items()}
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    every = F.array(*[F.lit(b) for b in sorted(set().union(*sets.values()))])
    size = lambda t: len("".join(c if c.isascii() and c.isalnum() else " " for c in t).split())
    each = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*[F.lit(x) for x in b]).alias("b"), F.lit(int(high * size(templates[n]))).alias("most")) for n, b in sets.items()])
    own = docs.where(F.col("text").isNotNull()).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    own = own.withColumn("shared", F.array_intersect(bigrams(normalised(F.col("text"))), every)).where(F.size("shared") >= low * min(map(len, sets.values())))
    own = own.withColumn("t", F.explode(F.filter(each, lambda t: F.size(F.array_intersect("shared", t["b"])) >= low * F.size(t["b"]))))
    own = own.withColumn("parts", F.filter(F.transform(F.split("text", CUTS), normalised), lambda p: p != "")).select("doc_id", "row", "t", "parts", F.transform("parts", lambda p: F.size(F.split(p, " "))).alias("words"))
    own = own.select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("start"))
    # every part has a word, so no run within the bounds has more parts than words
    ends = F.sequence("start", F.least(F.size("parts"), F.col("start") + F.col("t.most")))
    fits = lambda e: F.aggregate(F.slice("words", F.col("start"), e - F.col("start") + 1), F.lit(0), lambda a, w: a + w).between(low * F.size("t.b") + 1, F.col("t.most"))
    own = own.select("doc_id", "row", "t", "parts", "start", F.explode(F.filter(ends, fits)).alias("end"))
    own = own.withColumn("u", bigrams(F.array_join(F.slice("parts", F.col("start"), F.col("end") - F.col("start") + 1), " ")))
    own = own.withColumn("dice", 2.0 * F.size(F.array_intersect("u", "t.b")) / (F.size("u") + F.size("t.b"))).where(F.col("dice") >= min_dice)
    run = F.struct((-F.col("dice")).alias("d"), (F.col("start") - F.col("end")).alias("n"), "start", "end", F.col("t.license").alias("license"))
    runs = own.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    same = lambda a, b: (a["d"] == b["d"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])
    apart = lambda a, b: (a["end"] < b["start"]) | (b["end"] < a["start"])
    none = F.array().cast(runs.schema["runs"].dataType)
    best = F.aggregate("runs", none, lambda acc, r: F.when(F.forall(acc, lambda a: apart(a, r) | same(a, r)), F.concat(acc, F.array(r))).otherwise(acc))
    hits = runs.select("doc_id", F.explode(best).alias("h"))
    return hits.groupBy("doc_id", F.col("h.license").alias("license")).agg(F.count("*").alias("n_units"), F.round(F.max(-F.col("h.d")), 6).alias("dice"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, min_dice: float = MIN_DICE) -> str:
    """The same in DuckDB SQL, without any pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, template_bigrams(t)))}])" for n, t in templates.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH templates(license, tb) AS (VALUES {rows}),
units AS (
  SELECT doc_id, text, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), [text]))) AS unit
  FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, unit, text, string_split(trim(regexp_replace(translate(unit, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
sets AS (SELECT doc_id, unit, text, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM split WHERE len(w) > 1),
scored AS (SELECT doc_id, unit, text, license, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM sets, templates WHERE len(b) <= 3 * len(tb) AND len(tb) <= 3 * len(b))
SELECT doc_id, license, count(*) AS n_units, round(max(CAST(dice AS DOUBLE)), 6) AS dice
FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, text, unit) AS best FROM scored) WHERE dice >= {min_dice} AND dice = best GROUP BY doc_id, license
"""


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op10_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents"))
