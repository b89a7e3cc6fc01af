r"""Licence scan: units of text against licence templates by the Dice coefficient over word bigrams.

A document's units are its whole text, its paragraphs (between blank lines) and its lines.
Text is normalised to lower-case words of letters a-z and digits. Dice is twice the common
bigrams over the bigrams of both, sets on either side. It can only reach the threshold t if
the smaller set has t / (2 - t) of the larger one's size, so each unit meets only the
templates within those bounds. The templates are a literal of the plan: each unit is
compared where it is read, and nothing is shuffled but the result per document.

A licence inside longer text, in running prose or over several paragraphs, is no unit. So the words of the whole text
are searched too: a window as long as the template starts at every word where one of the template's bigrams does,
whatever the line or paragraph, for the templates of whose bigrams the text holds enough for a window to reach the threshold.
Of windows that start at one word the template that is most like its window counts.

Cases: null and empty texts match nothing; a text of one word has no bigram and matches
nothing; a unit counts for the template that it is most like, of equals the first by id; repeated rows give equal
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence texts and the notices that stand for them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
     "specific language governing permissions and limitations under the License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
     "the distribution."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
     "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[tuple[str, str]]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted(set(zip(words, words[1:], strict=False)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _bigrams(words: str) -> Column:
    """Distinct hashed bigrams of two words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2),
                                        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))


def match_units(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
                id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, license, dice): the best template of every unit that reaches the threshold with one."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = F.array(*[
        F.struct(F.lit(name).alias("id"), F.lit(len(b)).alias("n"),
                 F.array(*[F.xxhash64(F.lit(x), F.lit(y)) for x, y in b]).alias("grams"))
        for name, text in templates if (b := template_bigrams(text))])
    smallest = min(len(template_bigrams(t)) for _, t in templates if template_bigrams(t))
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[\x20\x09-\x0D]*\n"), F.split("text", "\n")))
    # explode_outer and no filter before the last step: both would be pushed down and repeat the splits
    u = (docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_hash"), F.explode_outer(units).alias("unit"))
         .select("id", "text_hash", _words(F.col("unit")).alias("_w"))
         .select("id", "text_hash", F.when(F.size("_w") - 1 >= max(1, low * smallest), _bigrams("_w")).alias("grams"))
         .withColumn("n", F.size("grams")))
    fits = F.filter(known, lambda t: (t["n"] >= low * F.col("n")) & (t["n"] <= high * F.col("n")))
    scored = F.transform(fits, lambda t: F.struct(
        (F.lit(-2.0) * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (F.col("n") + t["n"])).alias("d"),
        t["id"].alias("license")))
    best = F.when(F.col("grams").isNotNull(), F.filter(F.array(F.array_min(scored)), lambda s: s["d"] <= -threshold))
    return (u.select("id", "text_hash", F.explode_outer(best).alias("s")).where("s IS NOT NULL")
            .select(F.col("id").alias(id_col), "text_hash", "s.license", (-F.col("s.d")).alias("dice")))


def match_windows(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
                  id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, license, dice): the best template of every window of words that reaches the threshold with one."""
    low = threshold / (2 - threshold)
    known = F.array(*[
        F.struct(F.lit(name).alias("id"), F.lit(len(b)).alias("n"), F.lit(len(re.findall("[a-z0-9]+", text.lower()))).alias("long"),
                 F.array(*[F.xxhash64(F.lit(x), F.lit(y)) for x, y in b]).alias("grams"))
        for name, text in templates if (b := template_bigrams(text))])
    # a window with the threshold has ``low`` of the template's bigrams, so the text has
    held = F.filter(known, lambda t: F.size(F.array_intersect(F.col("grams"), t["grams"])) >= t["n"] * low - 1e-9)
    w = (docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("_w"))
         .select("id", "text_hash", "_w", F.when(F.size("_w") > 1, _bigrams("_w")).alias("grams"))
         .select("id", "text_hash", "_w", F.explode_outer(F.when(F.col("grams").isNotNull(), held)).alias("t")).where("t IS NOT NULL"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 2),
                      lambda i: F.array_contains(F.col("t.grams"), F.xxhash64(F.get("_w", i), F.get("_w", i + 1))))
    windows = F.transform(starts, lambda i: F.struct(i.alias("p"), F.slice("_w", i + 1, F.col("t.long")).alias("words")))
    each = (w.select("id", "text_hash", "t", F.explode_outer(windows).alias("x"))
            .select("id", "text_hash", "t", "x.p", F.col("x.words").alias("_w"))
            .select("id", "text_hash", "t", "p", _bigrams("_w").alias("grams")))
    dice = F.lit(2.0) * F.size(F.array_intersect("grams", "t.grams")) / (F.size("grams") + F.col("t.n"))
    scored = each.select("id", "text_hash", "p", F.struct((-dice).alias("d"), F.col("t.id").alias("license")).alias("s")).where(F.col("s.d") <= -threshold)
    best = scored.groupBy("id", "text_hash", "p").agg(F.min("s").alias("s"))
    return best.select(F.col("id").alias(id_col), "text_hash", "s.license", (-F.col("s.d")).alias("dice"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, licenses (sorted ids), best license and its dice (null without a match)."""
    both = match_units(docs, templates, threshold).unionByName(match_windows(docs, templates, threshold))
    best = both.groupBy("doc_id", "text_hash", "license").agg(F.max("dice").alias("dice"))
    found = best.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list("license")).alias("licenses"),
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "licenses", "best")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return (base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
            .select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
                    F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice")))


def _oracle() -> str:
    rows = ", ".join(f"({i}, '{name}', {len(re.findall('[a-z0-9]+', text.lower()))}, "
                     f"[{', '.join(repr(' '.join(b)) for b in template_bigrams(text))}])" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH t(k, id, long, g) AS (VALUES {rows}),
u AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n'),
                                                   string_split(text, chr(10))))) AS unit
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM u
), g AS (
  SELECT doc_id, row_number() OVER () AS u, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM w WHERE len(w) > 1
), s AS (
  SELECT doc_id, u, id, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
  FROM g JOIN t ON len(g.g) * {THRESHOLD / (2 - THRESHOLD)!r} <= len(t.g) + 0.001
               AND len(t.g) <= len(g.g) * {(2 - THRESHOLD) / THRESHOLD!r} + 0.001
), best AS (
  SELECT doc_id, u, first(id ORDER BY dice DESC, id) AS id, max(dice) AS dice FROM s WHERE dice >= {THRESHOLD} GROUP BY 1, 2
), dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
), dg AS (
  SELECT doc_id, w, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM dw WHERE len(w) > 1
), held AS (
  SELECT doc_id, w, k, id, long, t.g FROM dg JOIN t ON len(list_intersect(dg.g, t.g)) >= len(t.g) * {THRESHOLD / (2 - THRESHOLD)!r} - 1e-9
), hit AS (
  SELECT * FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS p FROM held) WHERE list_contains(g, w[p] || ' ' || w[p + 1])
), win AS (
  SELECT doc_id, k, id, g, p, list_distinct(list_transform(generate_series(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1])) AS x
  FROM (SELECT *, w[p:p + long - 1] AS v FROM hit)
), ws AS (
  SELECT doc_id, p, id, 2.0::DOUBLE * len(list_intersect(x, g)) / (len(x) + len(g)) AS dice FROM win
), wb AS (
  SELECT doc_id, p, first(id ORDER BY dice DESC, id) AS id, max(dice) AS dice FROM ws WHERE dice >= {THRESHOLD} GROUP BY 1, 2
), b AS (
  SELECT doc_id, id, max(dice) AS dice FROM (SELECT doc_id, id, dice FROM best UNION ALL SELECT doc_id, id, dice FROM wb) GROUP BY 1, 2
), f AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY id) AS licenses, first(id ORDER BY dice DESC, id) AS license, max(dice) AS dice
  FROM b GROUP BY 1
)
SELECT doc_id, coalesce(licenses, '') AS licenses, license, dice FROM documents LEFT JOIN f USING (doc_id)
"""


ORACLE_SQL = _oracle()
