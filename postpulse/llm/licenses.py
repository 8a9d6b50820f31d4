"""Licence notices in documents: Dice coefficient over word bigrams, in DataFrame functions.

A document is cut into units: its lines, its paragraphs and its whole text.  A unit with n
bigrams can only reach Dice t with templates of n t/(2-t) to n (2-t)/t bigrams, so most units
are dropped, and most templates pruned, by size before a bigram is made.

Notices inside longer units, and complete licence texts, are compared by windows of a template's
size that begin where one of its anchors says.  A text within reach of a template has one of any
``(1 - t/(2-t)) n + 1`` of its bigrams; so many rare ones are its anchors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import ascii_lower, columns_of

#: A unit carries a licence from this Dice coefficient on.
THRESHOLD = 0.85
#: Templates are broadcast; a larger collection is refused, not cut.
MOST_TEMPLATE_BIGRAMS = 200_000

# Usual short notices and texts of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
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
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Complete texts, one file each; what a licence says before its first sentence of terms may differ.
COMPLETE: tuple[tuple[str, str], ...] = tuple(
    (p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
)

# Words that are in most texts; an anchor has as few of them as can be.
_COMMON = frozenset("a all an and any are as at be by can for from has have in is it its may not of on or other such that the this to was which will with you your".split())

_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\W_]+", lowered)


def template_bigrams(templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, str, int, int]]:
    """(number, licence, bigram, times, bigrams of the template)."""
    rows = []
    for number, (licence, text) in enumerate(templates):
        words = template_words(text)
        bag = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        rows += [(number, licence, b, n, len(words) - 1) for b, n in bag.items()]
    if len(rows) > MOST_TEMPLATE_BIGRAMS:
        raise ValueError(f"{len(rows)} template bigrams; at most {MOST_TEMPLATE_BIGRAMS} can be broadcast")
    return rows


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(
        template_bigrams(templates), "template int, licence string, bigram string, times bigint, t_size bigint"
    )


def template_anchors(templates: Sequence[tuple[str, str]], threshold: float) -> list[tuple[str, int, int, int, str]]:
    """(bigram, number of the template, position in it, bigrams of the template, rarer word)."""
    rows = []
    for number, (_, text) in enumerate(templates):
        words = template_words(text)
        pairs = list(zip(words, words[1:], strict=False))
        rarity = lambda p: (sum(w in _COMMON for w in p), -max(map(len, p)), p)
        missing = int((1 - threshold / (2 - threshold)) * len(pairs) + 1e-9)
        chosen = set(sorted(set(pairs), key=rarity)[: missing + 1])
        rows += [
            (f"{a} {b}", number, at, len(pairs), max((a, b), key=lambda w: (w not in _COMMON, len(w), w)))
            for at, (a, b) in enumerate(pairs) if (a, b) in chosen
        ]
    return rows


def _bigrams(words: Column, size: Column) -> Column:
    return F.zip_with(
        F.slice(words, F.lit(1), size.cast("int")), F.slice(words, F.lit(2), size.cast("int")), lambda a, b: F.concat_ws(" ", a, b)
    )


def windows(narrow: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(id, row, unit, template, size, words): runs of words of each text that begin where an
    anchor of the template says and have its size, or less where the text is shorter."""
    anchors = template_anchors(templates, threshold)
    known = F.broadcast(narrow.sparkSession.createDataFrame(
        [a[:4] for a in anchors], "bigram string, template int, offset int, t_size int"
    ))
    rarer = F.array(*[F.lit(w) for w in sorted({a[4] for a in anchors})])
    plain = F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    texts = (
        narrow.select("id", F.monotonically_increasing_id().alias("row"), F.split(F.trim(plain), " ").alias("all"))
        .where(F.arrays_overlap("all", rarer))
        .withColumn("n", F.size("all") - 1)
    )
    found = texts.select("id", "row", "all", "n", F.posexplode(_bigrams(F.col("all"), F.col("n"))).alias("at", "bigram"))
    size = F.least("n", "t_size")
    return (
        found.join(known, "bigram")
        .where(F.col("n") >= F.col("t_size") * threshold / (2 - threshold))
        .withColumn("unit", F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("n") - F.col("t_size"))))
        .groupBy("id", "row", "template", "unit")
        .agg(F.first(F.slice("all", F.col("unit") + 1, size + 1)).alias("words"))
        .withColumn("size", (F.size("words") - 1).cast("bigint"))
    )


def units(text: Column) -> Column:
    """The distinct lines, paragraphs (split at blank lines) and the whole of a text, with
    words lower-cased (A-Z), everything but letters and digits as one space."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " ")
    return F.array_distinct(F.transform(
        F.concat(F.split(plain, "\n"), F.split(plain, r"\n *\n"), F.array(plain)),
        lambda u: F.trim(F.regexp_replace(u, r"[\n ]+", " ")),
    ))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
    complete: Sequence[tuple[str, str]] = (), inside: bool = False,
) -> DataFrame:
    """One row per distinct id: doc_id, license, dice, template, n_matches.

    * Dice over the bags of word bigrams of a unit and a template:
      ``2 sum(min(times)) / (bigrams of the unit + bigrams of the template)``.
    * license: of the best match from ``threshold`` on; ties go to the template listed first.
      n_matches: matching (unit, template) pairs.  Nothing found, a null or an empty text:
      license, dice and template are null and n_matches is 0.
    * ``inside``: notices inside longer units count, too, and the ``complete`` texts.  A complete
      text is numbered after the templates and wins against notices, which it may quote; a
      template that no unit of a document reaches counts once in n_matches if a window does.
    * Rows with one id count as one document; null ids are one document, too.  Units are told
      apart by row, so repeated rows do not add up within a unit.
    * Empty table: no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    known = F.broadcast(_templates(spark, templates))
    sizes = [len(template_words(t)) - 1 for _, t in templates]
    keep, stretch = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(sizes) * keep, max(sizes) * stretch
    narrow = columns_of(docs, id=id_col, text=text_col)
    pieces = (
        narrow.select("id", F.monotonically_increasing_id().alias("row"), F.posexplode(units(F.col("text"))).alias("unit", "u"))
        .withColumn("words", F.split("u", " "))
        .withColumn("size", (F.size("words") - 1).cast("bigint"))
        .where((F.col("size") >= least) & (F.col("size") <= most))
    )
    bigrams = pieces.select("id", "row", "unit", "size", F.explode(_bigrams(F.col("words"), F.col("size"))).alias("bigram"))

    def reached(compared: DataFrame) -> DataFrame:
        return (
            compared.groupBy("id", "row", "unit", "template", "bigram", "licence", "size", "t_size", "times")
            .agg(F.count(F.lit(1)).alias("found"))
            .groupBy("id", "row", "unit", "template", "licence", "size", "t_size")
            .agg(F.sum(F.least("found", "times")).alias("common"))
            .withColumn("dice", 2 * F.col("common") / (F.col("size") + F.col("t_size")))
            .where(F.col("dice") >= threshold)
            .select("id", "template", "licence", "dice")
        )

    shared = reached(
        bigrams.join(known, "bigram")
        .where((F.col("size") >= F.col("t_size") * keep) & (F.col("size") <= F.col("t_size") * stretch))
    ).withColumn("units", F.lit(1).cast("bigint"))
    if inside:
        every = [*templates, *complete]
        placed = windows(narrow, every, threshold)
        cut = placed.select("id", "row", "template", "unit", "size", F.explode(_bigrams(F.col("words"), F.col("size"))).alias("bigram"))
        within = reached(cut.join(F.broadcast(_templates(spark, every)), ["template", "bigram"]))
        shared = shared.unionByName(within.withColumn("units", F.lit(0).cast("bigint")))
    none = narrow.select(
        "id", F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("licence"),
        F.lit(None).cast("double").alias("dice"), F.lit(0).cast("bigint").alias("units"),
    )
    best = F.when(F.col("dice").isNotNull(), F.struct(F.col("template") < len(templates), -F.col("dice"), "template"))
    by_template = shared.unionByName(none).groupBy("id", "template", "licence").agg(
        F.max("dice").alias("dice"), F.sum("units").alias("units")
    )
    return by_template.groupBy("id").agg(
        F.min_by("licence", best).alias("license"), F.min_by("dice", best).alias("dice"),
        F.min_by("template", best).alias("template"),
        F.sum(F.when(F.col("template").isNotNull(), F.greatest("units", F.lit(1))).otherwise(0)).cast("bigint").alias("n_matches"),
    ).withColumnRenamed("id", "doc_id")
