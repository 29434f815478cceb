"""Licence scans: lines, paragraphs and whole texts against licence templates by Dice over word bigrams.

A unit is a line, a paragraph of several lines, a sentence (over line ends, as notices are wrapped; where a text has more
than one), or a text of several paragraphs. A notice of several sentences is found where lines, a paragraph or the text
hold it and little else; whole licences have no template here, only their notices, headers and first clauses. Normalised, it is its runs of
letters a-z and digits in lower case, joined by spaces. With A and B bigrams (repeats included), a unit and a
template whose bigrams overlap in C (smaller count of each) have the coefficient 2C / (A + B). To reach the least
coefficient t, A must lie between B t / (2 - t) and B (2 - t) / t, so units outside all templates' bounds go before
anything is compared, and each bigram meets only templates that its unit's size allows. It also follows that such a
unit holds one of a few telling words, so texts without any go before they are cut into units. What is compared is spread
over rows by bigram against the templates' few thousand bigrams, which are constants and broadcast; only bigrams that
some template has are ever grouped.

Only DataFrame functions are used. Null and empty texts have no units. Equal rows give their matches each; a null
doc_id is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST = 0.8
BREAK = "\x01"  # between sentences, while a text is cut
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Licence notices and headers as their publishers word them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This program is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-first": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-permission": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def bigrams_of(text: str) -> list[str]:
    words = "".join(c if c in LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bounds(size: int, least: float) -> tuple[float, float]:
    """The sizes that can still reach the least coefficient; a little wider than rounding could need."""
    return size * least / (2 - least) - 1e-6, size * (2 - least) / least + 1e-6


def template_rows(templates: dict[str, str], least: float) -> list[tuple]:
    """(licence, its bigrams, smallest unit, largest unit, a bigram, how often)."""
    out = []
    for name, text in templates.items():
        own = bigrams_of(text)
        out += [(name, len(own), *bounds(len(own), least), b, own.count(b)) for b in sorted(set(own))]
    return out


def telling_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which any unit that reaches ``least`` has one. Such a unit has B t / (2 - t) of a template's B
    bigrams or more, so at least one of any that outnumber the rest; words are taken, long ones that stand in many
    bigrams first, until their bigrams do so for every template."""
    own = {name: bigrams_of(text) for name, text in templates.items()}
    need = {name: len(b) - math.ceil(len(b) * least / (2 - least) - 1e-9) + 1 for name, b in own.items()}
    taken: list[str] = []
    while True:
        left = {n: [b for b in own[n] if not set(b.split()) & set(taken)] for n in own}
        short = {n: k for n in own if (k := need[n] - (len(own[n]) - len(left[n]))) > 0}
        if not short:
            return taken
        gains: dict[str, int] = {}
        for n, k in short.items():
            for word in {w for b in left[n] for w in b.split()}:
                gains[word] = gains.get(word, 0) + min(k, sum(word in b.split() for b in left[n])) * len(word) ** 4
        taken.append(max(gains, key=lambda w: (gains[w], w)))


def template_table(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    quoted = ", ".join(f"('{n}', {size}L, {lo!r}D, {hi!r}D, '{b}', {k}L)" for n, size, lo, hi, b, k in template_rows(templates, least))
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(license_id, template_bigrams, lo, hi, bigram, times)")


def units_of(text: Column) -> Column:
    """The units of a text: kind, number from 0, normalised text."""
    lines = F.split(text, "\n")
    paragraphs = F.split(text, "\n[ \t\r]*\n")

    def unit(kind: str):
        return lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), normalised(x).alias("norm"))

    many = F.filter(F.transform(paragraphs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.contains(p["x"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), normalised(text).alias("norm"))))
    cut = F.regexp_replace(F.regexp_replace(text, "\n[ \t\r]*\n", BREAK), r"([.!?])\s+", f"$1{BREAK}")
    sentences = F.filter(F.split(cut, BREAK), lambda x: x != "")
    sentences = F.when(F.size(sentences) > 1, sentences).otherwise(F.array().cast("array<string>"))
    kind = "array<struct<unit:string,unit_no:int,norm:string>>"
    return F.concat(
        F.transform(lines, unit("line")).cast(kind),
        F.transform(sentences, unit("sentence")).cast(kind),
        F.transform(many, lambda p: F.struct(F.lit("paragraph").alias("unit"), p["i"].alias("unit_no"), normalised(p["x"]).alias("norm"))).cast(kind),
        F.coalesce(whole.cast(kind), F.array().cast(kind)),
    )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST, tell: bool = True) -> DataFrame:
    """doc_id, unit, unit_no, license_id, n_bigrams, dice of every unit and template that reach ``least``. ``tell``:
    texts without a telling word go first, which loses nothing."""
    spark = df.sparkSession
    rows = template_rows(templates, least)
    low, high = min(r[2] for r in rows), max(r[3] for r in rows)
    low_case, told = F.lower(F.col(text_col)), F.lit(False)
    for word in telling_words(templates, least):
        told = told | F.contains(low_case, F.lit(word))
    docs = (df.filter(told) if tell else df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    units = docs.select("row", "doc_id", F.inline(units_of(F.col("text"))))
    spaces = F.length("norm") - F.length(F.translate("norm", " ", ""))  # of single spaces between words: the bigrams
    sized = units.withColumn("n_bigrams", spaces.cast("long")).filter((F.col("n_bigrams") >= low) & (F.col("n_bigrams") <= high))
    words = F.split("norm", " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    spread = sized.select("row", "doc_id", "unit", "unit_no", "n_bigrams", F.explode(pairs).alias("bigram"))
    known = F.broadcast(template_table(spark, templates, least))
    met = spread.join(known, "bigram").filter("n_bigrams between lo and hi")
    key = ["row", "doc_id", "unit", "unit_no", "license_id", "n_bigrams", "template_bigrams"]
    common = met.groupBy(*key, "bigram").agg(F.least(F.count("*"), F.first("times")).alias("both"))
    dice = F.lit(2.0) * F.col("c") / (F.col("n_bigrams") + F.col("template_bigrams"))
    scored = common.groupBy(*key).agg(F.sum("both").alias("c")).withColumn("dice", dice)
    return scored.filter(F.col("dice") >= least).select("doc_id", "unit", "unit_no", "license_id", "n_bigrams", "dice")
