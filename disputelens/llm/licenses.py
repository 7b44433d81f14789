"""Operator 1: license scans by diagonal voting.

Texts are cut into words; rolling k-grams of words are hashed and joined to
the places where the templates hold the same k-gram: phrases by ``PHRASE_K``
words, whole licenses by ``LICENSE_K``. Every match is checked on the words. A
match at word p of a text and word q of a template votes for the diagonal
p - q, the offset of the template in the text.

A phrase must have all its places on one diagonal. Of a license, some words
may be inserted, left out or changed, which moves its later places to
neighbouring diagonals. So neighbouring diagonals are merged: the votes of a
window of diagonals are put together, as wide as a fifth of the license's
words, with another one every half window, so that a license is whole in one
of them. Two votes of a window for the same place count once, and the span is
verified by the distinct words of the license that the places in the window
cover: at least ``COVER`` of them.

Licenses are a parameter, ``(label, text)`` pairs held by the driver; their
k-grams are a table of about as many rows as they have words, of which at most
``BROADCAST_ROWS`` are broadcast (beyond that Spark plans the join). Each text
also sends one row that always matches, which carries its word count; so a
text without any match comes out of the same aggregation and the texts are
read once and never shuffled. Votes are put together before they are shuffled.

Defined results: a null text is the empty text; rows that repeat a doc_id and
text give one row, rows of one doc_id with different texts give one each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pick, text_or_empty

BETWEEN = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"  # what separates words, as a regex class
PHRASE_K = 2
LICENSE_K = 3
LEAST_SHIFT = 4  # words by which parts of a license may be shifted, or a fifth of its words
COVER = 0.6  # share of a license's words that must be found in place
BROADCAST_ROWS = 100_000

# The phrases searched for, as (label, words). They must be found whole.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Public license texts and the notices that licenses tell authors to use, as (label, text).
LICENSES = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work.""",
    ),
    (
        "cc-by-4.0",
        """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/.""",
    ),
    (
        "cc-by-sa-4.0",
        """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by-sa/4.0/.""",
    ),
]


def words_in(text: str) -> list[str]:
    """The words of a template, as the scan cuts texts."""
    return re.findall(f"[^{BETWEEN}]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def templates(licenses: list[tuple[str, str]] | None = None) -> list[tuple]:
    """``(template, label, base, size, place, gram)`` for every k-gram of every template; ``gram`` is its words and blanks."""
    rows = []
    every = [(*p, True) for p in PHRASES] + [(*n, False) for n in (LICENSES if licenses is None else licenses)]
    for t, (label, text, base) in enumerate(every):
        w, k = words_in(text), PHRASE_K if base else LICENSE_K
        rows += [(t, label, base, len(w), q, " ".join(w[q : q + k])) for q in range(len(w) - k + 1)]
    return rows


def template_table(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = [(-1, None, False, 0, 0, ""), *templates(licenses)]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, size int, place int, gram string")
    t = t.withColumn("hash", F.xxhash64("gram")).withColumnRenamed("gram", "of_template")
    return F.broadcast(t) if len(rows) <= BROADCAST_ROWS else t


def spans(docs: DataFrame, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """Verified spans per text: ``doc_id, text_key, n_words, label, base, start, stop, cover``.

    ``start`` and ``stop`` are word places, the end exclusive. One more row
    per text, with a null label, keeps texts without spans. A license may be
    found by two windows of diagonals.
    """
    d = pick(docs, "doc_id", "text").withColumn("text", text_or_empty())
    # a leading blank makes the first piece empty in every text; word p is piece p + 1
    pieces = F.split(F.concat(F.lit(" "), ascii_lower(F.col("text"))), f"[{BETWEEN}]+")
    words = d.select("doc_id", F.xxhash64("text").alias("text_key"), pieces.alias("words"))
    at = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "word"))
    # the k-grams that begin with piece ``at``; piece 0 always matches
    gram = lambda k: f"concat_ws(' ', word, {', '.join(f'get(words, at + {i})' for i in range(1, k))})"
    grams = F.expr(f"if(at = 0, array(''), array({gram(PHRASE_K)}, {gram(LICENSE_K)}))")
    count = F.expr("if(at = 0, size(words) - 1 - if(size(words) > 1 and element_at(words, -1) = '', 1, 0), null)")
    each = at.select("doc_id", "text_key", "at", count.alias("n_words"), F.explode(grams).alias("gram"))
    hits = each.withColumn("hash", F.xxhash64("gram")).join(template_table(docs.sparkSession, licenses), "hash")
    hits = hits.filter((F.col("gram") == F.col("of_template")) & ((F.col("at") == 0) == (F.col("template") == -1)))
    p = F.col("at") - 1
    hits = hits.withColumn("diagonal", p - F.col("place"))
    step = F.expr(f"greatest({LEAST_SHIFT}, size div 5)")
    half = F.floor(F.col("diagonal") / step)
    window = F.when(F.col("base"), F.array("diagonal")).when(F.col("template") == -1, F.array(F.lit(0).cast("int"))).otherwise(F.array((half - 1).cast("int"), half.cast("int")))
    key = ["doc_id", "text_key", "template", "label", "base", "size", "window"]
    found = hits.withColumn("window", F.explode(window)).groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.collect_set("place").alias("places"), F.min(p).alias("start"), F.max(p).alias("last")
    )
    k = F.when(F.col("base"), PHRASE_K).otherwise(LICENSE_K)
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + k - 1)))))
    cover = F.when(F.col("template") == -1, F.lit(0.0)).otherwise(covered / F.col("size"))
    kept = found.withColumn("cover", cover).filter(
        (F.col("template") == -1) | F.when(F.col("base"), F.size("places") == F.col("size") - PHRASE_K + 1).otherwise(F.col("cover") >= COVER)
    )
    return kept.select("doc_id", "text_key", "n_words", "label", "base", "start", (F.col("last") + k).alias("stop"), "cover")


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per text: counts and places of the phrases, and all labels found."""
    s = spans(docs, licenses)
    phrase = F.col("base") & F.col("label").isNotNull()
    at = F.when(phrase, F.col("start").cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(phrase, 1)).cast("long").alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        names(F.when(phrase, F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    ).drop("text_key")
