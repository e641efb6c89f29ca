"""Licence scans: a trained paragraph classifier, confirmed by templates.

A softmax regression over the presence of word 1- to 3-grams names the licence family of a
paragraph or ``unknown``. It is trained on excerpts and corruptions of the templates below,
with unrelated and near-miss sentences as ``unknown``; the probability from which a family
is named is calibrated on held-out ones, so that at most ``false_rate`` of the held-out
unknowns are named. A named paragraph is confirmed if it shares enough 3-grams with a
template of the family. Training sees only these fixed texts and runs once on the driver;
every document is scored by joins and aggregates, no Python.

Every n-gram that counts holds a word specific to the templates, so paragraphs without such
a word stay below the threshold and are set aside before n-grams are made. Paragraphs are
lines; a line goes on where the next one starts in lower case and it ends without a stop.
Null and empty texts have no paragraphs and no licence. Repeated rows are each reported;
columns other than id and text are left out.
"""

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual notices of each family, and the openings of the full texts.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This project is distributed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution license CC BY 3.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Released under CC0, dedicated to the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

# Sentences that are no licence, some of them in its words.
UNKNOWN = [
    "", "The weather was fine and the road was long.",
    "He lost his driving license in the city and had to take the bus.",
    "The agency may license new drivers under the terms of the act.",
    "Permission to land was granted by the tower at noon.",
    "You may use this road to the north, provided that you pay the fee.",
    "The public is free to walk in the park at any time.",
    "A new version of the program is to appear in spring.",
    "The general said that the conditions were met and the work was done.",
    "This work is the first of its kind, and it is subject to review.",
    "The Apache lived in the mountains of the south.",
    "She studied at MIT and later worked on compilers.",
    "The copyright office is on the second floor of the building.",
    "All rights and duties of the members follow from the statute.",
    "Software is written by people, and people make mistakes.",
    "The warranty of the washing machine ends in two years.",
    "Anyone who can read the source can see what it does.",
    "The foundation gives money for research without limitation.",
    "They modify the recipe and sell the bread in the market.",
    "Copies of the letter were sent to the person in charge.",
    "The creative commons of the village is a place for children.",
    "It was published in 2004 and is now in its third edition, version 2.0 of the text.",
    "The code of the door is known to the staff only.",
    "The terms of the contract are as follows, with or without changes.",
]

_COMMON = set(
    "a all also an and any are as at be been but by can copy could do either each every file first "
    "following for form found free from general had has have he held her his how if in into is it "
    "its kind later like made may modify more most must name new no not of on one only option or "
    "other out over part person public published see sell she should so some such than that the "
    "their them then there these they this those time to under universal up use used v version was "
    "we were what when where which who will with without work would www you your http https org "
    "s 0 1 2 3 4 5 6 7 8 9".split()
)
_WORD = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return low.split()


def grams(tokens: list[str], sizes=(1, 2, 3)) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in sizes for i in range(len(tokens) - n + 1)}


class Model:
    """``families`` (the last is unknown), ``weights``: n-gram to weights, ``bias``, and the
    ``threshold`` from which a family is named."""

    def __init__(self, rounds: int = 200, false_rate: float = 0.01, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.families = [*TEMPLATES, "unknown"]
        specific = {w for texts in TEMPLATES.values() for t in texts for w in words(t)} - _COMMON
        self.specific = sorted(specific)
        vocabulary = {
            g
            for texts in TEMPLATES.values()
            for t in texts
            for g in grams(words(t))
            if specific & set(g.split())
        }
        self.vocabulary = {g: n for n, g in enumerate(sorted(vocabulary))}
        train, held = self._examples(rng), self._examples(rng, 20)
        x, y = self._features([t for t, _ in train]), np.array([k for _, k in train])
        self.w = np.zeros((len(self.vocabulary), len(self.families)), dtype=np.float32)
        self.bias = np.zeros(len(self.families), dtype=np.float32)
        target = np.eye(len(self.families), dtype=np.float32)[y]
        pace = np.zeros_like(self.w)
        for _ in range(rounds):
            wrong = (self._softmax(x @ self.w + self.bias) - target) / len(y)
            pace = 0.9 * pace + x.T @ wrong + 1e-5 * self.w
            self.w -= 1.5 * pace
            self.bias -= 1.5 * wrong.sum(axis=0)
        # Without any n-gram the answer has to be unknown: the screen relies on it.
        self.bias[-1] = max(self.bias[-1], self.bias[:-1].max() + 1)
        p = self._softmax(self._features([t for t, k in held]) @ self.w + self.bias)
        off = np.sort(p[np.array([k for _, k in held]) == len(TEMPLATES)][:, :-1].max(axis=1))
        self.threshold = float(max(0.5, off[int(np.ceil((1 - false_rate) * len(off))) - 1]))

    def _examples(self, rng, repeats: int = 64) -> list[tuple[list[str], int]]:
        """Word lists and classes: templates with words lost, cut short and set among others,
        and for unknown the sentences and scrambled words of the templates."""
        out = []
        noise = [w for t in UNKNOWN for w in words(t)]
        for k, texts in enumerate(TEMPLATES.values()):
            for text in texts:
                for r in range(repeats // 4):
                    w = words(text)
                    if r:
                        w = [v for v in w if rng.random() > 0.05]
                        if len(w) > 12:  # an excerpt
                            keep = rng.integers(8, len(w) + 1)
                            start = rng.integers(0, len(w) - keep + 1)
                            w = w[start : start + keep]
                        w += list(rng.choice(noise, rng.integers(0, 10)))
                    out.append((w, k))
        every = [w for texts in TEMPLATES.values() for t in texts for w in words(t)]
        for text in UNKNOWN:
            for _ in range(repeats // 4):
                w = words(text)
                w += list(rng.choice(noise, rng.integers(0, 12)))
                w += list(rng.choice(every, rng.integers(0, 4)))
                out.append((list(rng.permutation(w)) if rng.random() < 0.3 else w, len(TEMPLATES)))
        return out

    def _features(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        for row, text in zip(x, texts, strict=True):
            found = [self.vocabulary[g] for g in grams(text) if g in self.vocabulary]
            row[found] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def _word_array(column: str) -> str:
    return f"filter(split(lower({column}), '{_WORD}'), w -> w != '')"


def licence_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.5
) -> DataFrame:
    """One row per paragraph that a family is named for: ``id_col``, text_key (a hash that
    tells documents of one id apart), paragraph (from 0), family, probability, similarity
    (to the closest template of the family) and confirmed."""
    spark, fit = docs.sparkSession, model()
    specific = F.array(*map(F.lit, fit.specific))
    lines = F.expr(f"split(regexp_replace(`{text_col}`, '(?<![.!?:;\\\\n])\\\\n(?=[a-z(])', ' '), '\\n')")
    paragraphs = (
        docs.select(id_col, text_col)
        .filter(F.arrays_overlap(F.expr(_word_array(f"`{text_col}`")), specific))
        .select(id_col, F.xxhash64(text_col).alias("text_key"), F.posexplode(lines).alias("paragraph", "__line"))
        .withColumn("__words", F.expr(_word_array("__line")))
        .filter(F.arrays_overlap("__words", specific))
        .dropDuplicates([id_col, "text_key", "paragraph"])
    )
    # A paragraph is known by a key of its own from here on; ids may be null.
    key = [F.xxhash64(F.col(id_col), "text_key", "paragraph").alias("__key"), id_col, "text_key", "paragraph"]
    made = "array_distinct(flatten(transform(sequence(1, 3), n -> IF(size(__words) < n, array(), transform(sequence(1, size(__words) - n + 1), i -> concat_ws(' ', slice(__words, i, n)))))))"
    length = F.greatest(F.size("__words") - 2, F.lit(0)).cast("bigint").alias("__n")
    found = paragraphs.select(*key, length, F.expr(made).alias("__grams"))
    rows = found.select("__key", id_col, "text_key", "paragraph", "__n", F.explode("__grams").alias("gram"))

    # Tables of the model: as many rows as the templates have n-grams, whatever the input.
    weights = spark.createDataFrame(
        [(g, [float(v) for v in fit.w[n]]) for g, n in fit.vocabulary.items()],
        "gram string, w array<double>",
    )
    size = len(fit.families)
    sums = [F.sum(F.col("w")[n]).alias(f"z{n}") for n in range(size)]
    scores = rows.join(F.broadcast(weights), "gram").groupBy("__key", id_col, "text_key", "paragraph", "__n").agg(*sums)
    logits = F.array(*(F.col(f"z{n}") + float(fit.bias[n]) for n in range(size)))
    names = F.array(*map(F.lit, fit.families))
    named = (
        scores.withColumn("__z", logits)
        .withColumn("__top", F.array_max("__z"))
        .withColumn("family", F.element_at(names, F.array_position("__z", F.col("__top")).cast("int")))
        .withColumn("probability", F.expr("1 / aggregate(__z, 0D, (a, z) -> a + exp(z - __top))"))
        .filter((F.col("family") != "unknown") & (F.col("probability") >= fit.threshold))
        .select("__key", id_col, "text_key", "paragraph", "family", "probability", "__n")
    )

    shapes = [
        (f"{family}{n}", family, g, len(own))
        for family, texts in TEMPLATES.items()
        for n, t in enumerate(texts)
        if (own := grams(words(t), (3,)))
        for g in own
    ]
    shapes = spark.createDataFrame(shapes, "template string, family string, gram string, size int")
    close = (
        rows.select("__key", "__n", "gram")
        .join(F.broadcast(shapes), "gram")
        .groupBy("__key", "family", "template", "size", "__n")
        .agg(F.count("*").alias("common"))
        # The share of the template that is found, or of an excerpt that is of the template
        .selectExpr("__key", "family", "greatest(common / size, common / greatest(__n, 3L)) AS similarity")
        .groupBy("__key", "family")
        .agg(F.max("similarity").alias("similarity"))
    )
    return (
        named.join(close, ["__key", "family"], "left")
        .withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        .withColumn("confirmed", F.col("similarity") >= similarity)
        .select(id_col, "text_key", "paragraph", "family", "probability", "similarity", "confirmed")
    )


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_named (paragraphs a family was named for),
    n_confirmed, families (confirmed ones, sorted, joined by commas) and paragraphs
    (confirmed ones as number:family, in order)."""
    found = licence_paragraphs(docs, id_col, text_col).groupBy(id_col, "text_key").agg(
        F.count("*").alias("n_named"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_sort(F.collect_set(F.expr("IF(confirmed, family, NULL)"))).alias("__families"),
        F.array_sort(F.collect_list(F.expr("IF(confirmed, struct(paragraph, family), NULL)"))).alias("__at"),
    )
    found = found.withColumnsRenamed({id_col: "__id", "text_key": "__text_key"})
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_key"))
    same = rows[id_col].eqNullSafe(found["__id"]) & (rows["text_key"] == found["__text_key"])
    return rows.join(found, same, "left").select(
        id_col,
        F.coalesce("n_named", F.lit(0)).alias("n_named"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce(F.array_join("__families", ","), F.lit("")).alias("families"),
        F.coalesce(F.expr("array_join(transform(__at, x -> concat(x.paragraph, ':', x.family)), ',')"), F.lit("")).alias("paragraphs"),
    )
