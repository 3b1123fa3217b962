"""Licence statements in paragraphs: sparse word n-gram logistic regression, an unknown class, template comparison.

The model is fitted on the driver from the statements below and a bounded number of other
paragraphs of the corpus. Scanning is DataFrame functions alone, row by row, without a join or a
shuffle: each paragraph of each text is cut into words and word pairs, those that the model knows
(a number that the statements fix) are looked up by their hashes, their weights are summed for each
family and turned into calibrated probabilities. A paragraph whose likeliest class is unknown is
rejected. A predicted family is confirmed if one of its statements is covered by the paragraph, its words
and, side by side and in order, its pairs of words, else the paragraph is reported as unknown with the family it was taken for.

A paragraph is a line; a line of 30 to 100 characters that ends within a sentence is joined with the
one after it, as wrapped notices are. Each input row gives a row for every paragraph that isn't
rejected, repeated rows give each theirs; a null or empty text gives none. Very long texts and
paragraphs take time in proportion to their length. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening or naming sentences of public licences, as their stewards publish them.
STATEMENTS = {
    "agpl": ["licensed under the GNU Affero General Public License", "GNU Affero General Public License version 3 as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0", "licensed under Apache-2.0", "Apache-2.0", "Apache License 2.0", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the BSD 3-Clause License", "governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "released into the public domain under CC0 1.0 Universal"],
    "cc-nc": ["Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl": ["licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GPL license version 2", "Distributed under the terms of the GPL, version 3", "GPLv2 or later", "GPLv3 or later", "the GNU GPLv3", "GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License", "Released under MIT", "MIT licensed", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the MIT license", "SPDX-License-Identifier: MIT"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "MPL-2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
UNKNOWN = "unknown"
UNKNOWN_STATEMENTS = [
    "all rights reserved", "copyright of the photographs remains with their owners", "a driver's license is required", "the warranty lasts two years from the date of purchase", "with kind permission of the publisher",
    "see the license file for details", "his license was suspended by the court", "the shop holds a license to sell wine", "terms of use and privacy policy", "licensed premises open until midnight", "copyright law in general", "no permission was given to redistribute the minutes", "a public license for hunting and fishing", "the company released version 2 of the software under a new name",
]
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
# A line break inside a sentence, behind a line of wrapped length.
WRAP = r"\n(?<=(?:\A|\n)[^\n]{30,100}\n)(?<![\s.!?:;]\n)(?=\S)"
# A statement is covered if this share of its words is there and, with SLACK less, of its pairs of neighbours, side by side and in order.
COVERED, SLACK = 0.75, 0.15
# The bounds of the training sample from the corpus: paragraphs, characters of each, different words around statements.
CORPUS_PARAGRAPHS, PARAGRAPH_CHARS, NOISE_WORDS = 300, 2_000, 2_000
ROUNDS, SEED = 400, 5


@dataclass
class Model:
    families: list[str]
    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def features_of(text: str) -> set[str]:
    w = words_of(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def cover(text: str, statement: str) -> float:
    """How far a text covers a statement: the share of its words or, SLACK more, of its pairs of neighbours, whichever is less."""
    own, w = words_of(text), words_of(statement)
    pairs = pairs_of(w)
    return min(len(set(own) & set(w)) / len(set(w)), len(pairs_of(own) & pairs) / len(pairs) + SLACK if pairs else 1.0)


def covers(text: str) -> bool:
    """Whether a text covers any statement."""
    return any(cover(text, s) >= COVERED for x in STATEMENTS.values() for s in x)


def fit(others: list[str]) -> Model:
    """Softmax regression on the statements, whole, shortened and among other words; classes weigh the same.

    The temperature is chosen on variants that were not trained on, by their log loss.
    """
    rng = np.random.default_rng(SEED)
    families = [*sorted(STATEMENTS), UNKNOWN]
    others = [o for o in others if not covers(o)]
    vocabulary = sorted({w for o in others for w in words_of(o)}) or ["lorem"]
    noise = [vocabulary[i] for i in rng.permutation(len(vocabulary))[:NOISE_WORDS]]
    rows: list[tuple[str, int]] = []
    for k, name in enumerate(families):
        for s in STATEMENTS.get(name, UNKNOWN_STATEMENTS):
            w = s.split()
            for v in range(10):
                keep = w if v < 3 else [x for x in w if rng.random() > 0.12] or w
                if v < 8 or not others:
                    around = [str(x) for x in rng.choice(noise, rng.integers(0, 12))]
                else:  # within another paragraph
                    around = others[rng.integers(len(others))].split()
                cut = int(rng.integers(0, len(around) + 1))
                rows.append((" ".join([*around[:cut], *keep, *around[cut:]]), k))
    rows += [(o, len(families) - 1) for o in others]
    sets = [features_of(t) for t, _ in rows]
    known = sorted(set().union(*(features_of(s) for x in [*STATEMENTS.values(), UNKNOWN_STATEMENTS] for s in x)))
    at = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for i, s in enumerate(sets):
        x[i, [at[f] for f in s if f in at]] = 1
    y = np.array([k for _, k in rows])
    test = rng.random(len(y)) < 0.2
    share = 1 / np.bincount(y, minlength=len(families))[y]
    w, b = np.zeros((len(known), len(families))), np.zeros(len(families))
    one = np.eye(len(families))[y]
    own, own_t, target, weight = x[~test], np.ascontiguousarray(x[~test].T), one[~test], share[~test, None]
    for _ in range(ROUNDS):
        g = (_softmax(own @ w + b) - target) * weight
        w -= 0.5 * (own_t @ g + 0.002 * w)
        b -= 0.5 * g.sum(0)
    loss = lambda t: -np.log(_softmax((x[test] @ w + b) / t)[np.arange(test.sum()), y[test]] + 1e-12).mean()
    return Model(families, known, w, b, min(np.geomspace(0.25, 4, 33), key=loss))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WRAP, " "), "\n")


def sample(docs: DataFrame, most: int = CORPUS_PARAGRAPHS) -> list[str]:
    """One paragraph, cut to PARAGRAPH_CHARS, of each of at most `most` rows, by a hash of doc_id; ids are chosen first, without texts."""
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(*order).limit(most).collect()]
    if not ids:
        return []
    rows = docs.where(F.col("doc_id").isin(ids)).withColumn("_p", _paragraphs(F.col("text")))
    cut = F.substring(F.get("_p", F.pmod(F.xxhash64("doc_id"), F.size("_p"))), 1, PARAGRAPH_CHARS)
    # rows that share an id are no more than the others
    found = rows.select("doc_id", cut.alias("_p")).where("_p <> ''").orderBy(*order, "_p").limit(most).collect()
    return sorted(r[1] for r in found)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _hashed(words: Column) -> Column:
    """Hashes of the words and of the pairs of neighbours; the last word's pair is the word alone."""
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def _literal(values: list) -> str:
    return "array(" + ", ".join(_literal(v) if isinstance(v, list) else f"{v}L" if isinstance(v, int) else f"{v!r}D" for v in values) + ")"


def scan(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, paragraph, family, probability, predicted, statement, covered, text: a row for each paragraph that isn't rejected."""
    one = docs.sparkSession.range(1).select(*[F.xxhash64(*map(F.lit, f.split(" "))).alias(f"f{i}") for i, f in enumerate(m.features)]).first()
    known, weights = F.expr(_literal(list(one))), F.expr(_literal([[float(x) for x in w] for w in m.weights]))
    bias = F.expr(_literal([float(x) for x in m.bias]))
    # a value that is used more than once is bound as the argument of a function, so that it is computed once
    hits = F.get(F.transform(F.array(_tokens(F.col("text"))), lambda w: F.array_intersect(known, _hashed(w))), F.lit(0))

    def add(z: Column, h: Column) -> Column:
        return F.zip_with(z, F.get(weights, (F.array_position(known, h) - 1).cast("int")), lambda a, b: a + b)

    def softmax(z: Column) -> Column:
        top = F.array_max(z)
        return F.struct((F.array_position(z, top) - 1).cast("int").alias("k"), (1 / F.aggregate(F.transform(z, lambda v: F.exp((v - top) / m.temperature)), F.lit(0.0), lambda a, v: a + v)).alias("probability"))

    unknown = len(m.families) - 1
    lines = docs.where("text is not null").select("doc_id", F.posexplode(_paragraphs(F.col("text"))).alias("paragraph", "text"))
    scored = lines.select("doc_id", "paragraph", "text", F.aggregate(hits, bias, add, softmax).alias("class")).where(F.col("class.k") != unknown)
    names = F.array(*[F.lit(f) for f in m.families])
    predicted, own = F.get(names, F.col("class.k")), _tokens(F.col("text"))
    # the words of the few paragraphs that are left, then their pairs, each computed once
    scored = scored.withColumn("own", own).withColumn("pairs", F.zip_with(F.slice("own", F.lit(1), F.greatest(F.size("own") - 1, F.lit(0))), F.slice("own", F.lit(2), F.size("own")), lambda a, b: F.concat_ws(" ", a, b)))

    def share(own: str, wanted: set[str]) -> Column:
        return F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in sorted(wanted)]))) / len(wanted)

    best = None
    for k, f in enumerate(m.families[:-1]):
        values = []
        for s in STATEMENTS[f]:
            pairs = {" ".join(p) for p in pairs_of(words_of(s))}
            words = share("own", set(words_of(s)))
            values.append(F.struct((F.least(words, share("pairs", pairs) + SLACK) if pairs else words).alias("covered"), F.lit(s).alias("statement")))
        values = F.array(*values)
        at = F.col("class.k") == k
        best = F.when(at, F.array_max(values)) if best is None else best.when(at, F.array_max(values))
    confirmed = F.coalesce(F.col("best.covered") >= COVERED, F.lit(False))
    return scored.withColumn("best", best).select(
        "doc_id", "paragraph", F.when(confirmed, predicted).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("class.probability", 6).alias("probability"), predicted.alias("predicted"),
        F.col("best.statement").alias("statement"), F.round(F.coalesce("best.covered", F.lit(0.0)), 6).alias("covered"), "text",
    )
