"""Licence scan: a trained paragraph classifier over sparse word n-grams, with an unknown class and template confirmation.

A multinomial logistic regression over word unigrams and bigrams of the licence vocabulary is trained
here on variants of the fixed statements below and of ordinary sentences that use the same words.
Its temperature is calibrated on held-out variants; below MIN_SCORE a paragraph is unknown. A
prediction is confirmed when enough of a statement of the predicted family stands in the paragraph.

Scoring is a single projection of DataFrame functions: no shuffle, no Python. A paragraph is a line.
One without any word of the vocabulary has no feature, so such paragraphs and texts are settled
by a set test without changing a result.

Defined cases: a null or empty text has no licence paragraph; families of equal score rank by name;
repeated rows are scanned each; an empty table gives an empty result; other columns pass through
with_licenses(); columns of the results' names are replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Customary licence statements by family.
STATEMENTS = {
    "agpl": ["licensed under the GNU Affero General Public License version 3", "the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "http www apache org licenses LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "released under the 3-Clause BSD License", "licensed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "released under CC BY 4.0", "http creativecommons org licenses by 4.0"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "released under CC BY-NC 4.0", "http creativecommons org licenses by-nc 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "released under CC BY-SA 4.0", "http creativecommons org licenses by-sa 4.0"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal", "released under CC0", "CC0 1.0 Universal public domain dedication", "this is free and unencumbered software released into the public domain"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the GPL version 2 or later", "released under the GPLv3", "SPDX-License-Identifier: GPL-3.0"],
    "lgpl": ["licensed under the GNU Lesser General Public License version 2.1", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0", "released under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission", "Copyright. All rights reserved", "confidential and proprietary, unauthorized copying of this file is strictly prohibited"],
}
# Ordinary sentences that use words of licences.
ORDINARY = [
    "the license plate of the car was lost", "he got a driving license in version after version of the test", "a work of general interest to the public", "the apache helicopter landed near the river",
    "researchers at mit released a study in public", "the record was released under pressure last year", "permission to enter was granted by the guard", "the free lunch in the house of commons",
    "creative people share alike ideas with attribution to nobody", "all rights come with duties and no part was reserved", "the restaurant has a license to sell wine", "a copy of the general report was published by the foundation",
    "this software costs money and is not free of charge", "in compliance with the building code you may use the file", "the mozilla browser was updated to version 2", "redistribution of wealth is a public matter",
    "the file is strictly confidential", "her source used binary numbers and forms", "the domain of the function is universal", "public transport is free for any person under six", "the doctor lost his license", "version 3 of the terms was a work in progress",
]
# Words without weight of their own.
STOP = {"a", "an", "and", "any", "are", "as", "at", "by", "for", "in", "is", "it", "no", "not", "of", "on", "or", "org", "http", "www", "that", "the", "this", "to", "under", "v", "with", "you", "may", "be", "s", "0", "1", "2", "3", "4"}
FILLER = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud", "laboris", "the", "of", "and", "in", "on", "with"]
UNKNOWN, MIN_SCORE, MIN_TEMPLATE = "unknown", 0.6, 0.6
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams(words: list[str]) -> list[str]:
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP]
    return list(dict.fromkeys([w for w in words if w not in STOP] + pairs))


class Model:
    """Weights by gram, biases, temperature, vocabulary and templates."""

    def __init__(self, variants: int = 40, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        self.families = [*sorted(STATEMENTS), UNKNOWN]
        base = [(tokens(s), f) for f, ss in sorted(STATEMENTS.items()) for s in ss] + [(tokens(s), UNKNOWN) for s in ORDINARY]
        self.vocabulary = sorted({w for words, f in base if f != UNKNOWN for w in words if w not in STOP})
        features = sorted({g for words, _ in base for g in grams(words) if set(g.split()) & set(self.vocabulary)})
        at = {g: i for i, g in enumerate(features)}
        rows = [(self._vary(rng, w), f) for w, f in base for _ in range(variants)] + [(list(rng.choice(self.vocabulary + FILLER, rng.integers(1, 4))), UNKNOWN) for _ in range(10 * variants)]
        x, y = np.zeros((len(rows), len(features) + 1)), np.array([self.families.index(f) for _, f in rows])
        for i, (words, _) in enumerate(rows):
            x[i, [at[g] for g in grams(words) if g in at]] = 1
        x[:, -1] = 1
        held = rng.random(len(rows)) < 0.25
        weights = self._fit(x[~held], y[~held], len(self.families))
        logits = x[held] @ weights
        losses = {t: self._loss(logits / t, y[held]) for t in np.geomspace(0.25, 4, 25)}
        self.temperature = min(losses, key=losses.get)
        weights = np.round(weights / self.temperature, 4)
        self.bias = weights[-1].tolist()
        self.weights = {g: weights[i].tolist() for g, i in at.items()}
        self.templates = {f: [grams(tokens(s)) for s in ss] for f, ss in STATEMENTS.items()}

    @staticmethod
    def _vary(rng: np.random.Generator, words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > 0.08] or words
        before, after = (list(rng.choice(FILLER, rng.integers(0, 7))) for _ in range(2))
        return [*before, *kept, *after]

    @staticmethod
    def _loss(logits: np.ndarray, y: np.ndarray) -> float:
        logits = logits - logits.max(1, keepdims=True)
        return float((np.log(np.exp(logits).sum(1)) - logits[np.arange(len(y)), y]).mean())

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 200, rate: float = 4.0, decay: float = 2e-4) -> np.ndarray:
        w, speed, target = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k)), np.eye(k)[y]
        for _ in range(rounds):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed - rate * 0.1 * (x.T @ (p - target) / len(y) + decay * w)
            w = w + speed
        return w


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model()


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def _grams(words: Column, stop: Column) -> Column:
    plain = F.filter(words, lambda w: ~F.array_contains(stop, w))
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.when(~(F.array_contains(stop, a) & F.array_contains(stop, b)), F.concat_ws(" ", a, b))), lambda g: g.isNotNull() & g.contains(" "))
    return F.array_distinct(F.concat(plain, pairs))


def with_licenses(df: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """Adds license_paragraphs: array of (paragraph, family, score, template, confirmed), by rising paragraph number."""
    m = model or trained()
    vocabulary, stop = _literal(m.vocabulary, "array<string>"), _literal(sorted(STOP), "array<string>")
    weights, bias = _literal(m.weights, "map<string,array<double>>"), _literal(m.bias, "array<double>")
    names, templates = _literal(m.families, "array<string>"), _literal(m.templates, "map<string,array<array<string>>>")
    lines = F.split(F.col(text_col), "\n")
    numbered = F.transform(lines, lambda p, i: F.struct(i.alias("paragraph"), _words(p).alias("words")))
    some = F.filter(numbered, lambda x: F.arrays_overlap(x["words"], vocabulary))
    shown = F.transform(some, lambda x: F.struct(x["paragraph"].alias("paragraph"), _grams(x["words"], stop).alias("grams")))
    known = F.transform(shown, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), F.filter(F.transform(x["grams"], lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull()).alias("rows")))
    scored = F.transform(known, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), F.aggregate(x["rows"], bias, lambda a, w: F.zip_with(a, w, lambda p, q: p + q)).alias("logits")))
    spread = F.transform(scored, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), F.transform(x["logits"], lambda z: F.exp(z - F.array_max(x["logits"]))).alias("e")))
    best = F.transform(spread, lambda x: F.struct(
        x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), F.get(names, (F.array_position(x["e"], F.array_max(x["e"])) - 1).cast("int")).alias("family"),
        (F.array_max(x["e"]) / F.aggregate(x["e"], F.lit(0.0), lambda a, e: a + e)).alias("score")))
    sure = F.filter(best, lambda x: (x["family"] != UNKNOWN) & (x["score"] >= MIN_SCORE))
    likeness = F.transform(sure, lambda x: F.struct(
        x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["score"].alias("score"),
        F.array_max(F.transform(F.try_element_at(templates, x["family"]), lambda t: F.size(F.array_intersect(t, x["grams"])) / F.size(t))).alias("template")))
    done = F.transform(likeness, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["score"].alias("score"), x["template"].alias("template"), (x["template"] >= MIN_TEMPLATE).alias("confirmed")))
    kind = "array<struct<paragraph:int,family:string,score:double,template:double,confirmed:boolean>>"
    any_word = F.arrays_overlap(F.split(F.lower(F.col(text_col)), SPLIT), vocabulary)
    return df.withColumn("license_paragraphs", F.coalesce(F.when(any_word, done).cast(kind), F.array().cast(kind)))


def license_summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of df: id_col, n_paragraphs, n_confirmed, family (of the best confirmed paragraph), score, families (all confirmed, by name)."""
    found = with_licenses(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select("id", "license_paragraphs")
    sure = found.withColumn("sure", F.filter("license_paragraphs", lambda x: x["confirmed"]))
    best = F.get(F.array_sort(F.transform("sure", lambda x: F.struct((-x["score"]).alias("s"), x["family"].alias("family"), x["score"].alias("score")))), F.lit(0))
    return sure.withColumn("best", best).select(
        F.col("id").alias(id_col), F.size("license_paragraphs").cast("long").alias("n_paragraphs"), F.size("sure").cast("long").alias("n_confirmed"), F.col("best.family").alias("family"), F.col("best.score").alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",").alias("families"),
    )
