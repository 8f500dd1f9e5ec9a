"""Licence scans (native: the scan is DataFrame functions only).

A paragraph (a line of a text) is told to a licence family by multinomial
logistic regression over the presence of word unigrams and bigrams. The weights
are made sparse by an L1 penalty and are at most ``MAX_FEATURES``. One class is
"unknown": it is trained on paragraphs of the corpus itself and on words of the
templates that stand alone or among words of the corpus, and a temperature
fitted on rows kept back calibrates the probabilities; a family under
``THRESHOLD`` is unknown. A prediction is confirmed if the paragraph holds half
of the n-grams of one of the family's templates. Notices that are wrapped, in
comments too, stand on any number of lines. Whatever confirms a template has a
word that it can't be confirmed without (``needed``); so each line with such a word
is also scored together with the lines around it, until there are as many words
before and after it as the longest template has (``SPAN``), and a family that is
confirmed so, and by no single line of the text, is reported once, where it is first.

The model trains in numpy on the templates, cut and noised, and on at most
about ``SAMPLE_ROWS`` documents' paragraphs, taken by digest of their id. Every
paragraph that can reach ``THRESHOLD`` is scored: the weights alone give words
(cues) without any of which no family can come that far before unknown, and a
bound on what each n-gram adds for any family; only paragraphs that one of the two
rules out aren't scored in full.

Defined cases: null and empty texts have no paragraphs; blank lines are none;
ties between families go to the first in name; rows repeated are scanned alike;
very long lines are scored whole; other columns stay.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, read_table

SAMPLE_ROWS, SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 1_000, 4_000, 400
MAX_FEATURES, THRESHOLD, OVERLAP = 512, 0.6, 0.5
#: Words that any prose has; which words stand here changes no result.
PLAIN = (
    "a", "about", "all", "an", "and", "any", "at", "be", "by", "can", "either", "for", "found", "free", "from", "if", "in", "into", "is", "it", "later", "may", "not", "of", "on", "one", "or", "person",
    "possible", "public", "that", "the", "this", "to", "under", "use", "was", "with", "without", "work", "you",
)
UNKNOWN = "unknown"

#: Usual notices by family (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 licence.",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights; CC0 public domain dedication."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "Released under the GNU GPL v2.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "reserved": ("All rights reserved.", "Copyright by the authors. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."),
}

_TOKEN = re.compile(r"[a-z0-9]+")


def grams(text: str) -> list[str]:
    words = _TOKEN.findall(text.lower())
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


#: Words of the longest template.
SPAN = max(len(_TOKEN.findall(t.lower())) for ts in TEMPLATES.values() for t in ts)


def needed(text: str) -> set[str]:
    """Words of a template of which every paragraph that confirms it has one.

    A paragraph with u of its different words has at most u words and, as each
    pair of neighbours counts at both, half the pairs that the u busiest words
    take part in. The least u that can reach ``OVERLAP`` leaves u - 1 words out:
    those that any prose has, then the shortest ones.
    """
    own = grams(text)
    words, pairs = [g for g in own if " " not in g], [g.split(" ") for g in own if " " in g]
    busy = Counter(w for p in pairs for w in p)
    most = sorted((busy[w] for w in words), reverse=True)
    u = next(u for u in range(1, len(words) + 1) if u + min(len(pairs), sum(most[:u]) // 2) >= OVERLAP * len(own))
    return set(sorted(words, key=lambda w: (w not in PLAIN, len(w), w))[u - 1 :])


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # in order; unknown comes last in the scores
    features: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    temperature: float

    def _margins(self) -> dict[str, np.ndarray]:
        return {g: np.array(w[:-1]) - w[-1] for g, w in self.features.items()}

    def _spare(self) -> np.ndarray:
        """What a family has to gain on unknown for ``THRESHOLD``."""
        return self.temperature * np.log(THRESHOLD / (1 - THRESHOLD)) + self.intercepts[-1] - np.array(self.intercepts[:-1]) - 1e-6

    def most(self) -> tuple[dict[str, float], float]:
        """The most that each feature adds to any family against unknown, and what a paragraph's features have to add up to before any family can have ``THRESHOLD``."""
        return {g: max(0.0, float(m.max())) for g, m in self._margins().items()}, float(self._spare().min())

    def cues(self) -> tuple[str, ...] | None:
        """Words of which a paragraph holds one if any family can have ``THRESHOLD``; None if a paragraph without any word can.

        A family with that probability has log odds against unknown of at least the logit of ``THRESHOLD``. Words are left out,
        the shortest first, while all that the features told by them can add stays under that for every family.
        """
        margins, spare = self._margins(), self._spare()
        if spare.min() <= 0:
            return None
        adds: dict[str, np.ndarray] = {}
        for g, margin in margins.items():
            if (margin > 0).any():
                word = max(g.split(" "), key=lambda v: (len(v), v))
                adds[word] = adds.get(word, 0) + np.maximum(margin, 0)
        cues = []
        for word in sorted(adds, key=lambda v: (len(v), (adds[v] / spare).max(), v)):
            if (adds[word] < spare).all():
                spare = spare - adds[word]
            else:
                cues.append(word)
        return tuple(cues)


def _noised(text: str, filler: list[str], rng: np.random.Generator) -> str:
    words = text.split()
    if len(words) > 6 and rng.random() < 0.5:
        a = int(rng.integers(0, len(words) // 3))
        words = words[a : len(words) - int(rng.integers(0, len(words) // 4 + 1))]
    words = [w for w in words if rng.random() > 0.04] or words
    if filler and rng.random() < 0.4:
        extra = list(rng.choice(filler, int(rng.integers(1, 8))))
        words = [*extra, *words] if rng.random() < 0.5 else [*words, *extra]
    return " ".join(words)


def train(negatives: list[str], copies: int = 25, seed: int = 5, rounds: int = 250, l1: float = 2e-4) -> Model:
    """Proximal gradient descent on templates and corpus paragraphs."""
    rng = np.random.default_rng(seed)
    families = tuple(sorted(TEMPLATES))
    known = [(f, set(grams(t))) for f in families for t in TEMPLATES[f]]
    rows: list[tuple[set[str], int]] = []
    clean = []
    for p in negatives:
        g = set(grams(p))
        if not any(len(t & g) >= OVERLAP * len(t) for _, t in known):
            clean.append(p)
            rows.append((g, len(families)))
    filler = [w for p in clean[:200] for w in p.split()][:2000]
    for i, f in enumerate(families):
        for t in TEMPLATES[f]:
            rows.append((set(grams(t)), i))
            rows += [(set(grams(_noised(t, filler, rng))), i) for _ in range(copies)]
    positives = [g for g, y in rows if y < len(families)]
    # Words of notices that stand alone or among others are unknown too: prose has them.
    loose = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    for _ in range(len(positives)):
        words = [*rng.choice(loose, int(rng.integers(1, 6))), *(rng.choice(filler, int(rng.integers(0, 8))) if filler else [])]
        g = set(grams(" ".join(rng.permutation(words))))
        if not any(len(t & g) >= OVERLAP * len(t) for _, t in known):
            rows.append((g, len(families)))
    count = Counter(x for g in positives for x in g)
    vocabulary = [x for x, c in count.items() if c >= 3]
    at = {x: j for j, x in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (g, _) in enumerate(rows):
        x[r, [at[w] for w in g if w in at]] = 1
    y = np.eye(len(families) + 1)[[c for _, c in rows]]
    weight = np.array([1.0 if c < len(families) else max(1.0, len(positives) / max(1, len(clean)) / len(families)) for _, c in rows])
    back = rng.random(len(rows)) < 0.2
    w, b = np.zeros((len(vocabulary), y.shape[1])), np.zeros(y.shape[1])
    b[-1] = 1.0
    tx, ty, tw = x[~back], y[~back], (weight[~back] / weight[~back].sum())[:, None]
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = tx @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - ty) * tw
        speed = 0.9 * speed - 0.5 * (tx.T @ e)
        w = w + speed
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * l1, 0)
        b = b - 0.5 * e.sum(0)
    keep = np.argsort(-np.abs(w).max(1), kind="stable")[:MAX_FEATURES]
    keep = keep[np.abs(w[keep]).max(1) > 0]
    z, best = x[back][:, keep] @ w[keep] + b, None
    for t in np.geomspace(0.2, 5, 40):
        nll = np.logaddexp.reduce(z / t, axis=1) - (z * y[back]).sum(1) / t
        if best is None or nll.mean() < best[0]:
            best = (nll.mean(), float(t))
    features = {vocabulary[j]: tuple(float(v) for v in w[j]) for j in keep}
    return Model(families, features, tuple(float(v) for v in b), best[1] if best else 1.0)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, paragraphs: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train with paragraphs of about ``rows`` documents as the unknown class."""
    total = docs.count()
    share = max(1, round(1_000_000 * min(1.0, rows / max(1, total))))
    sampled = docs.filter(F.pmod(F.xxhash64(doc_key(F.col("doc_id"))), F.lit(1_000_000)) < share)
    lines = sampled.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p")).distinct()
    short = lines.filter((F.size(F.split("p", " ")) <= SAMPLE_WORDS) & F.col("p").rlike("[a-zA-Z]"))
    return train([r["p"] for r in short.orderBy(F.md5("p"), "p").limit(paragraphs).collect()])


def _vector(values: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _table(values: dict[str, object], kind: str) -> Callable[[Column], Column]:
    """Look-up of constants by key: maps are searched from end to end, so keys are dealt over small ones by checksum."""
    parts: list[dict[str, object]] = [{} for _ in range(max(1, len(values)))]
    for key, value in values.items():
        parts[zlib.crc32(key.encode()) % len(parts)][key] = value
    dealt = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{kind}>>")
    return lambda key: F.element_at(F.get(dealt, F.pmod(F.crc32(key), F.lit(len(parts))).cast("int")), key)


def scan(df: DataFrame, model: Model, text: str = "text", out: str = "licences") -> DataFrame:
    """Add array<struct<paragraph, lines, family, probability, overlap, confirmed>> of the paragraphs that aren't unknown, and of wrapped notices. No shuffle, no Python."""
    names, n, cues = list(model.features), len(model.families), model.cues()
    # Constants, folded once when the plan is made; their size is bounded by MAX_FEATURES and the templates.
    weights = _table(model.features, "array<double>")
    templates = F.from_json(F.lit(json.dumps([[grams(t) for t in TEMPLATES[f]] for f in model.families])), "array<array<array<string>>>")

    single, double = [g for g in names if " " not in g], [g for g in names if " " in g]
    openers = sorted({g.split(" ")[0] for g in double})

    def words_of(p: Column) -> Column:
        return F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda w: w != "")

    def pairs_of(words: Column, pair: Callable[[Column, Column], Column]) -> Column:
        n_pairs = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, 1, n_pairs), F.slice(words, 2, n_pairs), pair)

    most, bar = model.most()
    bounds = _table(most, "double")

    def met(line: Column) -> Column:
        words = line["words"]
        pairs = pairs_of(words, lambda a, b: F.when(a.isin(openers), F.concat_ws(" ", a, b)))
        hits = F.array_distinct(F.concat(F.filter(words, lambda g: g.isin(single)), F.filter(pairs, lambda g: g.isin(double))))
        return F.struct(line["i"].alias("i"), line["lines"].alias("lines"), words.alias("words"), hits.alias("hits"))

    def possible(line: Column) -> Column:
        return F.aggregate(line["hits"], F.lit(0.0), lambda acc, g: acc + bounds(g)) >= bar

    def scored(line: Column) -> Column:
        raw = F.aggregate(line["hits"], _vector(model.intercepts), lambda acc, g: F.zip_with(acc, weights(g), lambda a, b: a + b))
        return F.struct(line["i"].alias("i"), line["lines"].alias("lines"), line["words"].alias("words"), raw.alias("z"))

    def decided(s: Column) -> Column:
        top = F.array_max(s["z"])
        exps = F.transform(s["z"], lambda v: F.exp((v - top) / model.temperature))
        total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
        inside = F.slice(s["z"], 1, n)
        best = F.array_position(inside, F.array_max(inside)).cast("int")
        probability = F.element_at(exps, best) / total
        return F.struct(s["i"].alias("paragraph"), s["lines"].alias("lines"), best.alias("best"), probability.alias("probability"), s["words"].alias("words"))

    def compared(d: Column) -> Column:
        own = F.array_distinct(F.concat(d["words"], pairs_of(d["words"], lambda a, b: F.concat_ws(" ", a, b))))
        overlap = F.array_max(F.transform(F.element_at(templates, d["best"]), lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))
        return F.struct(
            d["paragraph"].alias("paragraph"), d["lines"].alias("lines"), F.element_at(F.array(*[F.lit(f) for f in model.families]), d["best"]).alias("family"),
            d["probability"].alias("probability"), overlap.alias("overlap"), (overlap >= OVERLAP).alias("confirmed"),
        )

    def told(paragraphs: Column) -> Column:
        return F.transform(F.filter(F.transform(F.transform(F.filter(paragraphs, lambda s: possible(s)), scored), decided), lambda d: d["probability"] >= THRESHOLD), compared)

    split, gated, alone, wrapped, sure = (f"__licence_{x}" for x in ("words", "lines", "alone", "wrapped", "sure"))
    lines = F.transform(split, lambda words, i: F.struct(words.alias("words"), i.alias("i"), F.lit(1).alias("lines")))
    if cues is not None:
        lines = F.filter(lines, lambda s: F.exists(s["words"], lambda w: w.isin(list(cues))))
    heads = sorted({w for ts in TEMPLATES.values() for t in ts for w in needed(t)})
    span = F.lit(SPAN)
    nought = F.struct(F.array().cast("array<string>").alias("words"), F.lit(0).alias("n"))

    def gathered(rows: Column, add: Callable[[Column, Column], Column]) -> Column:
        """The words of lines one after the other, until there are as many as any template has."""
        return F.aggregate(rows, nought, lambda acc, row: F.when(F.size(acc["words"]) >= span, acc).otherwise(F.struct(add(acc["words"], row).alias("words"), (acc["n"] + 1).alias("n"))))

    def around(at: Column) -> Column:
        """The line of a needed word with the words before and after it."""
        i = at["i"]
        size = F.size(at["words"])
        own = F.when(size <= 2 * SPAN, at["words"]).otherwise(F.concat(F.slice(at["words"], 1, span), F.slice(at["words"], size - span + 1, span)))
        before = gathered(F.reverse(F.slice(F.col(split), F.greatest(F.lit(1), i + 1 - span), F.least(span, i))), lambda words, row: F.concat(F.slice(row, F.greatest(F.lit(1), F.size(row) - span + 1), span), words))
        after = gathered(F.slice(F.col(split), i + 2, span), lambda words, row: F.concat(words, F.slice(row, 1, span)))
        both = F.transform(F.array(F.struct(before.alias("a"), after.alias("z"))), lambda x: F.struct(F.concat(x["a"]["words"], own, x["z"]["words"]).alias("words"), (i - x["a"]["n"]).alias("i"), (x["a"]["n"] + x["z"]["n"] + 1).alias("lines")))
        return F.get(both, F.lit(0))

    anchors = F.filter(F.transform(split, lambda words, i: F.struct(words.alias("words"), i.alias("i"))), lambda s: F.exists(s["words"], lambda w: w.isin(heads)))
    joined = F.filter(F.transform(anchors, around), lambda s: s["lines"] > 1)
    by_line = F.array_distinct(F.transform(F.filter(alone, lambda d: d["confirmed"]), lambda d: d["family"]))
    families = F.array(*[F.lit(f) for f in model.families])
    first = F.transform(F.array_except(families, by_line), lambda f: F.get(F.filter(sure, lambda d: d["family"] == f), F.lit(0)))
    nothing = F.array().cast("array<struct<paragraph:int,lines:int,family:string,probability:double,overlap:double,confirmed:boolean>>")
    found = df.withColumn(split, F.transform(F.split(F.col(text), "\n"), words_of)).withColumn(gated, F.transform(lines, met))
    found = found.withColumn(alone, told(F.col(gated))).withColumn(wrapped, told(F.transform(joined, met))).withColumn(sure, F.filter(wrapped, lambda d: d["confirmed"]))
    either = F.concat(alone, F.array_sort(F.filter(first, lambda d: d.isNotNull())))
    return found.withColumn(out, F.when(F.col(text).isNotNull(), either).otherwise(nothing)).drop(split, gated, alone, wrapped, sure)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan(docs, fit(docs))
    sure = F.filter("licences", lambda d: d["confirmed"])
    paragraphs = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))))
    return scanned.select(
        "doc_id", paragraphs.cast("long").alias("n_paragraphs"), F.size("licences").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda d: d["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda d: F.concat_ws(":", d["paragraph"].cast("string"), d["family"], F.round(d["probability"], 4).cast("string"), F.round(d["overlap"], 4).cast("string"))), ",").alias("detail"),
    )
