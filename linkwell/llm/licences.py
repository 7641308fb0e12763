"""Licence scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are the lines of a text, and, as notices are wrapped, up to LINES neighbouring lines
of at most WRAP characters together. Of paragraphs that share a line the one confirmed by the
larger share of a template, then that of fewer lines, counts. Features are the distinct words and word pairs of a
paragraph that the vocabulary has. A multinomial logistic regression over sparse n-grams is
trained on templates (written out and varied by rule) and, for the class ``unknown``, on
decoys and a bounded sample of the corpus: SAMPLE_LINES lines, of LINE_CHARS characters at most, of
SAMPLE documents, in the order of a hash of their ids, less those that look like a template.
A scale of all scores and a shift of the class unknown calibrate probabilities on templates that
the weights have not seen, each fold's scored by a fit to the others; below LEAST_PROBABILITY a paragraph is unknown.
A licence is confirmed where one of its templates' word pairs are in the paragraph to the
share LEAST_SIMILARITY or more.

Main path: DataFrame functions only. Paragraphs without a cue are not scored: cues are all
words of the vocabulary but some that, taken all together with their pairs, reach
LEAST_PROBABILITY in no family under the fitted weights; nor are those whose grams' largest
gains together do not reach it. So what is skipped is unknown whatever the sample was; the
sample only says which words are worth leaving out. Weights and templates are small tables
of fixed size, broadcast.

Defined results: null and empty texts have no paragraph; a paragraph without a gram of the
vocabulary is unknown; every paragraph of a known family is a row, repeated rows' too; of families
of one probability the first by name counts; lines of any length are taken whole; empty tables give
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.llm.folds import sampled
from linkwell.llm.runtime import written

#: Fixed texts: notices by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file in the project root.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Licensed under GPL v3 or later.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is distributed under the LGPL license."],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying is strictly prohibited."],
}
#: Fixed texts of no licence that use the same words.
DECOYS = [
    "Her driving licence expired in March.",
    "The number on the license plate was hard to read.",
    "The doctor is licensed to practise in two states.",
    "A version of the work was released under another name.",
    "The general public was free to use the library.",
    "Er kam mit dem Zug und ging mit ihr nach Hause.",
    "The rights of the child were reserved for the next session.",
    "The Apache helicopter was developed in the seventies.",
    "The source of the river is subject to the terms of the treaty.",
    "Permission to land was granted by the tower.",
]
FRAMES = ["{}", "note: {}", "{} thank you.", "this file: {}", "(c) the authors. {}", "the text below: {}"]
FOLDS = 3
SAMPLE = 300
SAMPLE_LINES, LINE_CHARS = 3000, 2000
LINES, WRAP = 4, 200
LEAST_PROBABILITY = 0.6
LEAST_SIMILARITY = 0.6
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:[.][0-9]+)?"


def grams(text: str) -> list[str]:
    """The distinct words and word pairs of a paragraph."""
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def gram_column(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def pairs_of(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fitted(x: np.ndarray, y: np.ndarray, each: np.ndarray, families: int) -> np.ndarray:
    """Weights of the regression by gradient descent; ``each`` weighs the rows."""
    hot, w, share = np.eye(families)[y], np.zeros((x.shape[1], families)), (each / each.sum())[:, None]
    for step in range(300):
        w -= 8.0 / (1 + step / 100) * (x.T @ ((_softmax(x @ w) - hot) * share) + 1e-4 * w)
    return w


def train(unknown_lines: list[str]) -> dict:
    """The classifier as plain tables: families, vocabulary, weights, temperature and cues."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    rows, labels, folds = [], [], []
    for family, texts in sorted(TEMPLATES.items()):
        for no, text in enumerate(texts):
            for frame in FRAMES:
                rows.append(grams(frame.format(text)))
                labels.append(families.index(family))
                folds.append(no % FOLDS if len(texts) > 1 else -1)
    known = [set(pairs_of(t)) for texts in TEMPLATES.values() for t in texts]
    unlike = lambda texts: [g for t in texts if (g := grams(t)) and not any(len(k & set(g)) > 0.4 * len(k) for k in known)]
    decoys = unlike(DECOYS)
    other = decoys + unlike(unknown_lines)
    rows, labels = rows + other, labels + [0] * len(other)
    of_templates = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)} | {g for t in DECOYS for g in grams(t)}
    vocabulary = sorted(of_templates)
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for i, r in enumerate(rows):
        x[i, [at[g] for g in r if g in at]] = 1
    x[:, -1] = 1
    y = np.array(labels)
    # the templates of a family go to folds in turn, a family's only one to none; other rows go at random
    fold = np.concatenate([np.array(folds, int), np.random.default_rng(5).integers(0, FOLDS, len(other))])
    # rows of a kind weigh as much as those of any other: the families, decoys, and lines of the corpus
    decoy = np.isin(np.arange(len(y)) - len(folds), range(len(decoys)))
    kind = np.where(decoy, len(families), y)
    each = 1 / np.bincount(kind)[kind]
    w = _fitted(x, y, each, len(families))
    logits = np.zeros((len(y), len(families)))
    for f in range(FOLDS):
        held = fold == f
        logits[held] = x[held] @ _fitted(x[~held], y[~held], each[~held], len(families))
    held = fold >= 0
    losses = []
    for scale in np.linspace(0.2, 3, 29):
        for shift in np.linspace(-3, 3, 25):
            p = _softmax(logits[held] * scale + np.eye(len(families))[0] * shift)[np.arange(held.sum()), y[held]]
            losses.append((float((-np.log(p + 1e-12) * each[held]).sum()), scale, shift))
    _, scale, shift = min(losses)
    weights = w * scale
    weights[-1, 0] += shift
    seen = Counter(g for t in unknown_lines for g in grams(t))
    return {"families": families, "vocabulary": vocabulary, "weights": weights, "cues": cues_of(vocabulary, weights, seen)}


def leads(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What each gram adds at most to each family's lead over the class unknown, the lead
    without any gram, and the lead that a family of LEAST_PROBABILITY has at least."""
    least = LEAST_PROBABILITY - 1e-6  # probabilities are rounded
    ahead = weights[:, 1:] - weights[:, :1]
    return np.maximum(ahead[:-1], 0), ahead[-1], float(np.log(least / (1 - least))) - 1e-9


def cues_of(vocabulary: list[str], weights: np.ndarray, seen: Counter) -> list[str]:
    """The words of which a paragraph needs one at least to reach LEAST_PROBABILITY.

    A family of that probability leads the class unknown by ``lead`` or more. The words that
    are no cues, the most often ``seen`` first, are as many as stay below it in every family
    with all their grams of positive weight.
    """
    gains, bias, lead = leads(weights)
    grams_of = [set(g.split(" ")) for g in vocabulary]
    words = sorted((g for g in vocabulary if " " not in g), key=lambda g: (-seen[g], g))
    plain: set[str] = set()
    for word in words:
        more = plain | {word}
        if (gains[[g <= more for g in grams_of]].sum(axis=0) + bias < lead).all():
            plain = more
    return sorted(set(words) - plain)


def cue_pattern(cues: list[str]) -> str:
    """Matches every lower-cased text that has a cue among its words, and few others."""
    # a word may follow the digits of another, as in 4.0license, and a fraction may be followed by letters
    return "(?<![a-z])(?:" + "|".join(re.escape(c) + ("(?![0-9])" if "." in c else "(?![a-z0-9])") for c in cues) + ")" if cues else "$^"


def sample_lines(docs: DataFrame) -> list[str]:
    """Lines of a bounded sample of documents, for the class unknown."""
    chosen = sampled(docs, "doc_id", SAMPLE, F.lit(docs.count())).where(F.col("text").isNotNull()).select("text", F.md5(F.col("doc_id").cast("string")).alias("ord")).orderBy("ord", "text").limit(SAMPLE)
    lines = chosen.select("ord", F.posexplode(F.split("text", "\n")).alias("no", "line")).where((F.trim("line") != "") & (F.length("line") <= LINE_CHARS))
    lines = lines.orderBy(F.md5(F.concat_ws(" ", "ord", "no")), "line").limit(SAMPLE_LINES)
    return [r.line for r in lines.collect()]


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(row_id, doc_id, paragraph, n_lines, family, probability, similarity, confirmed, body): the
    paragraphs of a known family. ``paragraph`` is their first line, counted from 0."""
    spark = docs.sparkSession
    model = model or train(sample_lines(docs))
    families = model["families"]
    names = [f"w{i}" for i in range(len(families))]
    weights = spark.createDataFrame(
        [(g, *map(float, w)) for g, w in zip(model["vocabulary"], model["weights"][:-1], strict=True)], ", ".join(["gram string", *(f"{n} double" for n in names)])
    )
    cue = cue_pattern(model["cues"])
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.lower("text").rlike(cue))
    lines = rows.select("row_id", "doc_id", F.split("text", "\n").alias("lines"))
    wrapped = lambda part: F.forall(part, lambda x: (F.trim(x) != "") & (F.length(x) <= WRAP))
    joined = lambda i, k: F.struct(i.alias("paragraph"), k.alias("n_lines"), F.array_join(F.slice("lines", i + 1, k), " ").alias("body"))
    none = F.array().cast("array<struct<paragraph:int,n_lines:int,body:string>>")

    def of_line(line: Column, i: Column) -> Column:
        more = F.filter(F.sequence(F.lit(2), F.lit(LINES)), lambda k: (i + k <= F.size("lines")) & wrapped(F.slice("lines", i + 1, k)))
        return F.when(F.lower(line).rlike(cue), F.transform(F.concat(F.array(F.lit(1)), more), lambda k: joined(i, k))).otherwise(none)

    paragraphs = lines.select("row_id", "doc_id", F.inline(F.flatten(F.transform("lines", of_line))))
    # a paragraph whose grams' largest gains do not make up the lead is unknown too
    gains, alone, lead = leads(model["weights"])
    known = {g: float(x) for g, x in zip(model["vocabulary"], gains.max(axis=1), strict=True) if x > 0}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    featured = paragraphs.withColumn("grams", F.array_intersect(gram_column(F.col("body")), F.lit(model["vocabulary"])))
    reach = F.aggregate("grams", F.lit(float(alone.max())), lambda a, g: a + F.coalesce(F.try_element_at(table, g), F.lit(0.0)))
    featured = featured.where(reach >= lead - 1e-6)
    # the paragraph goes along: ids given in a second reading of the rows might be others
    scored = featured.select("row_id", "doc_id", "paragraph", "n_lines", "body", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    bias = model["weights"][-1]
    whole = [F.first(c).alias(c) for c in ("doc_id", "body")]
    scored = scored.groupBy("row_id", "paragraph", "n_lines").agg(*whole, *[(F.sum(n) + float(b)).alias(n) for n, b in zip(names, bias, strict=True)])
    top = F.greatest(*names)
    total = sum((F.exp(F.col(n) - top) for n in names[1:]), F.exp(F.col(names[0]) - top))
    best = F.coalesce(*[F.when(F.col(n) == top, F.lit(f)) for n, f in zip(names, families, strict=True)])
    scored = scored.select("row_id", "doc_id", "paragraph", "n_lines", "body", best.alias("family"), F.round(1 / total, 6).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
    templates = spark.createDataFrame([(f, pairs_of(t)) for f, texts in sorted(TEMPLATES.items()) for t in texts], "family string, pairs array<string>")
    found = scored.withColumn("grams", gram_column(F.col("body"))).join(F.broadcast(templates), "family")
    share = F.size(F.array_intersect("grams", "pairs")) / F.size("pairs")
    found = found.groupBy("row_id", "paragraph", "n_lines").agg(
        F.first("doc_id").alias("doc_id"), F.first("family").alias("family"), F.first("probability").alias("probability"),
        F.round(F.max(share), 6).alias("similarity"), F.first("body").alias("body"),
    )
    found = written(found.withColumn("confirmed", F.col("similarity") >= LEAST_SIMILARITY), "licences")
    # the best paragraph of each line; a paragraph stays that is the best of all its lines
    value = F.struct(F.when(F.col("confirmed"), F.col("similarity")).otherwise(0.0), -F.col("n_lines"), "probability", -F.col("paragraph"))
    of = found.select("row_id", "paragraph", "n_lines", value.alias("value"), F.explode(F.sequence("paragraph", F.col("paragraph") + F.col("n_lines") - 1)).alias("line"))
    best = of.groupBy("row_id", "line").agg(F.max(F.struct("value", "paragraph", "n_lines")).alias("x"))
    best = best.groupBy("row_id", "x.paragraph", "x.n_lines").agg(F.count("*").alias("lines")).where(F.col("lines") == F.col("n_lines"))
    return found.join(best.drop("lines"), ["row_id", "paragraph", "n_lines"]).select(
        "row_id", "doc_id", "paragraph", "n_lines", "family", "probability", "similarity", "confirmed", "body"
    )
