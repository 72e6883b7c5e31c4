"""Licence scan: which licence family the paragraphs of a document name.

Paragraphs are lines. Their features are the word bigrams and trigrams that occur
in the licence templates. A multinomial logistic regression with an L1 penalty,
trained on cut and framed templates and on a bounded sample of other paragraphs,
leaves most weights at zero. Its probabilities are scaled on held-out rows
(temperature), and the lowest probability that is precise enough there becomes
the threshold below which a paragraph that looks like a licence is of an unknown
family. A prediction counts as confirmed if most trigrams of the paragraph or of
a template are shared between them; an unconfirmed one is unknown, too.

Everything that reads the corpus is DataFrame expressions: words are exploded
beside their successors, joined with the broadcast feature table (its size is
that of the templates) and collected per paragraph as a set of feature numbers,
which the number of features bounds. A paragraph without features has the
intercepts only, which say "none", and needs no row.

Nulls and ties: a null or empty text has family "none"; equal probabilities go to
the family that comes first by name; repeated rows get equal results; an empty
table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, texts_of

# Notices as they are commonly used, by family (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This work is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the terms of the GNU GPL, version 2 or later.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "This document is confidential and proprietary."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Sentences with words of licences that name none; they keep the unknown class honest.
OTHERS = [
    "The driver's license was issued by the county and is valid for four years.", "You need written permission from your parents to enter the park.", "The rights of the tenant are described in the second chapter.",
    "This version of the song was released under another title.", "The software was distributed with a printed manual and a free copy of the map.", "Public transport is free of charge for any person under the age of six.",
    "The terms of the agreement were published by the foundation in May.", "A general strike was called by the public sector unions.", "All seats are reserved for members of the club.", "The work is protected from rain by a large roof.",
]

#: Paragraphs without licence wording that training may take from the corpus, and documents they come from.
NEGATIVES, NEGATIVE_DOCS = 1000, 200

#: Precision that the probability threshold must reach on held-out rows.
PRECISION = 0.99

NONE, UNKNOWN = "none", "unknown"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams_of(words: Column) -> Column:
    """Bigrams and trigrams of a word array."""
    zipped = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"), F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(1))).alias("c"))
    pairs = F.transform(F.filter(zipped, lambda z: z["b"].isNotNull()), lambda z: F.concat_ws(" ", z["a"], z["b"]))
    triples = F.transform(F.filter(zipped, lambda z: z["c"].isNotNull()), lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"]))
    return F.array_distinct(F.concat(pairs, triples))


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table from values known to the driver, as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))


def _grams(text: str) -> set[str]:
    import re

    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def _variants(text: str) -> list[str]:
    """The template, its halves, and it in frames of other words."""
    w = text.split()
    half = max(4, (2 * len(w)) // 3)
    return [text, " ".join(w[:half]), " ".join(w[-half:]), f"notice: {text}", f"{text} see the file for details", f"copyright 2021 the authors. {text}", " ".join(w[1:]), " ".join(w[:-1])]


class Model:
    """Features, weights, temperature and threshold; all of the templates' size."""

    def __init__(self, features: list[str], names: list[str], weights, intercepts, temperature: float, threshold: float):
        self.features, self.names, self.weights, self.intercepts = features, names, weights, intercepts
        self.temperature, self.threshold = temperature, threshold

    def probabilities(self, numbers: Column) -> Column:
        """Array of the classes' probabilities from an array of feature numbers."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<array<double>>")
        start = F.from_json(F.lit(json.dumps(self.intercepts)), "array<double>")
        score = F.aggregate(numbers, start, lambda a, f: F.zip_with(a, F.get(table, f), lambda x, y: x + y))
        scaled = F.transform(score, lambda x: x / F.lit(self.temperature))
        raised = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def train(docs: DataFrame) -> Model:
    """Fits the classifier on templates and at most ``NEGATIVES`` paragraphs of ``NEGATIVE_DOCS`` documents."""
    spark = docs.sparkSession
    names = [NONE, *sorted(TEMPLATES)]
    features = sorted(set().union(*(_grams(t) for ts in TEMPLATES.values() for t in ts)))
    rows = [(v, names.index(name), len(v) % 4 == 3) for name, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    rows += [(v, 0, k % 2 == 1) for o in OTHERS for k, v in enumerate(_variants(o))]
    positive = _rows(spark, [{"text": t, "label": label, "held": held} for t, label, held in rows], "text: string, label: double, held: boolean")
    some = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVE_DOCS).select(F.explode(F.split("text", "\n")).alias("text"))
    plain = some.where("length(text) > 0").withColumn("label", F.lit(0.0)).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    triples = [f for f in features if f.count(" ") == 2]
    plain = plain.select("*", ngrams_of(words_of(F.col("text"))).alias("grams")).where(~F.exists("grams", lambda g: g.isin(triples))).orderBy(F.xxhash64("text")).limit(NEGATIVES)
    every = positive.select("*", ngrams_of(words_of(F.col("text"))).alias("grams")).unionByName(plain).select("label", "held", "grams")
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    data = vectors.transform(every).coalesce(1).cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, standardization=False).fit(data.where("not held"))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = [[round(float(x), 6) for x in matrix[:, j]] for j in range(len(features))]
    model = Model(features, names, weights, [round(float(x), 6) for x in intercepts], 1.0, 0.5)
    # raw scores of the held-out rows, scaled by each temperature in turn
    held = fitted.transform(data.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))

    def softmax(t: float) -> Column:
        raised = F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / F.lit(t)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))

    tries = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
    losses = held.agg(*[F.avg(-F.log(F.greatest(F.get(softmax(t), F.col("label").cast("int")), F.lit(1e-9)))).alias(f"t{k}") for k, t in enumerate(tries)]).first()
    model.temperature = tries[min(range(len(tries)), key=lambda k: losses[f"t{k}"])]
    p = softmax(model.temperature)
    judged = held.select("label", F.array_max(p).alias("p"), (F.array_position(p, F.array_max(p)) - 1).alias("best")).where("best > 0")
    steps = [i / 20 for i in range(6, 20)]
    right = judged.agg(*[F.avg(F.when(F.col("p") >= s, (F.col("best") == F.col("label")).cast("double"))).alias(f"s{k}") for k, s in enumerate(steps)]).first()
    model.threshold = next((s for k, s in enumerate(steps) if (right[f"s{k}"] or 0) >= PRECISION), steps[-1])
    data.unpersist()
    return model


def scan_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, paragraph, family, probability, confirmed) of every paragraph that looks like a licence."""
    spark = docs.sparkSession
    features = _rows(spark, [{"gram": g, "number": i} for i, g in enumerate(model.features)], "gram: string, number: int")
    firsts = sorted({g.split()[0] for g in model.features})
    lines = docs.select(row_key().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    worded = lines.select("row", "doc_id", "paragraph", words_of(F.col("line")).alias("w"))
    wide = worded.where("size(w) > 1").select("row", "doc_id", "paragraph", F.size("w").alias("n"), F.inline(F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), F.size("w")).alias("w2"), F.slice("w", F.lit(3), F.size("w")).alias("w3"))))
    near = wide.where(F.col("w1").isin(firsts) & F.col("w2").isNotNull())
    grams = near.select("row", "doc_id", "paragraph", "n", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.when(F.col("w3").isNotNull(), F.concat(F.col("w1"), F.lit(" "), F.col("w2"), F.lit(" "), F.col("w3"))))).alias("gram"))
    met = grams.join(F.broadcast(features), "gram")  # the templates bound its size
    numbered = met.groupBy("row", "doc_id", "paragraph", "n").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    p = numbered.withColumn("p", model.probabilities(F.col("numbers"))).withColumn("probability", F.array_max("p")).withColumn("best", F.array_position("p", F.col("probability")).cast("int") - 1)
    likely = p.where(F.get("p", F.lit(0)) < 0.5)
    # trigrams of each template, as feature numbers
    number = {g: i for i, g in enumerate(model.features)}
    shapes = [[[number[g] for g in sorted(_grams(t)) if g.count(" ") == 2] for t in TEMPLATES.get(name, [])] for name in model.names]
    templates = F.get(F.from_json(F.lit(json.dumps(shapes)), "array<array<array<int>>>"), F.col("best"))
    own = F.greatest(F.col("n") - 2, F.lit(1))
    confirmed = F.exists(templates, lambda t: F.greatest(F.size(F.array_intersect(t, "numbers")) / own, F.size(F.array_intersect(t, "numbers")) / F.greatest(F.size(t), F.lit(1))) >= 0.5)
    name = F.get(F.array(*[F.lit(x) for x in model.names]), F.col("best"))
    sure = (F.col("probability") >= model.threshold) & F.col("confirmed") & (F.col("best") > 0)
    return likely.withColumn("confirmed", confirmed).select("row", "doc_id", "paragraph", F.when(sure, name).otherwise(UNKNOWN).alias("family"), "probability", "confirmed")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: (doc_id, family, probability, confirmed, n_paragraphs, families).

    ``family`` is that of the most probable confirmed paragraph, else "unknown"
    if a paragraph looks like a licence, else "none"; ``families`` are all that
    its paragraphs name.
    """
    texts = texts_of(docs)
    found = scan_paragraphs(texts, train(texts))
    order = F.struct(F.col("confirmed"), F.col("family") != UNKNOWN, F.col("probability"), -F.col("paragraph"))
    by_row = found.groupBy("row").agg(
        F.max_by("family", order).alias("family"), F.max_by("probability", order).alias("probability"), F.max_by("confirmed", order).alias("confirmed"),
        F.count("*").alias("n_paragraphs"), F.sort_array(F.collect_set("family")).alias("families"),
    )
    every = texts.select("doc_id", row_key().alias("row"))
    return every.join(by_row, "row", "left").select(
        "doc_id", F.coalesce("family", F.lit(NONE)).alias("family"), F.round(F.coalesce("probability", F.lit(0.0)), 6).alias("probability"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
