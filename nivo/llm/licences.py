"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, lower_ascii, words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NONE, UNKNOWN = "none", "unknown"

# Notices as licences themselves, or the files under them, word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is made available under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL, version 2 or later.",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    UNKNOWN: (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Licensed under the terms of the community license.",
        "Licensed under the Foo License.",
        "Released under the Example Public License, version 1.0.",
        "Released under a custom license.",
        "Use of this material is subject to the license agreement.",
        "See the license file for the terms of use.",
        "This work is licensed under the terms given by its publisher.",
        "Copyright (c) 2019 by the publisher.",
        "All rights reserved by the author.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Released under the Artistic License 2.0.",
        "Licensed under the zlib License.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the European Union Public Licence, version 1.2.",
        "This software is distributed under the Microsoft Public License.",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX-License-Identifier: Zlib",
    ),
}
OPENINGS = ("", "this work is", "this text is", "the source code is", "it is")

#: Bounds of the sample of paragraphs without a licence, and of the n-grams in the model.
NEGATIVES = 4_000
#: Words of each of them that are learned from; a scan takes paragraphs whole.
NEGATIVE_WORDS = 200
MOST_FEATURES = 5_000
#: A word in more than this share of those paragraphs is no feature by itself.
COMMON = 0.01
#: Share of the n-grams of the shorter of paragraph and template that the other has to have.
CONFIRM = 0.6
TEMPERATURES = (0.5, 0.7, 1.0, 1.5, 2.0, 3.0)


def pairs(tokens: Column) -> Column:
    """Word pairs in order."""
    n = F.size(tokens)
    return F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def grams(tokens: Column) -> Column:
    """Distinct words and word pairs."""
    return F.array_distinct(F.concat(tokens, pairs(tokens)))


def paragraphs(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """``paragraph`` (its number), ``tokens`` of every line that has words."""
    # Split into words before the rows are multiplied: later filters then need not split again.
    lines = F.transform(
        F.split(lower_ascii(F.col(f"`{text}`")), "\n"), lambda line: words(line, SEPARATORS)
    )
    return docs.select(*columns, F.posexplode(lines).alias("paragraph", "tokens")).where(
        F.size("tokens") > 0
    )


def examples() -> list[tuple[str, str]]:
    """Label and text of each template: whole, opened in other ways, and with its ends cut off."""
    out = []
    for label, lines in TEMPLATES.items():
        for line in lines:
            tokens = line.split()
            cut = max(0, len(tokens) * 3 // 10) if len(tokens) > 5 else 0
            out += [(label, f"{opening} {line}") for opening in OPENINGS]
            out += [(label, " ".join(tokens[start:])) for start in range(1, cut + 1)]
            out += [(label, " ".join(tokens[:-end])) for end in range(1, cut + 1)]
    return out


@dataclass(frozen=True)
class Model:
    """Weights per n-gram and class, and what calibration found."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    temperature: float
    least: float

    @property
    def cues(self) -> list[str]:
        """The single words of the model; each of its n-grams has one at least."""
        return sorted(gram for gram in self.weights if " " not in gram)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Sparse multinomial logistic regression on templates and a bounded sample of other paragraphs.

    Other paragraphs are drawn by a hash of their document's key, and taken to have no licence if they share
    no word pair with a template, those of unknown licences included. Every fifth example is held out of training; on these the temperature
    that scales the scores is fitted, and the least probability at which a family is still believed: the
    lowest that no held-out paragraph of another class reaches wrongly.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    drawn = docs.where(
        F.pmod(F.xxhash64(F.lit(7), F.col(f"`{key}`").cast("string")), F.lit(1_000_000))
        < 1_000_000 * min(1.0, NEGATIVES / max(n_docs, 1))
    )
    positive = spark.createDataFrame(examples(), "label string, line string").select(
        "label", words(lower_ascii(F.col("line")), SEPARATORS).alias("tokens")
    )
    known = [
        row[0]
        for row in positive.select(F.explode(pairs(F.col("tokens")))).distinct().collect()
    ]
    template_words = [row[0] for row in positive.select(F.explode("tokens")).distinct().collect()]
    other = (
        paragraphs(drawn, text, F.col(f"`{key}`").alias("id"))
        .withColumn("order", F.xxhash64("id", "paragraph"))
        .where(~F.exists(pairs(F.col("tokens")), lambda pair: pair.isin(known)))
        .orderBy("order", "id", "paragraph")
        .limit(NEGATIVES)
        .select(F.lit(NONE).alias("label"), F.slice("tokens", 1, NEGATIVE_WORDS).alias("tokens"))
    )
    scratch = Scratch(spark, "licences")
    sample = scratch.write(
        positive.union(other).withColumn("fold", F.pmod(F.xxhash64("tokens"), F.lit(5))).coalesce(1),
        "sample",
    )
    negatives = sample.where(F.col("label") == NONE)
    share = COMMON * max(negatives.count(), 1)
    often = {
        row[0]
        for row in negatives.select(F.explode(F.array_distinct("tokens")).alias("word"))
        .where(F.col("word").isin(template_words))
        .groupBy("word")
        .count()
        .where(F.col("count") > share)
        .collect()
    }
    rare = sorted(set(template_words) - often)
    classes = (NONE, *TEMPLATES)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    is_feature = lambda gram: F.exists(F.split(gram, " "), lambda word: word.isin(rare))
    featured = sample.select(
        number.cast("double").alias("target"), "fold", F.filter(grams(F.col("tokens")), is_feature).alias("grams")
    )
    counted = CountVectorizer(
        inputCol="grams", outputCol="features", binary=True, vocabSize=MOST_FEATURES, minDF=2.0
    ).fit(featured.where(F.col("target") > 0))
    vectors = scratch.write(counted.transform(featured).select("target", "fold", "features"), "vectors")
    fitted = LogisticRegression(
        labelCol="target", family="multinomial", regParam=0.001, maxIter=60, aggregationDepth=2
    ).fit(vectors.where("fold <> 0").coalesce(1))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {
        gram: tuple(float(x) for x in matrix[:, at]) for at, gram in enumerate(counted.vocabulary)
    }
    for word in rare:  # A pair's rare word is a cue, be it a feature or not.
        weights.setdefault(word, (0.0,) * len(classes))
    held_out = [
        (int(row["target"]), [float(x) for x in row["rawPrediction"]])
        for row in fitted.transform(vectors.where("fold = 0")).collect()
    ]
    temperature = min(TEMPERATURES, key=lambda t: sum(-_log_softmax(s, t)[k] for k, s in held_out))
    wrong = [
        math.exp(max(scaled))
        for k, scores in held_out
        if (scaled := _log_softmax(scores, temperature)) and scaled.index(max(scaled)) not in (0, k)
    ]
    scratch.drop("sample", "vectors")
    intercepts = tuple(float(x) for x in fitted.interceptVector)
    return Model(classes, weights, intercepts, temperature, min(0.9, max([0.5, *wrong])))


def _log_softmax(scores: list[float], temperature: float) -> list[float]:
    scaled = [s / temperature for s in scores]
    top = max(scaled)
    total = top + math.log(sum(math.exp(s - top) for s in scaled))
    return [s - total for s in scaled]


def _weight_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(gram, list(values)) for gram, values in model.weights.items()]
    return spark.createDataFrame(rows, "gram string, weights array<double>")


def _template_table(spark: SparkSession) -> DataFrame:
    rows = [(label, line) for label, lines in TEMPLATES.items() if label != UNKNOWN for line in lines]
    return spark.createDataFrame(rows, "family string, line string").select(
        "family", F.array_distinct(pairs(words(lower_ascii(F.col("line")), SEPARATORS))).alias("template")
    )


def scan(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per paragraph that the model takes for a licence notice: ``key``, ``paragraph``,
    ``family`` (a licence family or ``unknown``), ``probability`` and ``agreement``.

    Every line of every text is scored. A line without any of the model's words scores as an empty one, which is
    no notice, so only lines with such a word have their n-grams looked up; the model (MOST_FEATURES
    n-grams and the words of the templates) is broadcast. A family stands if its calibrated probability is high
    enough and one of its templates agrees: ``agreement`` is the share of the word pairs of the
    shorter of the two that the other has. A notice whose family does not stand is ``unknown``.

    NULL and blank texts have no paragraphs. Rows with NULL keys are scanned too. Repeated rows have
    repeated results, also where they share a key. An empty table gives no rows. Only the key and the text
    are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    cued = paragraphs(rows, "_text", F.col(f"`{key}`").alias(key), F.col("_row")).where(
        F.exists("tokens", lambda word: word.isin(model.cues))
    )
    # As many rows as the model has n-grams; as many as there are templates.
    weights = F.broadcast(_weight_table(spark, model))
    templates = F.broadcast(_template_table(spark))
    sums = [
        F.sum(F.element_at("weights", at + 1)).alias(f"s{at}") for at in range(len(model.classes))
    ]
    scored = (
        cued.withColumn("gram", F.explode(grams(F.col("tokens"))))
        .join(weights, "gram")
        .groupBy(F.col(f"`{key}`"), "_row", "paragraph")
        .agg(F.first("tokens").alias("tokens"), *sums)
    )
    scores = F.array(
        *[
            (F.col(f"s{at}") + F.lit(intercept)) / F.lit(model.temperature)
            for at, intercept in enumerate(model.intercepts)
        ]
    )
    best = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda sum_, s: sum_ + F.exp(s - best))
    names = F.array(*[F.lit(c) for c in model.classes])
    judged = (
        scored.withColumn("scores", scores)
        .withColumn("family", F.element_at(names, F.array_position("scores", best).cast("int")))
        .where(F.col("family") != NONE)
        .withColumn("probability", 1 / total)
        .select(F.col(f"`{key}`"), "_row", "paragraph", "family", "probability",
                F.array_distinct(pairs(F.col("tokens"))).alias("own"))
    )
    agreement = F.size(F.array_intersect("own", "template")) / F.greatest(
        F.least(F.size("own"), F.size("template")), F.lit(1)
    )
    confirmed = (
        judged.join(templates, "family", "left")
        .groupBy(F.col(f"`{key}`"), "_row", "paragraph", "family", "probability")
        .agg(F.max(F.coalesce(agreement, F.lit(0.0))).alias("agreement"))
    )
    stands = (F.col("probability") >= model.least) & (F.col("agreement") >= CONFIRM)
    return confirmed.select(
        F.col(f"`{key}`"),
        F.col("paragraph"),
        F.when(stands, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability",
        "agreement",
    )


def per_document(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: ``key``, ``families`` (in order, comma-joined), ``n_notices`` and ``n_unknown``.

    A row is known by key and text, so NULL keys keep their notices, rows that share a key have their own, and
    repeated rows have equal results. Rows without notices, blank and NULL texts among them, have an empty list and 0.
    """
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(F.col(f"`{key}`").alias("key"), F.md5(body).alias("print")).alias("row"), body.alias("text"))
    # Rows of one key and text have the same notices.
    found = scan(rows, model, key="row").select("row", "paragraph", "family").distinct()
    counted = found.groupBy(F.col("row.key").alias("k"), F.col("row.print").alias("p")).agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.count_if(F.col("family") != UNKNOWN).alias("n_notices"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
    )
    same = F.col("row.key").eqNullSafe(F.col("k")) & (F.col("row.print") == F.col("p"))
    none = F.lit(0).cast("long")
    return rows.select("row").join(counted, same, "left").select(
        F.col("row.key").alias(key),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_notices", none).alias("n_notices"),
        F.coalesce("n_unknown", none).alias("n_unknown"),
    )
