"""Licence paragraphs by a trained classifier; DataFrame functions and Spark ML only.

Word n-grams that hold a licence word are the features: sparse, and absent from almost all
text. A multinomial logistic regression with an L1 penalty tells licence families, licence
language of no known family (``unknown``) and other text (``none``) apart; its probabilities
are calibrated by a temperature on variants it was not fitted on. A family counts only if the
paragraph also holds enough of one of the family's templates.
"""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, lowest, real_id, settled

# FIXED VALUES: notices by which the licences are commonly declared
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without "
            "modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.",
             "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining "
            "a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "unknown": ["All rights reserved.", "Use of this work is subject to the license agreement.",
                "See the LICENSE file for license terms.", "Distributed under a proprietary license.",
                "Licensed for personal use only.", "Copyright notice and permission terms apply."],
}
NONE, UNKNOWN = "none", "unknown"
# FIXED VALUES: words that name a licence or its object whatever the family
GENERAL = ["license", "licensed", "licence", "copyright"]
CLASSES = [NONE, *sorted(TEMPLATES)]
#: Bounds of the training sample: other paragraphs from the corpus, and variants of each template.
OTHERS = 4000
VARIANTS = 24
#: A template word in more than this share of the other paragraphs is no licence word.
COMMON = 0.002
PENALTY = 2e-4
CERTAIN = 0.6
ALIKE = 0.5
#: Lines that are also scored together inside a longer paragraph.
SPAN = 8


def words(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(w: Column, licence_words: Column) -> Column:
    """Distinct runs of 1, 2 and 3 words (``w``) that hold a licence word."""
    def runs(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        some = F.transform(at, lambda i: F.slice(w, i + 1, F.lit(n)))
        some = F.filter(some, lambda x: F.arrays_overlap(x, licence_words))
        return F.when(F.size(w) >= n, F.transform(some, lambda x: F.array_join(x, " "))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(did, th, para, p): the lines of each text that are not blank."""
    return (docs.select("did", "th", F.posexplode(F.split("text", "\n")).alias("para", "p"))
            .filter(F.length(F.trim("p")) > 0))


def blocks(docs: DataFrame) -> DataFrame:
    """(did, th, para, lines): the paragraphs of each text, between lines without letter or digit.

    Comment marks are no letters, so a line of nothing else is blank; those that are words
    (rem, dnl) go, and the others part no words.
    """
    bare = F.regexp_replace("text", r"(?imd)^[ \t]*(?:rem|dnl)(?=\s|$)", "")
    bare = F.regexp_replace(bare, r"(?md)^[^\p{L}\p{N}\n]+$", "")
    return (docs.select("did", "th", F.posexplode(F.split(bare, "\n\n+")).alias("para", "p"))
            .select("did", "th", "para", F.filter(F.split("p", "\n"), lambda x: x != "").alias("lines")))


def passages(docs: DataFrame) -> DataFrame:
    """(did, th, para, part, wrapped, p): what is scored of each paragraph. Every line, as a notice
    of its own; where there are more, the whole paragraph with its line ends as blanks, and in a
    long one also every SPAN lines, half of them shared, so text around a notice doesn't hide it."""
    n = F.size("lines")
    starts = F.when(n > SPAN, F.sequence(F.lit(1), n, F.lit(SPAN // 2))).otherwise(F.array().cast("array<int>"))
    some = F.transform(starts, lambda i: F.array_join(F.slice("lines", i, F.lit(SPAN)), " "))
    whole = F.when(n > 1, F.array(F.array_join("lines", " "))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.transform("lines", lambda x: F.struct(F.lit(False).alias("wrapped"), x.alias("p"))),
                     F.transform(F.concat(whole, some), lambda x: F.struct(F.lit(True).alias("wrapped"), x.alias("p"))))
    return blocks(docs).select("did", "th", "para", F.posexplode(parts).alias("part", "x")).select(
        "did", "th", "para", "part", "x.wrapped", "x.p")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, t int, p string").withColumn("w", words(F.col("p")))


class Model:
    """The fitted weights: one row per n-gram with a weight for each class, and the temperature."""

    def __init__(self, licence_words: list[str], weights: DataFrame, bias: list[float], temperature: float):
        self.words, self.weights, self.bias, self.temperature = licence_words, weights, bias, temperature

    @property
    def literal(self) -> Column:
        return F.array(*[F.lit(w) for w in self.words])

    def logits(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys`` and ``z`` (a logit per class) of rows with words ``w``: the sum of the weights of
        their n-grams. Rows without any known n-gram are not returned; theirs are the biases."""
        found = rows.select(*keys, F.explode(grams(F.col("w"), self.literal)).alias("gram")).join(
            F.broadcast(self.weights), "gram")  # at most the n-grams of the templates' words in the sample
        sums = found.groupBy(*keys).agg(*[F.sum(F.col("c")[i]).alias(f"z{i}") for i in range(len(CLASSES))])
        return sums.select(*keys, F.array(*[F.col(f"z{i}") + F.lit(b) for i, b in enumerate(self.bias)]).alias("z"))

    def probabilities(self, z: Column, temperature: float | None = None) -> Column:
        t = F.lit(temperature or self.temperature)
        top = F.array_max(z)
        e = F.transform(z, lambda x: F.exp((x - top) / t))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _variants(spark: SparkSession) -> DataFrame:
    """Each template whole and with about one word in eight left out, by a rule on hashes."""
    v = templates(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    cut = F.filter("w", lambda x, i: (F.pmod(F.xxhash64(x, i, F.col("v")), F.lit(8)) != 0) | (F.col("v") < 2))
    return v.withColumn("w", cut).filter(F.size("w") > 0).select("family", "v", "w")


def train(docs: DataFrame) -> Model:
    """Fit on the variants and on at most OTHERS paragraphs of ``docs`` (did, th, text): those of
    smallest hash among all, without those that hold half of a template or one of the GENERAL
    words. An empty table is no obstacle: the variants alone are left."""
    spark = docs.sparkSession
    known = templates(spark)
    # three words or more, told without taking the line apart
    lines = paragraphs(docs).filter(F.lower("p").rlike("(?:[a-z0-9]+[^a-z0-9]+){2}[a-z0-9]"))
    place = F.xxhash64("did", "th", "para")
    few = lowest(lines, place, OTHERS).orderBy(place).limit(OTHERS).withColumn("w", words(F.col("p")))
    others = few.select(F.array_distinct("w").alias("u"), "w")
    phrases = [F.array(*[F.lit(x) for x in r.w]) for r in known.select("w").collect()]
    alike = F.greatest(*[F.size(F.array_intersect("u", t)) / F.size(F.array_distinct(t)) for t in phrases])
    names = F.arrays_overlap("u", F.array(*[F.lit(w) for w in GENERAL]))
    others = settled(others.filter((alike < 0.5) & ~names).select("w", "u"), "others")
    n = others.count()
    common = others.select(F.explode("u").alias("x")).groupBy("x").count().filter(F.col("count") > COMMON * n)
    rare = known.select(F.explode("w").alias("x")).distinct().join(common, "x", "left_anti")
    licence = sorted({r.x for r in rare.filter(F.length("x") > 1).collect()} | set(GENERAL))
    literal = F.array(*[F.lit(w) for w in licence])
    code = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, float(i))])
    rows = _variants(spark).select(code[F.col("family")].alias("label"), "v", "w").unionByName(
        others.select(F.lit(0.0).alias("label"), F.pmod(F.xxhash64("w"), F.lit(VARIANTS)).cast("int").alias("v"), "w"))
    # these words alone say licence language, and no more
    shared = spark.createDataFrame([(w, v) for w in GENERAL for v in range(8)], "x string, v int").select(
        code[F.lit(UNKNOWN)].alias("label"), "v", F.array("x").alias("w"))
    rows = settled(rows.unionByName(shared).withColumn("g", grams(F.col("w"), literal)), "training")
    fold = rows.filter("v % 4 <> 3")
    vectors = CountVectorizer(inputCol="g", outputCol="features", binary=True).fit(fold)
    fitted = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=60).fit(
        vectors.transform(fold))
    matrix = fitted.coefficientMatrix.toArray()
    present = fitted.numClasses
    table = [(g, [float(matrix[c][j]) if c < present else 0.0 for c in range(len(CLASSES))])
             for j, g in enumerate(vectors.vocabulary) if abs(matrix[:, j]).max() > 0]
    bias = [float(fitted.interceptVector[c]) if c < present else -30.0 for c in range(len(CLASSES))]
    weights = settled(spark.createDataFrame(table, "gram string, c array<double>"), "weights")
    model = Model(licence, weights, bias, 1.0)
    # calibration: the temperature of least log loss on the variants left out
    held = rows.filter("v % 4 = 3").withColumn("row", F.monotonically_increasing_id())
    z = model.logits(settled(held, "held"), ["row", "label"])
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    loss = z.agg(*[F.avg(-F.log(F.greatest(F.lit(1e-9), F.element_at(
        model.probabilities(F.col("z"), t), (F.col("label") + 1).cast("int"))))) for t in grid]).first()
    model.temperature = min(zip(loss, grid))[1] if loss[0] is not None else 1.0
    return model


def scan_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(did, th, para, wrapped, family, probability, similarity) of the paragraphs with licence language.

    A paragraph stands between blank lines; its lines are scored alone and together
    (:func:`passages`). Texts without a licence word have no feature and are passed over after one look at their
    words. A predicted family is confirmed if the paragraph holds at least ALIKE of the n-grams
    of one of its templates; otherwise, and where the probability is under CERTAIN, it is
    ``unknown``. Lines taken together count only if they hold that much of a template.
    """
    spark = docs.sparkSession
    some = docs.filter(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), model.literal))
    rows = passages(some).withColumn("w", words(F.col("p"))).filter(F.arrays_overlap("w", model.literal))
    keys = ["did", "th", "para", "part", "wrapped", "g"]
    rows = rows.withColumn("g", grams(F.col("w"), model.literal))
    z = model.logits(rows, keys).withColumn("q", model.probabilities(F.col("z")))
    best = F.array_position("q", F.array_max("q")).cast("int")
    z = z.withColumn("guess", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), best)).filter(F.col("guess") != NONE)
    known = templates(spark).withColumn("tg", grams(F.col("w"), model.literal)).groupBy(
        F.col("family").alias("guess")).agg(F.collect_list("tg").alias("tgs"))
    z = z.join(known, "guess")  # a row for each class
    alike = F.array_max(F.transform("tgs", lambda t: F.size(F.array_intersect(t, "g")) / F.greatest(F.size(t), F.lit(1))))
    z = z.withColumn("similarity", alike).withColumn("probability", F.array_max("q"))
    sure = (F.col("probability") >= CERTAIN) & (F.col("similarity") >= ALIKE)
    z = z.filter(~F.col("wrapped") | (F.col("similarity") >= ALIKE))
    return z.select("did", "th", "para", "wrapped", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"),
                    "probability", "similarity").distinct()


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licence, probability, similarity, n_paragraphs, families.

    ``licence`` is that of the paragraph of highest probability among confirmed families (ties:
    the first paragraph), ``unknown`` if all licence paragraphs are, ``none`` without any. Paragraphs
    stand between blank lines, comment marks and line ends inside them don't matter; one whose
    family only shows over several lines is not ``unknown`` for its single lines. Null and empty texts are ``none``. Rows that repeat id and text have the same result. Other
    columns are not read; whole texts are scanned. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    model = model or train(rows)
    found = scan_paragraphs(rows, model)
    by = F.struct((F.col("family") != UNKNOWN).alias("a"), F.col("probability").alias("b"), (-F.col("para")).alias("c"),
                  F.col("family").alias("family"), F.col("similarity").alias("similarity"))
    over = F.collect_set(F.when(F.col("wrapped") & (F.col("family") != UNKNOWN), F.col("family")))
    lines = F.collect_set(F.when(~F.col("wrapped") | (F.col("family") == UNKNOWN), F.col("family")))
    per_para = found.groupBy("did", "th", "para").agg(F.max(by).alias("m"), over.alias("o"), lines.alias("l"))
    per_para = per_para.withColumn("f", F.array_union("o", F.when(
        F.size(F.array_except("o", "l")) > 0, F.array_remove("l", UNKNOWN)).otherwise(F.col("l"))))
    per_text = per_para.groupBy("did", "th").agg(
        F.max("m").alias("m"), F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("families"))
    return rows.select("did", "th").join(per_text, ["did", "th"], "left").select(
        real_id().alias("doc_id"), F.coalesce("m.family", F.lit(NONE)).alias("licence"),
        F.coalesce("m.b", F.lit(0.0)).alias("probability"), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("n", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"))
