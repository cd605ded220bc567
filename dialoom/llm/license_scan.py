"""Licence families by a trained paragraph classifier, confirmed by comparison with templates.

DataFrame and ML pipeline functions only: paragraphs are read in overlapping windows of words, which
become sparse counts of one- and two-word n-grams; a multinomial logistic regression (trained here)
gives probabilities per family and for an unknown class. The window's family is the most probable one.
Comparison with the templates then confirms it or not: a word counts the more the fewer families use it,
and no other family may match more of the window.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil, floor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.base import unit_hash, written

# How the families are usually announced.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC"),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0."),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0."),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights under the CC0 1.0 Universal dedication.",
        "SPDX-License-Identifier: CC0-1.0"),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib"),
}
FAMILIES = ("unknown", *TEMPLATES)

#: Windows of documents the unknown class is trained on, at most.
SAMPLE = 3000
#: Words of a window, and from one window's start to the next: WINDOW - STRIDE + 1 words, more than any
#: template has, are whole in some window wherever they stand.
WINDOW, STRIDE = 64, 40
VARIANTS = 60
FEATURES = 1 << 14
#: What a training window of a family counts, against 1 for an unknown one.
FAMILY_WEIGHT = 4.0
LEAST_PROBABILITY = 0.5
FALSE_SHARE = 0.0005
LEAST_RESEMBLANCE = 0.6
#: Windows with less than this share of the words of any template are not even cut statements of a licence.
UNLIKE = 0.3
RIVAL = 10
ROUNDS = 60


#: What separates words: anything but letters, digits, plus signs, and full stops inside a word.
SEPARATOR = r"(?:[^\p{L}\p{N}.+]|\.(?![\p{L}\p{N}+]))+"


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def windows_of(words: Column) -> Column:
    """(start, words): windows that overlap and cover all words of a line; none of a line without words."""
    size = F.size(words)
    last = F.greatest(F.ceil((size - WINDOW) / F.lit(STRIDE)).cast("int"), F.lit(0))
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * STRIDE).alias("start"), F.slice(words, i * STRIDE + 1, WINDOW).alias("words")))
    return F.when(size > 0, found).otherwise(F.slice(found, 1, 0))


def windowed(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, paragraph, start, words) of all lines; paragraph counts lines from 0.

    All in one expression under one generator, so that no filter or projection makes the words again.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = F.transform(lines, lambda line, at: F.transform(F.array(normal_words(line)), lambda words: F.transform(
        windows_of(words), lambda w: F.struct(at.alias("paragraph"), w["start"].alias("start"), w["words"].alias("words"))))[0])
    return docs.select(*keys, F.inline(F.flatten(rows)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, i, text) for family, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "family string, template int, text string")
    return frame.withColumn("words", normal_words(F.col("text"))).drop("text")


def _filler(trained: DataFrame) -> DataFrame:
    """(place, n, words): WINDOW words of running foreign text, as far as there are any, per window."""
    order = Window.orderBy("place")
    several = F.slice(F.flatten(F.collect_list("words").over(order.rowsBetween(0, 15))), 1, WINDOW)
    return trained.select("place", F.count("*").over(Window.partitionBy()).alias("n"), several.alias("words"))


def _variants(templates: DataFrame, filler: DataFrame) -> DataFrame:
    """Training windows of the families: templates with words left out and 0 to WINDOW foreign ones around."""
    copies = templates.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))

    def draw(name: str) -> Column:
        return unit_hash(F.col("family"), F.col("template"), F.col("copy"), F.lit(name))

    left = F.filter("words", lambda w, i: (F.col("copy") == 0) | (unit_hash(
        F.col("family"), F.col("template"), F.col("copy"), w, i) >= 0.12))
    around = copies.withColumn("left", left).join(
        filler.select("place", "n", F.col("words").alias("other")),
        F.col("place") == F.floor(draw("place") * F.col("n")), "left")
    other = F.coalesce("other", F.array().cast("array<string>"))
    room = F.least(F.size(other), F.greatest(WINDOW - F.size("left"), F.lit(0)))
    # a third with up to 6, as in lines of their own, the others with any number that a window has room for
    many = F.when(F.col("copy") % 3 == 0, F.least(F.floor(draw("few") * 7), room)).otherwise(
        F.floor(draw("many") * (room + 1))).cast("int")
    before = F.floor(draw("before") * (many + 1)).cast("int")
    words = F.concat(F.slice(other, F.lit(1), before), F.col("left"), F.slice(other, before + 1, many - before))
    return around.select("family", F.when(F.col("copy") == 0, F.col("words")).otherwise(words).alias("words"))


@dataclass(frozen=True)
class Scanner:
    """A fitted classifier, and the least probability of not being unknown at which a family is believed.

    Without one, it is set by the documents scanned: at most FALSE_SHARE of all their windows that
    resemble no template reach it.
    """

    model: PipelineModel
    least: float | None = None


def fit(docs: DataFrame) -> Scanner:
    """Train on templates and, for the unknown class, on a bounded sample of the documents' own windows.

    The sample has the lowest hashes of lines over all documents; windows that resemble a template are
    left out of it.
    """
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).withColumn(
        "hash", F.xxhash64("line"))
    highest = lines.select("hash").distinct().orderBy("hash").limit(SAMPLE).agg(F.max("hash")).first()[0]
    # only hashes are shuffled to find the lowest, and then the few lines that have them
    lowest = written(lines.where(F.col("hash") <= F.lit(highest)).groupBy("hash").agg(F.first("line").alias("text")), "paragraphs")
    plain = windowed(lowest, ("hash",)).where(~_like_a_template(F.col("words"), LEAST_RESEMBLANCE)).withColumn("order", F.xxhash64("hash", "start"))
    trained = written(plain.orderBy("order").limit(SAMPLE).select(
        "words", (F.row_number().over(Window.orderBy("order")) - 1).alias("place")), "trained")
    filler = _filler(trained)
    train = (_variants(_templates(spark), filler)
             .unionByName(trained.unionByName(filler.select("place", "words").where(F.col("place") % 4 == 0))
                          .select(F.lit("unknown").alias("family"), "words")))
    number = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    train = train.withColumn("label", number.cast("double"))
    share = F.when(F.col("label") == 0, F.lit(1.0)).otherwise(F.lit(FAMILY_WEIGHT))
    steps = Pipeline(stages=[
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="", rawPredictionCol="",
                           probabilityCol="probability", maxIter=ROUNDS, regParam=0.0002, standardization=False, family="multinomial")])
    # written, so that the rounds of the training and what follows them do not plan the variants again; in one
    # part, as the rows are few however many documents there are, and each part sends the driver a gradient a round
    return Scanner(steps.fit(written(train.withColumn("weight", share), "training").repartition(1)))


def _words(text: str) -> list[str]:
    """normal_words for the templates' plain ASCII."""
    return re.findall(r"[a-z0-9+]+(?:\.[a-z0-9+]+)*", text.lower())


def _word_weights() -> dict[str, float]:
    """One over the number of families whose templates have the word."""
    used = Counter(w for texts in TEMPLATES.values() for w in {w for t in texts for w in _words(t)})
    return {w: 1 / n for w, n in used.items()}


WEIGHTS = _word_weights()


def _telling(template: str) -> list[str]:
    """The words of a template that the fewest families use."""
    own = sorted(set(_words(template)))
    return [w for w in own if WEIGHTS[w] == max(WEIGHTS[x] for x in own)]


def resemblance(words: Column, family: str) -> Column:
    """(share, weight) of the family's template that the words match best.

    The share is of its words or of their weight, whichever is less: a telling word alone, which may be an
    ordinary one elsewhere, is not enough. Without half of its telling words a template is not matched at all.
    """
    def one(template: str) -> Column:
        own, telling = sorted(set(_words(template))), _telling(template)
        weights = F.array(*[F.lit(WEIGHTS[w]) for w in own])
        matched = F.aggregate(F.zip_with(F.array(*[F.lit(w) for w in own]), weights, lambda w, k: F.when(
            F.array_contains(words, w), k).otherwise(0.0)), F.lit(0.0), lambda total, k: total + k)
        told = 2 * F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in telling]))) >= len(telling)
        number = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) / len(own)
        return F.transform(F.array(F.when(told, F.round(matched, 6)).otherwise(0.0)), lambda m: F.struct(
            F.least(m / round(sum(WEIGHTS[w] for w in own), 6), number).alias("share"), m.alias("weight")))[0]

    return F.array_max(F.array(*[one(t) for t in TEMPLATES[family]]))


def _like_a_template(words: Column, least: float) -> Column:
    """Whether they have this share of all words of some template, telling or not."""
    lists = [sorted(set(_words(t))) for texts in TEMPLATES.values() for t in texts]
    return F.greatest(*[F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) / len(own)
                        for own in lists]) >= least


def scored(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(_row, doc_id, paragraph, start, chances, words) of all windows of the documents.

    Where a window is not unknown at LEAST_PROBABILITY, chances has the probabilities of FAMILIES and words
    its words; of all other windows nothing but their places is written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    chances = vector_to_array("probability")
    told = scanner.model.transform(windowed(rows, ("_row", "doc_id"))).select(
        "_row", "doc_id", "paragraph", "start", F.struct(chances.alias("chances"), "words").alias("told"))
    return written(told.select("_row", "doc_id", "paragraph", "start", F.when(
        1 - F.col("told.chances")[0] >= LEAST_PROBABILITY, F.col("told")).alias("told")).select(
        "_row", "doc_id", "paragraph", "start", "told.chances", "told.words"), "windows")


def _least(windows: DataFrame) -> float:
    """The probability that at most FALSE_SHARE of all windows unlike any template reach, LEAST_PROBABILITY at least."""
    plain = windows.where("chances IS NOT NULL").where(~_like_a_template(F.col("words"), UNLIKE)).select(
        (1 - F.col("chances")[0]).alias("known"))
    allowed, many = floor(windows.count() * FALSE_SHARE), plain.count()
    if many <= allowed:
        return LEAST_PROBABILITY
    reached = plain.agg(F.percentile_approx("known", F.lit(1 - allowed / many), 100_000).alias("p")).first()["p"]
    return max(LEAST_PROBABILITY, ceil(reached * 10_000 + 1) / 10_000)


def predicted(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, paragraph, family, probability, resemblance, confirmed) of paragraphs not unknown.

    A paragraph has a row for every family found in its windows, with the values of the best window. The
    classifier names a window's family. It is confirmed if the window has LEAST_RESEMBLANCE of a template of
    the family, and if no other family that it resembles as much matches more, unless the classifier holds that
    one for RIVAL times less probable. A window's family does not count where an overlapping window, judged to be another family, resembles it more: then the window's
    edge has cut the other family's statement.
    """
    windows = scored(docs, scanner)
    return judged(windows, _least(windows) if scanner.least is None else scanner.least)


def judged(windows: DataFrame, least: float) -> DataFrame:
    """predicted() of windows as scored() gives them."""
    names = F.array(*[F.lit(name) for name in TEMPLATES])
    known = F.slice("chances", 2, len(TEMPLATES))
    found = (windows.where(F.col("chances").isNotNull()).where(1 - F.col("chances")[0] >= least)
             .withColumn("probability", F.array_max(known))
             .withColumn("family", F.element_at(names, F.array_position(known, F.col("probability")).cast("int")))
             .withColumn("shares", F.create_map(*[x for name in TEMPLATES for x in (F.lit(name), resemblance(F.col("words"), name))]))
             .withColumn("own", F.col("shares")[F.col("family")]))
    better = F.exists(F.zip_with(F.map_values("shares"), known, lambda s, p: (s["share"] >= LEAST_RESEMBLANCE) & (
        s["weight"] > F.col("own.weight")) & (RIVAL * p >= F.col("probability"))), lambda x: x)
    found = found.select("_row", "doc_id", "paragraph", "start", "family", "probability", "shares", F.col("own.share").alias("resemblance"),
                         ((F.col("own.share") >= LEAST_RESEMBLANCE) & ~better).alias("confirmed"))
    line = Window.partitionBy("_row", "paragraph").orderBy("start").rangeBetween(1 - WINDOW, WINDOW - 1)
    near = F.collect_list(F.struct("family", "shares")).over(line)
    cut = F.exists("near", lambda w: (w["family"] != F.col("family")) & (w["shares"][F.col("family")]["share"] > F.col("resemblance")))
    return (found.withColumn("near", near).where(~cut)
            .groupBy("_row", "doc_id", "paragraph", "family")
            .agg(F.max(F.struct("confirmed", "resemblance", "probability")).alias("most"))
            .select("doc_id", "paragraph", "family", "most.probability", "most.resemblance", "most.confirmed"))


def license_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, families, n_confirmed, n_unconfirmed) for every row of docs.

    families names the confirmed ones, sorted and comma-joined, and is empty without any. Null and
    empty texts have none. Rows that repeat a doc_id are scanned together and each get its result; a
    null doc_id is kept as one more; other columns are not read; an empty table gives no rows.
    """
    scanner = scanner or fit(docs)
    found = (predicted(docs, scanner).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if("confirmed").alias("n_confirmed"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed")))
    ids = docs.select("doc_id").alias("d")
    found = found.alias("f")
    return ids.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left").select(
        "d.doc_id", F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"))
