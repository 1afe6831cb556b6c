"""Licence notices in paragraphs: sparse word n-gram logistic regression, an unknown class, and templates that confirm.

A multinomial logistic regression with L1 penalty is fitted on paragraphs made
from notice templates, on notices of other licences, which form the unknown class, and on
ordinary paragraphs of the corpus. Only n-grams of the notices are features, so a
paragraph is scored from the few it shares with that vocabulary; all others have
weight 0. A named paragraph is `unknown` if its probability stays below a
threshold, or if no template of the family is alike: enough n-grams in common, and the
family's version where either states one. The threshold is calibrated on what the
fit did not see: a third of the other licences, each as a whole, ordinary paragraphs, and
notices in surroundings of their own.

A paragraph is a line with a word; lines that follow each other without a blank one
between them are judged together as well, from the n-grams of all of them, so a
notice that is wrapped over lines is found, in texts that have one of the `ANCHORS`. It counts at its first line, and only
where none of its lines is named by itself. Edge cases: null or empty text has no
paragraphs. Texts and paragraphs of any length are scored whole, inside their
row. Repeated rows and paragraphs are judged alike; of families with the same
probability the first by name wins. Empty tables give no rows, and without
ordinary paragraphs the fit takes a stock sentence for them. Other columns, whatever
their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import beside, double_array, let, long_array, lower_ascii, sample_texts

NONE, UNKNOWN = "none", "unknown"
#: Words of which every template has one; lines are judged together only in texts that have one as well.
ANCHORS = "(?i)licen[cs]|permission|redistribut|rights"
LEAST_SHARED = 6  # n-grams of notices that lines must have to be judged together
#: Notice templates by family: public licence notices, fixed values.
TEMPLATES = {
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved. No part of this publication may be reproduced without permission.",
    ),
    "apache-1.1": (
        "Licensed under the Apache License, Version 1.1.",
        "Apache Software License, Version 1.1.",
        "SPDX-License-Identifier: Apache-1.1",
    ),
    "apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is distributed under the Apache License 2.0.",
    ),
    "bsd-2-clause": (
        "Released under the BSD 2-Clause License.",
        "Licensed under the BSD 2-Clause Simplified License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "bsd-3-clause": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License version 2.",
        "Licensed under the GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3.",
        "Licensed under the GPL v3.",
    ),
    "lgpl-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL v2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "lgpl-3.0": (
        "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "This project is licensed under the MIT License.",
    ),
    "mpl-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1.",
        "Released under the Mozilla Public License 1.1.",
    ),
    "mpl-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ),
}
#: Notices of licences without a family of their own, one licence in each line: fixed values.
OTHERS = (
    "Licensed under the ISC License.",
    "Released under the zlib License.",
    "This program is licensed under the Eclipse Public License, version 1.0.",
    "Subject to the terms of the Common Development and Distribution License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "This is free and unencumbered software released into the public domain.",
    "Licensed under the Academic Free License version 3.0.",
    "This software is released under the PostgreSQL License.",
    "Licensed under the Open Software License 3.0.",
    "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted.",
    "This work is licensed under the CeCILL license version 2.1.",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "Permission is granted to copy this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "Licensed under CC BY-ND 4.0.",
    "This work is dedicated to the public domain under CC0 1.0.",
    "Licensed under CC BY 3.0.",
    "Licensed under the Microsoft Public License.",
    "This file is distributed under the Python Software Foundation License Version 2.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: AGPL-3.0-only",
)
STOCK = "the day was long and the road went on over the hill to the town"
#: What stands around notices in the training paragraphs.
FRAMES = ("{}", "{} See the file for details.", "Note: {}", "{} Contributions are welcome.", "(c) 2020 {}")


def tokens_of(paragraph: Column) -> Column:
    """Words of letters, digits and inner points of an ASCII-lower-cased paragraph."""
    parts = F.split(paragraph, r"[^a-z0-9.]+|\.(?![0-9])")
    return F.filter(parts, lambda w: w != "")


def versions_of(tokens: Column) -> Column:
    """The version numbers among the tokens, without a leading v and closing zeros; years are none."""
    found = F.filter(tokens, lambda w: w.rlike(r"^v?[0-9]{1,2}(\.[0-9]{1,2})*$"))
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, "^v", ""), r"(\.0)+$", "")))


def grams_of(tokens: Column) -> Column:
    """Hashes of the distinct words and word pairs."""

    def of(hashed: Column) -> Column:
        pairs = F.transform(hashed, lambda h, i: F.when(i > 0, F.xxhash64(F.get(hashed, i - 1), h)))
        return F.array_distinct(F.concat(hashed, F.filter(pairs, lambda p: p.isNotNull())))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def labelled_templates(spark: SparkSession, templates: dict[str, Sequence[str]] = TEMPLATES, others: Sequence[str] = OTHERS) -> DataFrame:
    """Notices in their surroundings with their family; `held` are those for calibration: the last surroundings, and every
    third of the other licences in all of theirs."""
    rows = [(frame.format(t), family, k == len(FRAMES) - 1) for family, texts in templates.items() for t in texts for k, frame in enumerate(FRAMES)]
    rows += [(frame.format(t), UNKNOWN, k % 3 == 2) for k, t in enumerate(others) for frame in FRAMES]
    return spark.createDataFrame(rows + [(STOCK, NONE, False)], "paragraph string, family string, held boolean")


def paragraphs_of(text: Column) -> Column:
    """Lower-cased lines that hold a token, with their place."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(numbered, lambda p: p["line"].rlike("[a-z0-9]"))


@dataclass(frozen=True)
class Model:
    vocabulary: tuple[int, ...]
    families: tuple[str, ...]  # NONE among them
    weights: tuple[tuple[float, ...], ...]  # family by n-gram
    intercepts: tuple[float, ...]
    threshold: float
    notices: tuple[tuple[str, tuple[int, ...], bool], ...]  # family, the n-grams of one template, and whether it states a version
    versions: tuple[tuple[str, tuple[str, ...]], ...]  # of each family that has one

    def probabilities(self, found: Column) -> Column:
        """Of all families, from the places of the n-grams in the vocabulary."""
        width = len(self.vocabulary)

        def of(flat: Column) -> Column:
            scores = [_score(flat, found, k * width, b) for k, b in enumerate(self.intercepts)]
            return let(F.array(*scores), _softmax)

        return let(double_array(w for row in self.weights for w in row), of)

    def shared(self, grams: Column) -> Column:
        return F.array_intersect(grams, long_array(self.vocabulary))

    def judge(self, grams: Column, size: Column, versions: Column) -> Column:
        """Struct (family, probability, confirmed) from the distinct n-grams, at least those that notices have, and their
        number; family is NONE for ordinary paragraphs."""
        names = F.array(*[F.lit(f) for f in self.families])

        def of(shared: Column) -> Column:
            places = F.transform(shared, lambda g: (F.array_position(vocabulary, g) - 1).cast("int"))

            def best(p: Column) -> Column:
                top = F.array_max(p)
                family = F.get(names, (F.array_position(p, top) - 1).cast("int"))
                return let(F.struct(family.alias("family"), top.alias("probability")), named)

            def named(b: Column) -> Column:
                like = self.alike(grams, size, versions, b["family"])
                sure = (b["probability"] >= self.threshold) & like
                label = F.when(b["family"] == NONE, NONE).when(sure, b["family"]).otherwise(UNKNOWN)
                return F.struct(label.alias("family"), b["probability"].alias("probability"), like.alias("confirmed"))

            return let(self.probabilities(places), best)

        vocabulary = long_array(self.vocabulary)
        plain = F.struct(F.lit(NONE).alias("family"), F.lit(1.0).alias("probability"), F.lit(False).alias("confirmed"))
        return let(self.shared(grams), lambda shared: F.when(F.size(shared) > 0, of(shared)).otherwise(plain))

    def alike(self, grams: Column, size: Column, versions: Column, family: Column, least: float = 0.6) -> Column:
        """Whether a template of the family shares enough n-grams with the paragraph, of the smaller of the two sets, and the
        paragraph states the family's version if it states any; without one only templates without one count."""
        verdict = F.lit(False)
        own = dict(self.versions)
        for name, notice, has_version in self.notices:
            shared = F.size(F.array_intersect(grams, long_array(notice)))
            enough = (family == name) & (shared >= least * F.least(size, F.lit(len(notice))))
            if name in own:
                right = F.arrays_overlap(versions, F.array(*[F.lit(v) for v in own[name]]))
                enough = enough & (right | (F.lit(not has_version) & (F.size(versions) == 0)))
            verdict = verdict | enough
        return verdict


def _score(flat: Column, found: Column, offset: int, intercept: float) -> Column:
    return F.aggregate(found, F.lit(float(intercept)), lambda acc, j: acc + F.get(flat, j + offset))


def _softmax(scores: Column) -> Column:
    return let(
        F.transform(scores, lambda s: F.exp(s - F.array_max(scores))),
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)),
    )


def fit(
    documents: DataFrame, text: str = "text", ident: str = "doc_id", templates: dict[str, Sequence[str]] = TEMPLATES,
    sample_docs: int = 1000, regularisation: float = 0.0005, others: Sequence[str] = OTHERS,
) -> Model:
    """Fits on the notices and on ordinary paragraphs of at most `sample_docs` documents, the first by a hash of their id.

    Paragraphs of which half the n-grams or more are those of notices are not taken as ordinary. The
    threshold lies midway between the best probability of a family that a held ordinary
    paragraph, or a held licence that a template takes for its own, still reaches, and the one
    that 19 of 20 rightly named held notices reach; it is 0.5 at least.
    """
    spark = documents.sparkSession
    described = labelled_templates(spark, templates, others).withColumn("tokens", tokens_of(lower_ascii(F.col("paragraph"))))
    rows = described.select("family", "held", grams_of(F.col("tokens")).alias("grams"), versions_of(F.col("tokens")).alias("versions")).collect()
    plain_notices = spark.createDataFrame([(f, t) for f, ts in templates.items() for t in ts], "family string, notice string")
    stated = plain_notices.withColumn("tokens", tokens_of(lower_ascii(F.col("notice")))).select(
        "family", grams_of(F.col("tokens")).alias("grams"), versions_of(F.col("tokens")).alias("versions")
    ).collect()
    notices = tuple((r["family"], tuple(r["grams"]), bool(r["versions"])) for r in stated)
    by_family: dict[str, set[str]] = {}
    for r in stated:
        if r["versions"]:
            by_family.setdefault(r["family"], set()).update(r["versions"])
    versions = tuple((f, tuple(sorted(v))) for f, v in sorted(by_family.items()))
    known = {g for _, notice, _ in notices for g in notice} | {g for r in rows if r["family"] == UNKNOWN and not r["held"] for g in r["grams"]}
    vocabulary = tuple(sorted(known))
    sample = sample_texts(documents.select(F.col(ident).alias("_id"), F.col(text).alias("_t")), "_id", sample_docs)
    ordinary = (
        sample.select(F.explode(paragraphs_of(F.col("_t"))).alias("p"))
        .select(grams_of(tokens_of(F.col("p.line"))).alias("grams"))
        .select(F.array_intersect("grams", long_array(vocabulary)).alias("shared"), F.size("grams").alias("n"))
        # at most one short feature list per distinct paragraph reaches the fit
        .filter((F.size("shared") > 0) & (F.size("shared") < 0.5 * F.col("n")))
        .select("shared").distinct()
    )
    negatives = sorted(tuple(sorted(r["shared"])) for r in ordinary.collect())
    samples = [(sorted(known & set(r["grams"])), r["family"], r["held"], k) for k, r in enumerate(rows)]
    samples += [(list(n), NONE, k % 3 == 2, -1) for k, n in enumerate(negatives)]
    families = tuple(sorted({f for _, f, _, _ in samples}))
    # all notices together weigh as much as the ordinary paragraphs, which outnumber them
    share = max(1.0, len(negatives) / max(1, len(rows)))
    frame = spark.createDataFrame(
        [([str(g) for g in x], float(families.index(f)), 1.0 if f == NONE else share, held, k) for x, f, held, k in samples],
        "grams array<string>, label double, weight double, held boolean, row int",
    )
    counter = CountVectorizerModel.from_vocabulary([str(g) for g in vocabulary], inputCol="grams", outputCol="features", binary=True)
    vectors = counter.transform(frame.coalesce(1))  # a bounded sample: one task for each iteration
    fitted = LogisticRegression(
        family="multinomial", regParam=regularisation, elasticNetParam=1.0, standardization=False, maxIter=100,
        weightCol="weight",
    ).fit(vectors.filter(~F.col("held")))
    matrix = fitted.coefficientMatrix.toArray()
    keep = [j for j in range(len(vocabulary)) if any(abs(matrix[:, j]) > 1e-9)]
    model = Model(
        tuple(vocabulary[j] for j in keep), families,
        tuple(tuple(round(float(matrix[k, j]), 9) for j in keep) for k in range(len(families))),
        tuple(round(float(b), 9) for b in fitted.interceptVector.toArray()), 0.5, notices, versions,
    )
    scored = fitted.transform(vectors.filter("held")).select("label", "row", "probability").collect()
    noise, right = [0.0], []
    for r in scored:
        best = max((p, f) for f, p in zip(families, r["probability"], strict=True) if f not in (NONE, UNKNOWN))
        label = families[int(r["label"])]
        if label == NONE:
            noise.append(best[0])
        elif label == UNKNOWN:
            noise.append(best[0] * _takes(model, best[1], rows[r["row"]]))
        elif best[1] == label:
            right.append(best[0])
    low = sorted(right)[len(right) // 20] if right else 1.0
    return replace(model, threshold=round(max(0.5, (max(noise) + low) / 2), 6))


def _takes(model: Model, family: str, row) -> bool:
    """`Model.alike` for one collected notice."""
    grams, stated, own = set(row["grams"]), set(row["versions"]), dict(model.versions).get(family)
    return any(
        name == family and len(grams & set(notice)) >= 0.6 * min(len(grams), len(notice))
        and (own is None or bool(stated & set(own)) or (not has_version and not stated))
        for name, notice, has_version in model.notices
    )


def scan(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `_licenses`: array of (paragraph, family, probability, confirmed), and `_paragraphs`, the number of lines."""
    named = lambda x: ~x["family"].isin(NONE, UNKNOWN)
    run_type = "array<struct<at:int,last:int,grams:array<bigint>,size:int,versions:array<string>,tail:bigint>>"

    def line_of(p: Column) -> Column:
        def of(tokens: Column) -> Column:
            ends = [F.xxhash64(F.get(tokens, k)).alias(name) for name, k in (("head", F.lit(0)), ("tail", F.size(tokens) - 1))]
            stated = F.when(p["line"].rlike("[0-9]"), versions_of(tokens)).otherwise(F.array().cast("array<string>"))
            return let(grams_of(tokens), lambda g: F.struct(p["at"].alias("at"), g.alias("grams"), F.size(g).alias("size"), stated.alias("versions"), *ends))

        return let(tokens_of(p["line"]), of)

    def flat(at: Column, last: Column, j: Column) -> Column:
        return F.struct(at.alias("paragraph"), j["family"].alias("family"), j["probability"].alias("probability"), j["confirmed"].alias("confirmed"), last.alias("last"))

    def runs_of(lines: Column) -> Column:
        """Neighbouring lines together: their n-grams that notices have, and the number of all."""

        def step(acc: Column, line: Column) -> Column:
            alone = F.struct(
                line["at"].alias("at"), line["at"].alias("last"), model.shared(line["grams"]).alias("grams"), line["size"].alias("size"),
                line["versions"].alias("versions"), line["tail"].alias("tail"),
            )
            before = F.get(acc, F.size(acc) - 1)
            new = model.shared(F.concat(F.array(F.xxhash64(before["tail"], line["head"])), line["grams"]))  # the pair over the line's end too
            longer = F.struct(
                before["at"].alias("at"), line["at"].alias("last"), F.array_union(before["grams"], new).alias("grams"),
                (before["size"] + line["size"] + 1).alias("size"), F.array_union(before["versions"], line["versions"]).alias("versions"),
                line["tail"].alias("tail"),
            )
            follows = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] == line["at"] - 1)
            return F.when(follows, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(alone)))

        return F.filter(F.aggregate(lines, F.array().cast(run_type), step), lambda r: r["last"] > r["at"])

    def of(lines: Column) -> Column:
        def together(judged: Column) -> Column:
            hit = lambda r: F.exists(judged, lambda x: named(x) & x["paragraph"].between(r["at"], r["last"]))
            # a wrapped notice has one of its lines judged unknown, or shares a good part of a template
            runs = F.when(F.col("_t").rlike(ANCHORS), runs_of(lines)).otherwise(F.array().cast(run_type))
            open_ = F.filter(runs, lambda r: (F.size(r["grams"]) >= LEAST_SHARED) & ~hit(r))
            wide = F.transform(open_, lambda r: let(model.judge(r["grams"], r["size"], r["versions"]), lambda j: flat(r["at"], r["last"], j)))

            def both(found: Column) -> Column:
                inside = lambda x: F.exists(found, lambda r: x["paragraph"].between(r["paragraph"], r["last"]))
                rest = F.filter(judged, lambda x: named(x) | ((x["family"] == UNKNOWN) & ~inside(x)))
                return F.transform(F.array_sort(F.concat(rest, found)), lambda x: F.struct(*[x[c].alias(c) for c in ("paragraph", "family", "probability", "confirmed")]))

            return let(F.filter(wide, named), both)

        judged = F.transform(lines, lambda p: let(model.judge(p["grams"], p["size"], p["versions"]), lambda j: flat(p["at"], p["at"], j)))
        return F.struct(F.size(lines).cast("long").alias("n"), let(judged, together).alias("found"))

    def build(packed: DataFrame) -> DataFrame:
        lines = F.transform(paragraphs_of(F.col("_t")), line_of)
        scanned = packed.withColumn("_scan", let(lines, of))
        return scanned.withColumns({"_found": F.col("_scan.found"), "_n": F.col("_scan.n")})

    return beside(documents, text, build, {"_found": "_licenses", "_n": "_paragraphs"})
