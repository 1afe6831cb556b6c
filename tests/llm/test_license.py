from __future__ import annotations

import pytest

from gleaner.llm import license_scan as ls
from gleaner.llm.queries import QUERIES
from tests.llm.cases import documents, empty


@pytest.fixture(scope="module")
def model(spark, folder):
    return ls.fit(spark.read.parquet(f"{folder}/documents.parquet"))


def found(rows):
    return {r.doc_id: [(x.paragraph, x.family) for x in r._licenses] for r in rows}


def test_every_template_is_named(spark, model):
    texts = [f"some words\n{t}\nmore words" for ts in ls.TEMPLATES.values() for t in ts]
    families = [f for f, ts in ls.TEMPLATES.items() for _ in ts]
    got = found(ls.scan(documents(spark, texts), model).collect())
    right = sum(got[k] == [(1, f)] for k, f in enumerate(families, 1))
    assert right >= 0.9 * len(families)
    assert all(x and x[0][0] == 1 for x in (got[k] for k in range(1, len(texts) + 1)))


def test_ordinary_and_odd_paragraphs(spark, model):
    texts = ["The license of the poet is to use all words.", "He reserved all of the rooms.", "mit dem Zug", "Released the doves at noon", "all rights"]
    got = found(ls.scan(documents(spark, texts), model).collect())
    assert all(f in (ls.UNKNOWN,) for k in range(1, 6) for _, f in got[k])


def test_edge_rows(spark, model):
    rows = ls.scan(documents(spark), model).collect()
    assert len(rows) == 16 and not any(r._licenses for r in rows if r.doc_id)
    assert ls.scan(empty(spark), model).count() == 0
    assert ls.scan(documents(spark, ["Released under the MIT License."]), ls.fit(empty(spark))).filter("doc_id = 1").first()._licenses[0].family == "mit"


def test_query_finds_planted_lines(spark, folder):
    planted = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op7_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lines = set((texts[r.doc_id] or "").split("\n"))
        assert set(filter(None, r.families.split(","))) == {f for line, f in planted.items() if line in lines}


LINES = {
    "Licensed under the Apache License, Version 1.1.": {"apache-1.1"}, "This work is under the GNU General Public License, version 2.": {"gpl-2.0"},
    "Licensed under the GPL v2.": {"gpl-2.0"}, "Released under the BSD 2-Clause License.": {"bsd-2-clause"},
    "This library is licensed under the GNU Lesser General Public License, version 2.1.": {"lgpl-2.1"},
    "Released under the Mozilla Public License 1.1.": {"mpl-1.1"}, "SPDX-License-Identifier: MIT": {"mit"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"}, "Released under the MIT License.": {"mit"},
    "Released under the Mozilla Public License 2.0.": {"mpl-2.0"}, "Licensed under the GPL v3.": {"gpl-3.0"},
    "Licensed under the Apache License, Version 3.0.": {ls.UNKNOWN}, "This program is licensed under the GNU General Public License, version 1.": {ls.UNKNOWN},
    "Licensed under the Common Public License Version 1.0.": {ls.UNKNOWN}, "This work is licensed under the GNU Affero General Public License, version 3.": {ls.UNKNOWN},
}


def test_versions_and_unknown_licences(spark, model):
    got = found(ls.scan(documents(spark, list(LINES)), model).collect())
    wrong = {line: got[k] for k, (line, right) in enumerate(LINES.items(), 1) if {f for _, f in got[k]} != right}
    assert not wrong, wrong


def test_wrapped_notices(spark, model):
    mit = "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated files."
    bsd = "Redistribution and use in source and\nbinary forms, with or without modification,\nare permitted provided that"
    texts = [f"a title\n\n{mit}\n\nan end", f"{bsd}\n\nmore", "the day was\nlong and the\nroad went on", "Permission is hereby granted,\n\nfree of charge"]
    got = found(ls.scan(documents(spark, texts), model).collect())
    assert got[1] == [(2, "mit")] and got[2] == [(0, "bsd-3-clause")] and got[3] == []
    assert all(f == ls.UNKNOWN for _, f in got[4])


def test_the_columns_score_like_plain_python(spark, model):
    """Probabilities of single lines by the definition: a weight for each distinct n-gram, softmax over the families."""
    import math

    texts = [t for ts in ls.TEMPLATES.values() for t in ts] + list(ls.OTHERS)
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ls.grams_of(ls.tokens_of(ls.lower_ascii(ls.F.col("t")))).alias("g"))
    place = {g: j for j, g in enumerate(model.vocabulary)}
    rows = frame.select("g", model.judge(ls.F.col("g"), ls.F.size("g"), ls.F.array().cast("array<string>")).alias("j")).collect()
    for r in rows:
        at = [place[g] for g in set(r.g) if g in place]
        scores = [b + sum(w[j] for j in at) for w, b in zip(model.weights, model.intercepts, strict=True)]
        e = [math.exp(s - max(scores)) for s in scores]
        assert not at or abs(r.j.probability - max(e) / sum(e)) < 1e-9
