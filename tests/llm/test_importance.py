from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import importance
from gleaner.llm.queries import QUERIES
from gleaner.session import materialise
from tests.llm.cases import LOWER, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """doc_id, n_features, weight, score, rank by the definition; documents in reading order."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    made = [features(t, longest) for _, t in docs]
    s = Counter(at(f) for _, fs in made for f in fs)
    t = Counter(at(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out, pool = [], []
    for k, ((ident, _), (words, fs)) in enumerate(zip(docs, made, strict=True)):
        weight, score = sum(gain(at(f)) for f in fs), None
        if ident is not None:
            h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= least:
                pool.append((-score, ident, k))
        out.append([ident, len(fs), weight, score, None])
    for r, (_, _, k) in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        out[k][4] = r
    return sorted(map(tuple, out), key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("options", [{"percent": 50, "least_words": 3}, {"longest": 3, "buckets": 70_000, "percent": 100, "least_words": 0}, {"percent": 0}])
def test_edge_rows(spark, options):
    docs = documents(spark).union(documents(spark).limit(9)).coalesce(1)
    target = documents(spark).limit(7).withColumnRenamed("text", "_b")
    found = importance.resample(docs, target, target_text="_b", **options)
    plain = {"least" if k == "least_words" else k: v for k, v in options.items()}
    assert rows(found) == brute([(r.doc_id, r.text) for r in docs.collect()], [r["_b"] for r in target.collect()], **plain)


def test_drawn_rows_are_whole(spark):
    docs = documents(spark)
    found = importance.resample(docs, docs, percent=50, least_words=1)
    drawn = importance.drawn_documents(docs, found).collect()
    assert {r.doc_id for r in drawn} == {r["_id"] for r in found.collect() if r["rank"]} and drawn
    assert drawn[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


def test_ties_go_to_the_smaller_id_then_the_first_row(spark):
    given = [(k % 7, -(k % 3), k) for k in range(60)]
    frame = materialise(spark.createDataFrame(given, "_id long, score long, _row long").repartition(3))
    best = sorted(given, key=lambda r: (-r[1], r[0], r[2]))
    for wanted in (0, 1, 5, 20, 21, 37, 60):
        found = frame.filter(importance.cut(frame, wanted))
        assert {r["_row"] for r in found.collect()} == {r[2] for r in best[:wanted]}
        placed = importance.ranked(found, range_rows=4)
        assert [r["_row"] for r in placed.orderBy("rank").collect()] == [r[2] for r in best[:wanted]]
        assert [r["rank"] for r in placed.orderBy("rank").collect()] == list(range(1, wanted + 1))


def test_bisection_counts_exactly(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-(10**12), 10**12, 300), np.full(100, 17)])
    frame = spark.createDataFrame([(int(v),) for v in values], "v long")
    ordered = np.sort(values)
    for wanted in (1, 150, 151, 260, 400):
        at, below = importance.lowest_reaching(frame, F.col("v"), int(ordered[0]), int(ordered[-1]), wanted)
        assert at == ordered[wanted - 1] and below == (values < at).sum()


def test_nothing(spark):
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    docs = documents(spark)
    assert {r.weight for r in importance.resample(docs, empty(spark), percent=100).collect() if not r.n_features} == {0}


def test_query(spark, folder):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*c).collect()]
    found = QUERIES["op13_importance"](spark, folder).select("doc_id", "n_features", "weight", "score", "rank")
    assert rows(found) == brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
