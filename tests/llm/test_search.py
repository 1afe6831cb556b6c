from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import term_pipeline as tp
from gleaner.llm.common import terms_of
from gleaner.llm.queries import QUERIES
from tests.llm.cases import LOWER, documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(items, docs, k=20):
    """Rows by item: every document scored by the definition. Items and documents are (id, text) in reading order."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counted]
    df = Counter(t for _, c in counted for t in c)
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    out = []
    for item, text in items:
        found = []
        for at, (ident, c) in enumerate(counted):
            if ident is None or not n[at]:
                continue
            m = 100 - 25 + (25 * n[at] * big_n) // big_l
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2.0 * big_n + 2) / (2.0 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, ident, at))
        out += [(item, r, ident, -s) for r, (s, ident, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x180))) + "İSTANBUL K 字🙂 a\x1cb\x85c d A_Z a-z0/9:Z"
    assert [t.decode() for t in terms_of(text.encode())] == terms(text)
    assert terms_of(None) == terms_of(b"") == []


ITEMS = [
    (1, "same text again same"), (2, None), (3, ""), (3, "two words"), (None, "one"), (5, "nowhere_unseen"), (6, "w1x1 w2x2 W3X3 line"),
    (7, "x y z x y z x"), (8, "\U0001f642 e é token abcdef123"),
]
ITEM_SCHEMA = "item_id long, text string, _item long, score string, rank int"


def items(spark, of=ITEMS):
    return spark.createDataFrame([(i, t, 0, "clash", 1) for i, t in of], ITEM_SCHEMA)


@pytest.mark.parametrize("options", [{}, {"owners": 1}, {"owners": 7, "shard_docs": 3, "bundle_items": 2, "block_terms": 9}, {"shard_docs": 1, "k": 2}])
def test_edge_rows_against_all_scores(spark, options):
    docs = documents(spark).union(documents(spark).limit(9)).coalesce(1)
    found = tp.search(items(spark), docs, **options)
    assert rows(found) == brute(ITEMS, [(r.doc_id, r.text) for r in docs.collect()], options.get("k", 20))


def test_random_texts_and_many_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"t{min(rng.zipf(1.4), 300)}"
    texts = [" ".join(word() for _ in range(rng.integers(1, 60))) for _ in range(400)] + ["t1 t2 t3 copy of it"] * 250
    docs = spark.createDataFrame([(k * 7 % 1009, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    some = [(k, " ".join(word() for _ in range(rng.integers(1, 40)))) for k in range(30)]
    found = tp.search(items(spark, some), docs, shard_docs=100, bundle_items=8)
    assert rows(found) == brute(some, [(r.doc_id, r.text) for r in docs.collect()])


def test_accumulators_are_dropped_only_below_the_best(spark):
    """A late, frequent term may still lift a document: what is dropped stays below the k-th best by the bound."""
    queries = tp.block_of([{"_item": 0, "_terms": [b"rare", b"often"], "_times": [2, 3]}])
    weights = tp.Weights(10, 100, np.array([5000, 100]), np.array([0, 1]))
    assert weights.later(queries, 2).tolist() == [[3 * 100 * tp.MOST, 0]]
    assert tp._best(np.array([5, 1, 9]), 2) == 5 and tp._best(np.array([5]), 2) == 0


def test_nothing(spark):
    assert tp.search(items(spark), empty(spark)).count() == 0
    assert tp.search(items(spark, []), documents(spark)).count() == 0
    assert tp.search(items(spark, [(1, None)]), documents(spark)).count() == 0
    with pytest.raises(ValueError):
        tp.search(items(spark), documents(spark), shard_docs=1 << 17)


def test_query(spark, folder):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*c).collect()]
    assert rows(QUERIES["op12_term_pipeline"](spark, folder)) == brute(read("benchmark", "item_id", "text"), read("documents", "doc_id", "text"))
