"""N-gram novelty and perplexity against brute force, with what travels kept small."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from gleaner.operators import novelty
from gleaner.scale import broadcasts

TEXTS = [
    (1, "a b c a b c a b c"), (2, None), (3, "a b c d"), (4, "x y"), (5, ""), (6, "ab c d a b c"), (3, "a b c a b c"), (7, "b c a b c d"),
    *[(10 + i, f"a b c w{i}") for i in range(12)],
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").cache()


def counted():
    grams = {}
    for doc, text in TEXTS:
        words = (text or "").split()
        grams.setdefault(doc, Counter()).update(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return grams


def expected(seen):
    out = {}
    for doc, grams in counted().items():
        n, overlap = sum(grams.values()), sum(t * seen(doc, g) for g, t in grams.items())
        out[doc] = (n, overlap, 1 - min(overlap / n, 1.0) if n else 0.5)
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len(TEXTS)
    return {r.doc_id: (r.n_grams, r.overlap, r.novelty) for r in rows}


@pytest.fixture
def no_counts_per_text(monkeypatch):
    """Every n-gram of every text with its string, as a shuffled and written table, is what must not be built."""

    def trigrams(*_, **__):
        raise AssertionError("n-grams travel as strings")

    monkeypatch.setattr(novelty, "trigrams", trigrams)


@pytest.mark.parametrize("most", [1000, 0])
def test_ngram_novelty(spark, texts, no_counts_per_text, monkeypatch, most):
    known = {("a", "b", "c"): 5, ("b", "c", "d"): 2, ("q", "q", "q"): 9}
    table = spark.createDataFrame([(" ".join(g), n) for g, n in known.items()], "gram string, seen long")
    monkeypatch.setattr(novelty, "broadcast_if_small", lambda df: broadcasts.broadcast_if_small(df, max_rows=most))
    assert found(novelty.ngram_novelty(texts, table)) == expected(lambda doc, g: known.get(g, 0))


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_ngram_novelty_ordered(texts, no_counts_per_text, chunk):
    grams = counted()
    before = expected(lambda doc, g: sum(c[g] for other, c in grams.items() if other < doc))
    assert found(novelty.ngram_novelty_ordered(texts, chunk_rows=chunk)) == before


@pytest.mark.parametrize("common", [1000, 4])
def test_perplexity(texts, no_counts_per_text, common):
    words = {}
    for doc, text in TEXTS:
        words.setdefault(doc, []).extend((text or "").split())
    totals = Counter(w for some in words.values() for w in some)
    size = sum(totals.values()) + len(totals)
    want = {doc: (len(some), sum(-math.log((totals[w] + 1) / size) for w in some) / len(some)) for doc, some in words.items() if some}
    got = {r.doc_id: r for r in novelty.unigram_perplexity(texts, common_words=common).collect()}
    assert {d: r.n_words for d, r in got.items()} == {d: n for d, (n, _) in want.items()}
    for doc, (_, loss) in want.items():
        assert got[doc].loss == pytest.approx(loss, rel=1e-12) and got[doc].perplexity == pytest.approx(math.exp(loss))
