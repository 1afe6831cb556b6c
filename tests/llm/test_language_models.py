from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import crf_lang as crf
from gleaner.llm import hmm_lm as hmm
from gleaner.llm.queries import QUERIES
from tests.llm.cases import documents, empty, words

EN = "the house and the river were there when the children went home with the old man".split()
DE = "der mann und die frau gehen nicht nach hause weil der hund noch schläft und es regnet".split()


def sequences():
    rng = np.random.default_rng(0)
    return [([str(w) for w in rng.choice(lang, 12)], name) for _ in range(60) for lang, name in ((EN, "en"), (DE, "de"))]


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    lengths, k = [1, 5, 2, 17, 64, 65, 130, 1], 3
    emissions, moves = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k))
    got, at = crf.marginals(emissions, moves, lengths, block=7), 0
    for n in lengths:
        e, t = np.exp(emissions[at : at + n]), np.exp(moves)
        a, b = np.zeros((n, k)), np.ones((n, k))
        for i in range(n):
            a[i] = e[i] if i == 0 else (a[i - 1] @ t) * e[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        m = a * b
        assert np.allclose(m / m.sum(axis=1, keepdims=True), got[at : at + n], atol=1e-12)
        at += n


def test_code_switching_is_labelled_by_word():
    model = crf.learn(sequences())
    mixed = ["the", "children", "went", "home", "und", "der", "hund", "schläft", "nicht"]
    labels = [lang for _, lang, _ in crf.label_words(model, " ".join(mixed))]
    assert labels == ["en"] * 4 + ["de"] * 5
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]
    assert crf.label_words(model, None) == [] and crf.learn([]) is None


def test_language_edge_rows(spark):
    model = crf.learn(sequences())
    rows = crf.predict(documents(spark), model).collect()
    assert len(rows) == 16
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.languages) == letters and 0 <= r.score <= 1
        assert letters or (r.lang_pred, r.score) == ("und", 0.0)
        assert r._t in ("clash", None)
    assert crf.predict(empty(spark), model).count() == 0
    assert {r.lang_pred for r in crf.predict(documents(spark), None).collect()} == {"und"}


def test_language_query_held_out(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    rows = QUERIES["op1_crf_language"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_runs_without_blanks_count_with_all_their_letters(spark):
    """14,400 letters of one language between 19 of another on either side; a language of three documents among 800 is learned too."""
    rng = random.Random(2)
    words = {"de": ["straße", "über", "nicht", "zwischen", "häuser"], "en": ["the", "thing", "with", "which", "house"], "fr": ["été", "où", "garçon", "français", "quelque"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text("de" if k % 2 else "en", 30), "de" if k % 2 else "en") for k in range(800)] + [(900 + k, text("fr", 30), "fr") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.fit(frame, F.lit(True))
    assert model.languages == ("de", "en", "fr")
    run = "".join(rng.choice(words["de"]) for _ in range(2400))[:14_400]
    odd = spark.createDataFrame([(1, "whichthethingwiththe" + run + "whichthethingwiththe"), (2, text("fr", 9))], "doc_id long, text string")
    found = {r.doc_id: r for r in crf.predict(odd, model).collect()}
    assert found[1].lang_pred == "de" and found[2].lang_pred == "fr"
    assert sum(map(len, crf.words_of(run))) == len(run)


def hand_base(texts):
    train = {i for i in texts if i is not None and zlib.crc32(str(i).encode()) % 10}
    counts = Counter(w for i in train for w in words(texts[i]))
    total, distinct = sum(counts.values()) + len(train), len(counts) + (len(train) > 0)
    below = math.log10(total + 0.1 * (distinct + 1))
    out = {}
    for i, t in texts.items():
        score = sum(math.log10(counts[w] + 0.1) - below for w in words(t)) + math.log10(len(train) + 0.1) - below
        known = sum(counts[w] > 0 for w in words(t)) + (len(train) > 0)
        out[i] = (i not in train, len(words(t)) + 1, known, total, score)
    return out


@pytest.mark.parametrize("head,dictionary", [(4000, 200_000), (5, 20)])
def test_base_scores_and_edge_rows(spark, head, dictionary):
    docs = documents(spark)
    expected = hand_base(dict(docs.select("doc_id", "text").collect()))
    rows = hmm.score(docs, head_words=head, dictionary_words=dictionary, states=3, iterations=1).collect()
    assert len(rows) == 16
    for r in rows:
        held, tokens, known, total, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and r.score < 0
    assert hmm.score(empty(spark)).count() == 0


def test_score_query(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    expected, rows = hand_base(texts), QUERIES["op8_hmm_score"](spark, folder).collect()
    assert len(rows) == len(texts)
    assert all(math.isclose(r.base_score, expected[r.doc_id][4], rel_tol=1e-9) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    draw = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape))
    model = hmm.Model(draw(3), draw(3, 3), draw(3, 4))
    seqs = [np.array(x) for x in ([0, 1, 3], [2], [1, 1, 2, 0, 3])]
    for s, got in zip(seqs, hmm.log_likelihoods(model, seqs), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-12)


def test_long_text_does_not_underflow():
    model = hmm.initial(np.full(50, 0.02), 4, 1)
    long = np.random.default_rng(0).integers(0, 50, 20_000)
    assert -40_000 < hmm.log_likelihoods(model, [long, long[:3]])[0] < -20_000


def test_each_iteration_raises_the_likelihood():
    rng = np.random.default_rng(4)
    seqs = [np.array([2 * (k % 2) + int(rng.integers(0, 2)) for k in range(rng.integers(2, 40))]) for _ in range(80)]
    model = hmm.Model(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.array([[0.3, 0.3, 0.2, 0.2], [0.2, 0.2, 0.3, 0.3]]))
    last = -1e9
    for _ in range(40):
        now = hmm.log_likelihoods(model, seqs).sum()
        assert now >= last - 0.1
        last, model = now, hmm.updated(*hmm.expected_counts(model, seqs, 256), np.full(4, 0.25), prior=0.0)
    tokens = sum(map(len, seqs))
    assert last > -1.02 * tokens * math.log10(2)  # the two alternating states are found: one bit a token is left
    assert model.move[0, 1] > 0.98 and model.move[1, 0] > 0.98


def test_word_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([(0, "a a a b b c d"), (1, "a e e f")], "_i int, _t string")
    v = hmm.build_vocabulary(hmm.count_words(frame), 2, 2, 100)
    assert v.total == 13 and v.distinct == 7 and len(v.head) == 2
    for tail in range(hmm.TAIL_SYMBOLS):
        inside = [10 ** v.inside(c, tail) for w, c in v.counts.items() if w not in v.head and hmm.tail_symbol(w) == tail]
        assert math.isclose(sum(inside) + 10 ** v.inside(0, tail), 1.0)
    assert math.isclose(v.unigram().sum(), 1.0)
    assert frame.select(F.lit(1)).count() == 2


def two_tongues(texts=400, kinds=100):
    """Texts of one of two tongues: a frequent word tells it, the others are rare and share their ending, so one symbol.
    Held out texts come twice, the second time with the rare words of the other tongue."""
    rng, out, own = np.random.default_rng(6), [], None
    for k in range(1, texts + 1):
        tongue = int(rng.integers(0, 2))
        text = " ".join(w for _ in range(10) for w in (("the", "der")[tongue], *(f"{'ab'[tongue]}{rng.integers(0, kinds)}zz" for _ in range(2))))
        if zlib.crc32(str(k).encode()) % 10 == 0:
            text, own = (text, text) if own is None else (own.translate(str.maketrans("ab", "ba")), None)
        out.append(text)
    return out


@pytest.mark.parametrize("dictionary", [20, 200_000])
def test_rare_words_have_emissions_per_state(spark, dictionary):
    rows = hmm.score(documents(spark, two_tongues()), head_words=2, dictionary_words=dictionary, states=4, iterations=3).collect()
    held = sorted((r for r in rows if r.held_out and r.doc_id), key=lambda r: r.doc_id)
    gain = [r.score - r.base_score for r in held]
    pairs = list(zip(gain[::2], gain[1::2], strict=False))
    # a shared symbol without words per state gives both of a pair the same
    assert len(pairs) > 10 and sum(a - b for a, b in pairs) > 5 * len(pairs)


def test_training_does_not_depend_on_the_dictionary(spark):
    docs = documents(spark, two_tongues(80))
    few, all_of_them = [
        {r.doc_id: r.score for r in hmm.score(docs, head_words=2, dictionary_words=n, states=3, iterations=2).collect()} for n in (5, 200_000)
    ]
    assert all(math.isclose(few[k], all_of_them[k], rel_tol=1e-4) for k in few)


def test_lifts_keep_the_probabilities(spark):
    frame = spark.createDataFrame([(0, "a a a b b c d"), (1, "a e e f")], "_i int, _t string")
    v, rng = hmm.build_vocabulary(hmm.count_words(frame), 2, 2, 100), np.random.default_rng(2)
    words = list(v.counts)[2:]
    counts = rng.dirichlet([1.0, 1.0, 1.0], len(words)) * np.array([[v.counts[w]] for w in words])
    zero = np.zeros((hmm.TAIL_SYMBOLS, 3))
    lifts = hmm.lifts_of(v, counts, zero, zero, np.zeros(hmm.TAIL_SYMBOLS))
    for tail in range(hmm.TAIL_SYMBOLS):
        own = [k for k, w in enumerate(words) if hmm.tail_symbol(w) == tail]
        unseen = lifts.of(np.array([tail]), np.zeros(1), np.zeros((1, 3)))[0]
        total = 10 ** v.inside(0, tail) * unseen + sum(10 ** v.inside(v.counts[words[k]], tail) * lifts.known[k] for k in own)
        assert np.allclose(total, 1.0)


def test_codes_come_back_as_written():
    codes = np.array([0, 65_534, 65_535, 3, 65_536, 400_000, 1])
    assert hmm.read(*hmm.written(codes)).tolist() == codes.tolist()
    assert hmm.read(hmm.written(codes)[0][:8], hmm.written(codes)[1]).tolist() == codes[:4].tolist()
