"""Language of words and texts by a linear-chain conditional random field.

Words are runs of letters, lower-cased; a run of more than `LONGEST` letters, as in
scripts without blanks, is several neighbours in the chain that cover all of it. A word's score for a language is the sum
of the weights of its affixes, character n-grams and, if it is in the learned
lexicon, of the word itself; a matrix of transition weights ties neighbours
together. Forward-backward gives each word's label probabilities, so
code-switched text gets its labels word by word. A text's language is the label
with the largest mean probability over its words, its score that mean.

Training maximises the likelihood of word sequences labelled with their text's
language, on a bounded sample. In use nothing is cut: the recursion runs over
the whole text, in blocks whose transfer matrices are combined first, so that
all blocks of a batch step together.

Edge cases: null text, or text without a letter, is `und` with score 0. With no
labelled text to learn from everything is `und`; with a single language it gets
that language with score 1. Long texts are one chain. Ties go to the first language in
alphabetical order. Repeated rows get the same answer, a row without id is
predicted like any other, an empty table gives no rows. Other columns stay untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import beside
from gleaner.llm.tokens import batches

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
BLOCK = 64
LONGEST, PART = 40, 20  # letters of a chain position
MASK = 0xFFFFFFFFFFFFFFFF


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if found and max(map(len, found)) > LONGEST:
        return _parted(found)
    return found


def _parted(words: list[str]) -> list[str]:
    out = []
    for w in words:
        out += [w] if len(w) <= LONGEST else [w[a : a + PART] for a in range(0, len(w), PART)]
    return out


def _hashed(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Buckets of n-grams given as columns of code points."""
    x = np.full(len(codes[0]), kind * 0x9E3779B97F4A7C15 & MASK, dtype=np.uint64)
    for c in codes:
        x = (x ^ c) * np.uint64(0x100000001B3)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: Sequence[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, place of a weight) of all words at once: prefixes and suffixes of one to three letters, bigrams and
    trigrams with edges, and the word itself if it is in the lexicon."""
    edged = ["^" + w + "$" for w in words]
    codes = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(e) for e in edged], dtype=np.int64)
    end = np.cumsum(length)
    start, owner = end - length, np.repeat(np.arange(len(edged)), length)
    owners, places = [], []
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(codes)) + n <= end[owner]) if len(codes) else np.empty(0, dtype=np.int64)
        owners.append(owner[at])
        places.append(_hashed(n, *[codes[at + j] for j in range(n)]))
    for n in (1, 2, 3):
        whole = np.flatnonzero(length - 2 >= n)
        owners += [whole, whole]
        places.append(_hashed(10 + n, *[codes[start[whole] + 1 + j] for j in range(n)]))
        places.append(_hashed(20 + n, *[codes[end[whole] - 2 - j] for j in range(n)]))
    known = [(k, BUCKETS + lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    if known:
        owners.append(np.array([k for k, _ in known]))
        places.append(np.array([p for _, p in known]))
    return np.concatenate(owners), np.concatenate(places)


@dataclass
class Model:
    languages: tuple[str, ...]
    lexicon: dict[str, int]
    weights: np.ndarray  # place by language
    moves: np.ndarray  # language by next language

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Scores of each word for each language; a word that repeats is scored once."""
        numbers: dict[str, int] = {}
        order = [numbers.setdefault(w, len(numbers)) for w in words]
        owner, place = features(list(numbers), self.lexicon)
        columns = [np.bincount(owner, weights=w[place], minlength=len(numbers)) for w in np.ascontiguousarray(self.weights.T)]
        return np.stack(columns, axis=1)[order]


def marginals(emissions: np.ndarray, moves: np.ndarray, lengths: Sequence[int], block: int = BLOCK) -> np.ndarray:
    """Label probabilities of every word of several texts laid end to end.

    Texts are cut into blocks. Pass one multiplies each block's transfer matrix, all
    blocks stepping together; pass two carries the vectors from block to block of a
    text, forwards and backwards; pass three runs inside the blocks from those. The
    result is the forward-backward of the uncut chains.
    """
    n, k = emissions.shape
    potential = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    turn = np.exp(moves - moves.max())
    lengths = np.asarray(lengths)
    ends = np.cumsum(lengths)
    starts = [np.arange(a, b, block) for a, b in zip(ends - lengths, ends, strict=True)]
    per_text = [len(s) for s in starts]
    begin = np.concatenate(starts) if starts else np.empty(0, dtype=int)
    stop = np.minimum(begin + block, np.repeat(ends, per_text))
    size = stop - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    inverse = np.argsort(order)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")

    # transfer of a block: from the label before it to its last label
    transfer = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t, m in enumerate(live):
        x = (transfer[:m] @ turn) * potential[begin[:m] + t][:, None, :]
        transfer[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    transfer = transfer[inverse]

    # vectors at the edges of blocks, all texts stepping together, the one with most blocks first
    rows = np.argsort(-np.asarray(per_text), kind="stable")
    counts = np.asarray(per_text)[rows]
    first = (np.cumsum(per_text) - per_text)[rows]
    enter = np.zeros((len(begin), k))  # forward vector just before a block; the chain's start stands for "no label yet"
    leave = np.ones((len(begin), k))
    if len(begin):
        steps = int(counts[0])
        running = np.searchsorted(-counts, -np.arange(steps), side="left")
        alpha = None
        for j in range(steps):
            m = int(running[j])
            at = first[:m] + j
            if j == 0:
                enter[at] = -1.0
                # without a label before it the first word has no transition
                alpha = np.einsum("bij->bj", _first_block(potential, turn, begin, size, inverse, at, k))
            else:
                enter[at] = alpha[:m]
                alpha = np.einsum("bi,bij->bj", alpha[:m], transfer[at])
            alpha = alpha / alpha.sum(axis=1, keepdims=True)
        beta = np.ones((len(counts), k))
        for j in range(steps - 1, -1, -1):
            m = int(running[j])
            at = first[:m] + j
            leave[at] = beta[:m]
            x = np.einsum("bij,bj->bi", transfer[at], beta[:m])
            beta[:m] = x / x.sum(axis=1, keepdims=True)

    enter, leave = enter[order], leave[order]
    forward = np.empty((n, k))
    vector = enter.copy()
    for t, m in enumerate(live):
        e = potential[begin[:m] + t]
        x = (vector[:m] @ turn) * e
        if t == 0:
            opening = enter[:m, 0] < 0
            x[opening] = e[opening]
        vector[:m] = x / x.sum(axis=1, keepdims=True)
        forward[begin[:m] + t] = vector[:m]
    vector = leave.copy()
    for t in range(len(live) - 1, -1, -1):
        m = int(live[t])
        place = begin[:m] + t
        forward[place] *= vector[:m]
        x = (potential[place] * vector[:m]) @ turn.T
        vector[:m] = x / x.sum(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


def _first_block(potential, turn, begin, size, inverse, at, k) -> np.ndarray:
    """Forward vectors at the end of the first blocks of texts, as one-row matrices."""
    places = inverse[at]
    start, length = begin[places], size[places]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    vector = potential[start].copy()
    vector /= vector.sum(axis=1, keepdims=True)
    for t in range(1, len(live)):
        m = int(live[t])
        x = (vector[:m] @ turn) * potential[start[:m] + t]
        vector[:m] = x / x.sum(axis=1, keepdims=True)
    out = np.empty_like(vector)
    out[order] = vector
    return out[:, None, :]


def learn(
    sequences: Sequence[tuple[list[str], str]], lexicon_words: int = 4000, epochs: int = 4, batch: int = 64, rate: float = 0.25,
    decay: float = 1e-6, seed: int = 1,
) -> Model | None:
    """Adagrad on the log-likelihood of labelled word sequences. The lexicon holds the words most frequent in any language."""
    languages = tuple(sorted({lang for _, lang in sequences}))
    if not languages:
        return None
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    for words, lang in sequences:
        counts[lang].update(words)
    chosen = [w for lang in languages for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[: lexicon_words // len(languages)]]
    lexicon = {w: k for k, w in enumerate(dict.fromkeys(chosen))}
    k, size = len(languages), BUCKETS + len(lexicon)
    model = Model(languages, lexicon, np.zeros((size, k)), np.zeros((k, k)))
    if k == 1:
        return model
    every = list(dict.fromkeys(w for words, _ in sequences for w in words))
    owner, place = features(every, lexicon)
    by_word = np.argsort(owner, kind="stable")
    parts = np.split(place[by_word], np.cumsum(np.bincount(owner, minlength=len(every)))[:-1])
    sets_of = dict(zip(every, parts, strict=True))
    data = [([sets_of[w] for w in words], languages.index(lang)) for words, lang in sequences]
    weight_sum, move_sum = np.full((size, k), 1e-3), np.full((k, k), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        deal = rng.permutation(len(data))
        for a in range(0, len(deal), batch):
            some = [data[i] for i in deal[a : a + batch]]
            lengths = [len(x) for x, _ in some]
            sets = [f for x, _ in some for f in x]
            sizes = np.array([len(f) for f in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            emissions = np.zeros((len(sets), k))
            np.add.at(emissions, owner, model.weights[flat])
            gold = np.repeat([y for _, y in some], lengths)
            expected = marginals(emissions, model.moves, lengths)
            error = np.eye(k)[gold] - expected
            grad = np.zeros((size, k))
            np.add.at(grad, flat, error[owner])
            touched = np.unique(flat)
            g = grad[touched] - decay * len(sets) * model.weights[touched]
            weight_sum[touched] += g * g
            model.weights[touched] += rate * g / np.sqrt(weight_sum[touched])
            g = _move_gradient(emissions, model.moves, expected, gold, lengths)
            move_sum += g * g
            model.moves += rate * g / np.sqrt(move_sum)
    return model


def _move_gradient(emissions, moves, expected, gold, lengths) -> np.ndarray:
    """Observed less expected transitions. Pair probabilities come from the marginals of one and the conditional of the next."""
    k = len(moves)
    inner = np.ones(len(gold), dtype=bool)
    inner[np.cumsum(lengths)[:-1]] = False
    inner[0] = False
    after = np.flatnonzero(inner)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[after - 1], gold[after]), 1.0)
    if not len(after):
        return observed
    pair = expected[after - 1][:, :, None] * np.exp(moves - moves.max())[None] * np.exp(emissions[after] - emissions[after].max(axis=1, keepdims=True))[:, None, :]
    # scaled so that both ends keep their marginals: two rounds of proportional fitting
    for _ in range(6):
        pair *= (expected[after - 1] / np.maximum(pair.sum(axis=2), 1e-300))[:, :, None]
        pair *= (expected[after] / np.maximum(pair.sum(axis=1), 1e-300))[:, None, :]
    return observed - pair.sum(axis=0)


def fit(
    documents: DataFrame, usable: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 600,
    sequence_words: int = 40, sequences_per_language: int = 500,
) -> Model | None:
    """Learns from at most `sample_docs` documents among those `usable` with a language: as many of each language, the first by a
    hash of their id, and one of each language at least.

    Each sampled text is cut into sequences of `sequence_words` words, and every
    language gives `sequences_per_language` of them at most, taken evenly.
    """
    known = documents.filter(usable & F.col(lang).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_lang"))
    share = max(1, sample_docs // max(1, known.select("_lang").distinct().count()))
    first = lambda *ties: F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", *ties))
    ids = known.select("_id", "_lang").withColumn("_at", first()).filter(F.col("_at") <= share).drop("_at").distinct()
    # texts outside the sample are not sorted; ids that repeat count as often as they do
    drawn = known.join(F.broadcast(ids), ["_id", "_lang"], "left_semi").withColumn("_at", first(F.xxhash64("_t"))).filter(F.col("_at") <= share)
    by_language: dict[str, list[list[str]]] = defaultdict(list)
    for row in drawn.orderBy("_id", "_lang", "_t").collect():
        words = words_of(row["_t"])
        by_language[row["_lang"]] += [words[a : a + sequence_words] for a in range(0, len(words), sequence_words)]
    sequences = []
    for language, found in sorted(by_language.items()):
        stride = max(1, len(found) / sequences_per_language)
        sequences += [(found[int(i * stride)], language) for i in range(min(len(found), sequences_per_language))]
    return learn([s for s in sequences if s[0]])


def predict(documents: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score, and keeps all columns."""
    schema = T.StructType([T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    if model is None:
        return documents.withColumns({label: F.lit(UNDETERMINED), score: F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(schema)
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            langs, scores = [], []
            for a, b in batches([len(t) if t else 0 for t in texts], most=600_000):
                for lang, value in judge(shared.value, texts.iloc[a:b].tolist()):
                    langs.append(lang)
                    scores.append(value)
            yield pd.DataFrame({"_lang": langs, "_score": scores})

    def build(packed: DataFrame) -> DataFrame:
        judged = packed.withColumn("_judged", of(F.col("_t")))
        return judged.withColumns({"_label": F.col("_judged._lang"), "_value": F.col("_judged._score")})

    return beside(documents, text, build, {"_label": label, "_value": score})


def judge(model: Model, texts: Sequence[str | None]) -> list[tuple[str, float]]:
    split = [words_of(t) for t in texts]
    lengths = [len(w) for w in split if w]
    if not lengths:
        return [(UNDETERMINED, 0.0)] * len(split)
    flat = [w for words in split for w in words]
    probabilities = marginals(model.emissions(flat), model.moves, lengths)
    means = np.add.reduceat(probabilities, np.cumsum(lengths) - lengths, axis=0) / np.asarray(lengths)[:, None]
    found = iter([(model.languages[int(k)], min(1.0, float(m))) for k, m in zip(means.argmax(axis=1), means.max(axis=1), strict=True)])
    return [next(found) if w else (UNDETERMINED, 0.0) for w in split]


def label_words(model: Model, text: str | None) -> list[tuple[str, str, float]]:
    """Each word with its own language and probability: the view on code-switched text."""
    words = words_of(text)
    if not words:
        return []
    p = marginals(model.emissions(words), model.moves, [len(words)])
    return [(w, model.languages[int(k)], float(v)) for w, k, v in zip(words, p.argmax(axis=1), p.max(axis=1), strict=True)]
