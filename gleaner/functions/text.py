"""Text scores as column expressions: no shuffle, no Python worker.

A column argument named `words` is the array ``words_of(text)``; compute it once
with ``with_words`` when several scores need it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import let

# Keyword lists for topics and domains. The order of the topics
# decides ties.
TOPIC_KEYWORDS = {
    "science": [
        "research", "study", "experiment", "theory", "scientific",
        "biology", "physics", "chemistry", "mathematics",
    ],
    "history": [
        "century", "year", "historical", "war", "empire",
        "ancient", "medieval", "revolution", "dynasty",
    ],
    "culture": [
        "art", "music", "literature", "film", "culture",
        "tradition", "festival", "language", "society",
    ],
    "technology": [
        "computer", "software", "internet", "digital",
        "technology", "innovation", "data", "system",
    ],
    "politics": [
        "government", "election", "policy", "political",
        "democracy", "parliament", "president", "law",
    ],
}
DOMAIN_KEYWORDS = {
    "code": ["function", "class", "import", "def", "return", "if", "for", "while"],
    "science": ["research", "study", "analysis", "hypothesis", "experiment", "data"],
    "dialogue": ["said", "asked", "replied", "conversation", "discuss", "talk"],
}

SENTENCE_END = r"[.!?]+(\s+|$)"
EPS = 1e-8


SPACE = " \t\n\r\f\x0b"


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_count(text: Column) -> Column:
    """`size(words_of(text))` without building the words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("words", words_of(F.coalesce(F.col(text), F.lit(""))))


def _at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def sentence_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SENTENCE_END), ""))


def unique_share(words: Column) -> Column:
    return _ratio(F.size(F.array_distinct(words)), _at_least_one(F.size(words)))


def quality(text: Column, words: Column) -> Column:
    """Length band, sentence structure and vocabulary variety, at most 1."""
    n = F.size(words)
    sentences = sentence_count(text)
    per_sentence = _ratio(n, _at_least_one(sentences))
    band = (
        F.when(n.between(50, 500), 0.3)
        .when(n.between(20, 49) | n.between(501, 1000), 0.2)
        .otherwise(0.1)
    )
    several = F.when(sentences > 1, 0.2).otherwise(0.0)
    readable = F.when(per_sentence.between(10, 25), 0.2).otherwise(0.0)
    return F.least(
        band + several + readable + F.least(unique_share(words), F.lit(0.3)), F.lit(1.0)
    )


def complexity(text: Column, words: Column) -> Column:
    """Mean word length and sentence length, half each."""
    n = F.size(words)
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    word_length = F.when(n > 0, _ratio(letters, _at_least_one(n))).otherwise(0.0)
    per_sentence = _ratio(n, _at_least_one(sentence_count(text)))
    return (
        F.least(word_length / 10, F.lit(1.0)) * 0.5 + F.least(per_sentence / 30, F.lit(1.0)) * 0.5
    )


def word_entropy(words: Column) -> Column:
    """Entropy of the word frequencies, by run length over the sorted words.

    Stays inside the row: exploding the words would shuffle the whole corpus.
    """
    def entropy(n: Column) -> Column:
        return F.aggregate(
            F.array_sort(words), start, step(n), lambda acc: acc["sum"] + term(acc["run"], n)
        )

    def term(run: Column, n: Column) -> Column:
        return -(run / n) * F.log(run / n + EPS)

    def step(n: Column):
        return lambda acc, word: extend(acc, word, n)

    def extend(acc: Column, word: Column, n: Column) -> Column:
        same = word.eqNullSafe(acc["word"])
        return F.struct(
            word.alias("word"),
            F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same | (acc["run"] == 0), acc["sum"])
            .otherwise(acc["sum"] + term(acc["run"], n))
            .alias("sum"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")
    )
    n = F.size(words).cast("double")
    return F.when(F.size(words) > 0, let(n, entropy)).otherwise(0.0)


def quality_rci(text: Column, words: Column) -> dict[str, Column]:
    """Readability, coherence, informativeness and their weighted sum."""
    parts = F.size(F.split(text, r"\."))
    empty = text == ""
    readability = F.when(empty, 0.0).otherwise(
        F.least(_ratio(F.size(words), parts) / 20.0, F.lit(1.0))
    )
    coherence = F.when(empty, 0.0).otherwise(unique_share(words))
    informativeness = F.when(empty, 0.0).otherwise(
        F.least(word_entropy(words) / 10.0, F.lit(1.0))
    )
    return {
        "readability": readability,
        "coherence": coherence,
        "informativeness": informativeness,
        "score": 0.3 * readability + 0.3 * coherence + 0.4 * informativeness,
    }


def keyword_hits(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Array with, per list, how many keywords occur as substrings, ignoring case."""

    def counts(lower: Column) -> Column:
        found = [
            [F.contains(lower, F.lit(k)).cast("int") for k in names] for names in keywords.values()
        ]
        return F.array(*[reduce(lambda a, b: a + b, hits) for hits in found])

    return let(F.lower(text), counts)


def domain_scores(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Map from domain to the share of its keywords present."""
    keywords = keywords or DOMAIN_KEYWORDS
    sizes = F.array(*[F.lit(float(len(names))) for names in keywords.values()])
    shares = F.zip_with(keyword_hits(text, keywords), sizes, lambda hits, size: hits / size)
    return F.map_from_arrays(F.array(*[F.lit(name) for name in keywords]), shares)


def domain_relevance(text: Column, target: str, keywords=None) -> Column:
    return F.coalesce(F.try_element_at(domain_scores(text, keywords), F.lit(target)), F.lit(0.0))


def topic(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Topic with most keyword hits; the first topic wins ties."""
    keywords = keywords or TOPIC_KEYWORDS
    names = F.array(*[F.lit(name) for name in keywords])
    return let(
        keyword_hits(text, keywords),
        lambda hits: F.element_at(names, F.array_position(hits, F.array_max(hits)).cast("int")),
    )


def curriculum(n_words: Column, progress: Column | float) -> Column:
    """Short texts early, medium ones midway, long ones late."""
    progress = F.lit(progress) if isinstance(progress, (int, float)) else progress
    n = n_words.cast("double")
    score = (
        F.when(progress < 0.3, 1.0 - n / 200)
        .when(progress < 0.7, 1.0 - F.abs(n - 300) / 300)
        .otherwise(F.least(n / 500, F.lit(1.0)))
    )
    return F.when(n_words == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def difficulty_level(n_words: Column) -> Column:
    return F.when(n_words < 100, "easy").when(n_words < 300, "medium").otherwise("hard")


def length_band(n_words: Column) -> Column:
    return F.when(n_words < 50, "short").when(n_words < 200, "medium").otherwise("long")


def diminishing(selected: Column | int, rate: float) -> Column:
    """Discount for a sample scored when `selected` samples are already chosen."""
    selected = F.lit(selected) if isinstance(selected, int) else selected
    return 1.0 / (1.0 + rate * selected)


def capped_perplexity(perplexity: Column, selected: Column | int) -> Column:
    return F.least(perplexity / 100.0, F.lit(10.0)) * diminishing(selected, 0.05)
